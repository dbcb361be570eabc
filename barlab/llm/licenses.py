"""Licence scan by canonical digests of entire texts.

A text is put in canonical form: lower case, without copyright statements and reservations of rights, with one
space for each run of other characters than ASCII letters and digits, and with one spelling of equivalent
words. A copyright statement goes to the end of its line, or to the grant that follows on the same line; lines that only
go on about a copyright notice, holder and the like stay. The SHA-256 of the whole canonical document, and of each canonical line, is hash-joined to the
digests of known licence texts and notices. So a licence is found if it is the whole document, or if a
notice is a whole line of it.

Known texts are a fixed list, short ones as they are and long ones as the digests of their canonical forms (`digest_of` gives a
caller's own), so the digests' table has a fixed size and is broadcast. Every known text holds one of STEMS, which canonical form leaves as they are; texts and lines without one cannot match and
are not digested.

Cases: null and empty texts match nothing; a document that repeats a notice counts it each time and names
the licence once. Repeated rows are each answered. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint

_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. "
)
_GRANT_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
_DENIAL_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_HEADER_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_DENIAL_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
    'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
    "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
    "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
_MPL_2 = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/."
)


def _gnu(what: str, name: str, version: str, colon: str, end: str) -> str:
    """The notice of the GNU licences for a program or library."""
    return (
        f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}{end}"
    )


_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301{} USA"

# Known texts and notices by SPDX identifier.
KNOWN = (
    ("BSD-2-Clause", _BSD_2 + _DENIAL_BSD),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_2}{_DENIAL_BSD}"),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _DENIAL_BSD),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_2}{_BSD_3}{_DENIAL_BSD}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License {_ZLIB}"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}/"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("MPL-2.0", _MPL_2),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0-or-later", _gnu("program", "General Public License", "2", ";", _WRITE.format(","))),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0-or-later", _gnu("program", "General Public License", "3", ":", _SEE)),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("AGPL-3.0-or-later", _gnu("program", "Affero General Public License", "3", ":", _SEE)),
    ("AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("LGPL-2.1-or-later", _gnu("library", "Lesser General Public License", "2.1", ";", _WRITE.format(" "))),
    ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0-or-later", _gnu("program", "Lesser General Public License", "3", ":", _SEE)),
    ("LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("MIT", _GRANT_MIT),
    ("MIT", f"MIT License {_GRANT_MIT}"),
    ("MIT", f"The MIT License {_GRANT_MIT}"),
    ("MIT", f"The MIT License (MIT) {_GRANT_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _GRANT_ISC + _DENIAL_ISC),
    ("ISC", f"ISC License {_GRANT_ISC}{_DENIAL_ISC}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _GRANT_0BSD + _DENIAL_ISC),
    ("0BSD", f"Zero-Clause BSD License {_GRANT_0BSD}{_DENIAL_ISC}"),
    ("Apache-2.0", _HEADER_APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)
# SHA-256 of the canonical forms of whole licences, as the licences' stewards publish them.
DIGESTS = (
    ("Apache-2.0", "6a312089ab113dd9c09b20d681693914a162acb8264ed30901f097035fa923d6"),
    ("Artistic-1.0-Perl", "0afd52be8b508e626c1c62671ab3cb3c0c618a41cbe3fc2e44968a0b0df4d8e7"),
    ("CC0-1.0", "53ce1009e15915bd3894eb9954d2e0bca98762265af5b5e3a397f9889d053aa3"),
    ("GFDL-1.2-only", "863822f9108370da3676d19cf7f71058a6b731fcb2cafd6ecbd66bcb1bc22d0a"),
    ("GFDL-1.3-only", "bee1482d6b015cf5921e3c0cff0df7218d32a9ab099614b90858acccdb2f8928"),
    ("GPL-1.0-only", "4c80c0fddb564491564f94f8e0a72e59b947dea13ce152ee32b59d7c0ad6c7d5"),
    ("GPL-2.0-only", "9aa4d84570bd1688c83135f1752543b013a15526cd4d5b59687d9a138368476b"),
    ("GPL-3.0-only", "500c33df2b67d406006410695f3637345941445364dee0f7c18bd34bced9be64"),
    ("LGPL-2.0-only", "b9b64a26cc1d4ad14838e8e58b6581747071de21cfcac0da722052f0b48462fe"),
    ("LGPL-2.1-only", "a3a4de22e8514828fb541ee91211659c487395fcc969c054bbe06cabd5c17c79"),
    ("LGPL-3.0-only", "03b7fb5da5f0d35c60dae960732750c0cf1a7e1f1dc837b71261fcaf070eea71"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6f6ed1c34a956572644db8e04f2e6bf30fb54a72bb636d3cb6dd20182f765c66"),
)
#: Every known text has one of these.
STEMS = ("licen", "permission", "redistribution")
# Equivalent spellings, in order.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("share alike", "sharealike"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("fulfil ", "fulfill "),
    ("while st", "whilst"),
    ("https", "http"),
)
# A copyright statement of a line, and the grants that end it; words that follow `copyright` in the licences' own sentences.
_GRANT = r"permission (?:is hereby|to use|is granted)|redistribution and use|licen[sc]ed under|released under|this (?:software|program|library|work|file|project) is"
_COPYRIGHT = rf"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)[^a-z0-9\n]*[0-9]{{4}}|©)[^\n]*?({_GRANT}|$)"
_ABOUT = r"copyright([^a-z0-9]+)(notice|holder|owner|law|license|licence|statement|interest|protection|act|treat|permission|in |on |and |or |as |for |is |of |the software|disclaimer|code)"
_RESERVED = "all rights reserved"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), _ABOUT, "copy-right$1$2")
    out = F.regexp_replace(out, _COPYRIGHT, "$1")
    out = F.replace(out, F.lit(_RESERVED), F.lit(""))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest_of(text: Column) -> Column:
    """The digest under which a whole text, or a line of one, is looked up."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the fixed list."""
    table = spark.createDataFrame(list(KNOWN), "license string, text string")
    long = spark.createDataFrame(list(DIGESTS), "license string, digest string").select("digest", "license")
    return table.select(digest_of(F.col("text")).alias("digest"), "license").union(long).distinct()


def _may_match(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for stem in STEMS:
        found = found | F.contains(low, F.lit(stem))
    return F.coalesce(found, F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (distinct, sorted, comma-joined), whole_license (null unless the whole text is one), n_notices."""
    text = F.col(text_col)
    lines = F.transform(F.filter(F.split(text, "\n"), _may_match), lambda x: digest_of(x))
    digests = F.when(_may_match(text), F.struct(digest_of(text).alias("whole"), lines.alias("lines")))
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), digests.alias("x")).withColumn("row", F.monotonically_increasing_id()))
    some = rows.where("x is not null").select("row", "doc_id", "x.whole", "x.lines")
    known = F.broadcast(known_digests(docs.sparkSession))  # fixed size: len(KNOWN) + len(DIGESTS) rows
    units = some.select("row", F.lit(True).alias("is_whole"), F.col("whole").alias("digest")).union(
        some.select("row", F.lit(False).alias("is_whole"), F.explode("lines").alias("digest"))
    )
    hits = units.join(known, "digest")
    found = hits.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.max(F.when(F.col("is_whole"), F.col("license"))).alias("whole_license"),
        F.count(F.when(~F.col("is_whole"), 1)).alias("n_notices"),
    )
    judged = some.select("row", "doc_id").join(found.hint("merge"), "row", "left").select("doc_id", "licenses", "whole_license", "n_notices")
    rest = rows.where("x is null").select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long"))
    return judged.union(rest).select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), "whole_license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_ABOUT}', 'copy-right\\1\\2', 'g')"
    out = f"regexp_replace({out}, '{_COPYRIGHT}', '\\1', 'g')"
    out = f"' ' || trim(regexp_replace(replace({out}, '{_RESERVED}', ''), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}))"


def _sql_may(text: str) -> str:
    return " OR ".join(f"contains(lower({text}), '{stem}')" for stem in STEMS)


ORACLE_SQL = f"""
WITH known AS (
  SELECT DISTINCT license, {_sql("text")} AS digest FROM (VALUES {", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, t in KNOWN)}) v(license, text)
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)}) w(license, digest)),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
units AS (
  SELECT r, true AS w, {_sql("text")} AS digest FROM docs WHERE {_sql_may("text")}
  UNION ALL
  SELECT r, false, {_sql("line")} FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE {_sql_may("line")}),
found AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(CASE WHEN w THEN license END) AS whole_license, count(*) FILTER (NOT w) AS n
  FROM units JOIN known USING (digest) GROUP BY r)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, whole_license, coalesce(n, 0)::BIGINT AS n_notices FROM docs d LEFT JOIN found USING (r)
"""
