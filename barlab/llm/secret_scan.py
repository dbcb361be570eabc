r"""Secret scan: spans of credentials in every whole text, and how widely each value is copied.

Only DataFrame functions run here. The base kinds, leftmost and non-overlapping per kind:

- assign: a key word, a separator and a value of 6 or more characters;
- access: `AKIA[A-Z0-9]+` of 20 or more; hex: `[0-9a-f]+` of 24 or more.

The method adds the kinds vendor (prefixed keys), pem (private-key headers) and opaque (runs of 32 or
more that mix upper case, lower case and digits). Values are hashed, and for each hash the distinct
repositories and owners are counted over the corpus. A value is a widely copied example if `copied_owners` owners have
it, or `copied_repositories` repositories of however few owners; any other is live. Opaque spans stay only if live; all
other spans stay. The query takes a document's source as its owner and the document itself as its repository.

Positions are code points, end exclusive. They are running sums of the lengths of the matches and of the pieces
between them, over the rows of a text's matches, so that time is linear in their number. Only matches are exploded,
shuffled and joined. Redaction cuts a text into chunks once, so that no span is sought from the text's start.

Cases: a null text is empty; a null owner or repository counts as none; equal rows and repeated
ids are scanned each. Empty tables give empty results; other columns are ignored (`scan`) or kept
(`redact`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint

# The patterns of the base kinds. Matches too short are dropped after the scan for assign;
# for the other kinds a match is a whole run, so the least length stands in the pattern.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Added kinds.
VENDOR = r"(?:gh[opsu]_|github_pat_|glpat-|xox[abpr]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]{16,}"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"

KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "vendor": VENDOR, "pem": PEM, "opaque": OPAQUE}
_BASE = ("assign", "access", "hex")
# What a text with a match of these kinds contains; looked for before the pattern is tried.
_HOLDS = {"access": ("AKIA",), "vendor": ("_", "-", "AIza"), "pem": ("PRIVATE KEY-----",)}
#: Code points of a chunk of a text that is redacted.
CHUNK = 1024


def _pieces(text: Column, kind: str) -> Column:
    """Array of (kind, rank, nth, gap, size, value_hash, good): the matches of one kind in order, and the gap before each."""
    pattern, rank = F.lit(KINDS[kind]), list(KINDS).index(kind)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, KINDS[kind], -1)
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    value = lambda x: x["values"] if kind == "assign" else x["found"]
    good = lambda x: F.lit(True)
    if kind == "assign":
        good = lambda x: F.length(value(x)) >= ASSIGN_LEAST
    if kind == "opaque":
        good = lambda x: value(x).rlike("[A-Z]") & value(x).rlike("[a-z]") & value(x).rlike("[0-9]")

    def piece(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("nth"), F.length(x["between"]).cast("long").alias("gap"),
            F.length(x["found"]).cast("long").alias("size"), F.when(good(x), _value_hash(value(x))).alias("value_hash"),
        )

    sides = [F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"), *([values.alias("values")] if kind == "assign" else [])]
    pieces = F.transform(F.arrays_zip(*sides), piece)
    hit = text.rlike(KINDS[kind])
    for k, literal in enumerate(_HOLDS.get(kind, ())):
        may = F.contains(text, F.lit(literal)) if not k else may | F.contains(text, F.lit(literal))
    return F.when(may & hit if kind in _HOLDS else hit, pieces).otherwise(F.array().cast(_PIECES))


_PIECES = "array<struct<kind:string,rank:int,nth:int,gap:bigint,size:bigint,value_hash:string>>"


def all_pieces(text: Column) -> Column:
    """Matches of all kinds with the gaps before them; a null text has none."""
    full = F.coalesce(text, F.lit(""))
    return F.concat(*(_pieces(full, k) for k in KINDS))


def placed_spans(pieces: DataFrame, *keep: str) -> DataFrame:
    """Columns `row`, `keep`, kind, rank, start, stop, value_hash of the matches that count, from rows of `row`, `keep` and `x`, a match each."""
    flat = pieces.select("row", *keep, "x.*")
    so_far = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = flat.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("value_hash is not null")
    return stop.select("row", *keep, "kind", "rank", (F.col("stop") - F.col("size")).alias("start"), "stop", "value_hash")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners): distinct counts of candidates (value_hash, repository, owner).

    Repeats go first, map-side, so a value copied into a third of the rows is few rows by its count.
    """
    pairs = candidates.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("uses"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count("repository").alias("n"), F.sum("uses").alias("uses"))
    owners = by_owner.groupBy("value_hash").agg(F.count("owner").alias("owners"), F.sum("uses").alias("uses"))
    per_repo = pairs.groupBy("value_hash", "repository").agg(F.lit(1).alias("one"))
    repositories = per_repo.groupBy("value_hash").agg(F.count("repository").alias("repositories"))
    return owners.join(repositories.hint("merge"), "value_hash")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    copied_owners: int = 3,
    copied_repositories: int = 10,
) -> DataFrame:
    """One row per input row: doc_id, text_hash, spans (array with kind, start, stop, value_hash, owners, repositories, live)."""
    raw = checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("text_hash"),
            F.col(owner_col).cast("string").alias("owner"),
            F.col(repository_col).cast("string").alias("repository"),
            all_pieces(F.col(text_col)).alias("found"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    some = raw.where(F.size("found") > 0)
    each = checkpoint(placed_spans(some.select("row", "owner", "repository", F.explode("found").alias("x")), "owner", "repository"))
    # the counts are materialised before their join: only then can adaptive execution split the uses of a value that a third of the rows have
    counts = checkpoint(ownership(each))
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    judged = each.join(counts.hint("merge"), "value_hash").withColumn("live", live)
    kept = judged.where((F.col("kind") != "opaque") | F.col("live"))
    fields = ["start", "rank", "stop", "kind", "value_hash", "owners", "repositories", "live"]
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))
    placed = some.select("row", "doc_id", "text_hash").join(grouped.hint("merge"), "row", "left").drop("row")
    kind = dict(placed.dtypes)["spans"]
    none = F.array().cast(kind)
    return placed.withColumn("spans", F.coalesce("spans", none)).unionByName(
        raw.where(F.size("found") == 0).select("doc_id", "text_hash", none.alias("spans"))
    )


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_repositories (of the value most widely copied)."""
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < 3)
    return scanned.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )


def _masked(text: Column, runs: Column) -> Column:
    """The text with each of `runs` (start, stop, live; in order, apart) replaced by its mark."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"), F.length(text).cast("long").alias("n"))

    def between(x: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the chunks that have them."""
        first, count = F.floor(a / CHUNK).cast("int"), F.floor((F.greatest(a, b - 1)) / CHUNK).cast("int") - F.floor(a / CHUNK).cast("int") + 1
        near = F.array_join(F.slice(x["c"], first + 1, count), "")
        return F.when(b > a, F.substring(near, (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def masked(x: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["stop"]))
        gaps = F.transform(F.arrays_zip(F.slice(ends, 1, F.size(runs)).alias("at"), runs.alias("run")), lambda z: F.concat(between(x, z["at"], z["run"]["start"]), z["run"]["mark"]))
        return F.concat(F.array_join(gaps, ""), between(x, F.element_at(ends, -1), x["n"]))

    return F.get(F.transform(F.array(whole), masked), F.lit(0))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", **options) -> DataFrame:
    """`docs` with each span replaced: `[SECRET]` if live, `[EXAMPLE]` if widely copied; overlapping spans are one, live if one of them is.

    A text without spans stays as it is, null included; n_chars, where there is one, follows the text.
    """
    found = scan(docs, id_col, text_col, owner_col, id_col, **options).where(F.size("spans") > 0)
    # equal texts of one id have equal spans; the spans of others never differ, so the first stands for all
    once = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans").dropDuplicates(["__id", "__hash"])
    each = once.select("__id", "__hash", F.explode("spans").alias("x")).select("__id", "__hash", "x.start", "x.stop", "x.rank", "x.live")
    text_order = Window.partitionBy("__id", "__hash").orderBy("start", "rank")
    reached = F.max("stop").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("new", (F.coalesce(reached, F.lit(0)) <= F.col("start")).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(text_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("__id", "__hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("live").alias("live"))
    mark = F.when(F.col("live"), F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
    spans = runs.groupBy("__id", "__hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop", mark.alias("mark")))).alias("__runs"))
    both = docs.withColumn("__own", F.xxhash64(text_col))
    both = both.join(spans.hint("merge"), both[id_col].eqNullSafe(spans["__id"]) & (both["__own"] == spans["__hash"]), "left")
    out = both.withColumn(text_col, F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(_masked(F.col(text_col), F.col("__runs"))))
    if "n_chars" in docs.columns:
        size = F.length(text_col).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns)


# The same rows in DuckDB's SQL. Pieces between matches come from replacing each match by U+E000; texts
# in which U+E000 itself occurs would need another mark.
_SQL_ASSIGN = ASSIGN.replace("'", "''")
ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
kinds(kind, rnk, pat) AS (VALUES ('assign', 0, '{_SQL_ASSIGN}'), ('access', 1, '{ACCESS}'), ('hex', 2, '{HEX}'),
  ('vendor', 3, '{VENDOR}'), ('pem', 4, '{PEM}'), ('opaque', 5, '{OPAQUE}')),
hits AS (
  SELECT r, doc_id, source, 'assign' AS kind, 0 AS rnk, regexp_extract_all(t, '{_SQL_ASSIGN}') AS m, regexp_extract_all(t, '{_SQL_ASSIGN}', 2) AS v, string_split_regex(t, '{_SQL_ASSIGN}') AS p FROM docs
  UNION ALL SELECT r, doc_id, source, 'access', 1, regexp_extract_all(t, '{ACCESS}'), regexp_extract_all(t, '{ACCESS}'), string_split_regex(t, '{ACCESS}') FROM docs
  UNION ALL SELECT r, doc_id, source, 'hex', 2, regexp_extract_all(t, '{HEX}'), regexp_extract_all(t, '{HEX}'), string_split_regex(t, '{HEX}') FROM docs
  UNION ALL SELECT r, doc_id, source, 'vendor', 3, regexp_extract_all(t, '{VENDOR}'), regexp_extract_all(t, '{VENDOR}'), string_split_regex(t, '{VENDOR}') FROM docs
  UNION ALL SELECT r, doc_id, source, 'pem', 4, regexp_extract_all(t, '{PEM}'), regexp_extract_all(t, '{PEM}'), string_split_regex(t, '{PEM}') FROM docs
  UNION ALL SELECT r, doc_id, source, 'opaque', 5, regexp_extract_all(t, '{OPAQUE}'), regexp_extract_all(t, '{OPAQUE}'), string_split_regex(t, '{OPAQUE}') FROM docs),
placed AS (
  SELECT r, doc_id, source, kind, rnk, v[i] AS value,
    list_sum([length(x) for x in p[1:i]])::BIGINT + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0)::BIGINT AS b, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0)),
each AS (
  SELECT * FROM placed WHERE (kind <> 'assign' OR length(value) >= {ASSIGN_LEAST})
    AND (kind <> 'opaque' OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')))),
own AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM each GROUP BY value),
marked AS (SELECT e.*, repositories, owners < 3 AND repositories < 10 AS live, kind || ':' || b || ':' || (b + n) AS s FROM each e JOIN own USING (value)),
judged AS (SELECT * FROM marked WHERE kind <> 'opaque' OR live),
per AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(s, ',' ORDER BY b, rnk) FILTER (rnk < 3) AS base, string_agg(s, ',' ORDER BY b, rnk) AS spans,
    count(*) FILTER (live) AS l, count(*) FILTER (NOT live) AS c, max(repositories) AS w FROM judged GROUP BY r)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_live, coalesce(c, 0)::BIGINT AS n_copied,
  coalesce(w, 0)::BIGINT AS most_repositories
FROM docs d LEFT JOIN per USING (r)
"""
