"""Token ids of whole texts by a public tokenizer, chunk by chunk.

Ids equal those of the tokenizers library on the whole text. A text is cut only where no token can span
the cut: the word tokenizer drops white space, and the byte tokenizer gives each space to the visible
text after it. Texts in which the library may find an added token (as it stands in the text) go to it whole. Arrow finds the distinct chunks of a batch, parts plain words from their closing marks and looks both up
among those met before, in bounded tables; new plain words go to the library many at a time, all else goes to it as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a sort that one worker remembers; the table starts afresh beyond it.
CACHE_CHUNKS = 400_000
#: Bytes of text that are encoded at once; a longer text is taken by itself.
BATCH_BYTES = 8_000_000

#: A plain chunk is a word of these letters, whose lower case is one letter again, and closing marks.
_PLAIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
_MARKS = """.,!?;:|"()&$%*#-"""
#: In a cut text, the sign of a chunk that has no space before it; texts that hold it are encoded whole.
_BARE = "\x01"
#: Texts that the byte tokenizer must see whole: white space beside white space, at an end, or unusual.
_IRREGULAR = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00-\x09\x0b-\x1f]"
    r"|\x{85}|\x{a0}|\x{1680}|\x{180e}|[\x{2000}-\x{200b}]|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{2060}|\x{3000}|\x{feff}"
)


class _Known:
    """Strings met before and their ids, in growing arrays."""

    def __init__(self):
        self.keys, self.flat, self.ends = pa.array([], pa.string()), np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def places(self, keys: pa.StringArray, encode: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """The position of each of `keys`, which are distinct; new ones are encoded and kept."""
        found = pc.index_in(keys, value_set=self.keys)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            some = keys.take(pa.array(new))
            blobs = encode(some.to_pylist())
            at[new] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, some])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(blobs), dtype="<u4")])
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))) // 4)
        return at


class Encoder:
    """encode(texts) gives all ids in one array of unsigned 32-bit numbers, and where each text starts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        tokens = self._tokenizer.get_vocab(with_added_tokens=True)
        self._word_ends = any(t.endswith("</w>") for t in tokens)
        # the ids that end a word, or those that start one with a space
        self._edge = np.zeros(max(tokens.values()) + 1, dtype=bool)
        for token, i in tokens.items():
            self._edge[i] = token.endswith("</w>") if self._word_ends else token.startswith("Ġ")
        self._plain, self._odd, self._marks = _Known(), _Known(), _Known()
        self._added = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Encode words together; each begins with its space (byte tokenizer) or ends with its mark."""
        joined = (" " if self._word_ends else "").join(words)
        ids = np.frombuffer(self._library([joined])[0], dtype="<u4")
        edges = np.flatnonzero(self._edge[ids])
        starts = np.concatenate([[0], edges[:-1] + 1]) if self._word_ends else edges
        if len(starts) != len(words):  # not one edge to a word: leave nothing to chance
            return self._library(words)
        blob, cuts = ids.tobytes(), (np.append(starts, len(ids)) * 4).tolist()
        return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _new_plain(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            out += self._words(some if self._word_ends else [" " + w for w in some])
        return out

    def _new_odd(self, chunks: list[str]) -> list[bytes]:
        if not self._word_ends:
            chunks = [x[1:] if x[0] == _BARE else x if x == "\n" else " " + x for x in chunks]
        return self._library(chunks)

    def _look_up(self, chunks: pa.StringArray) -> pa.ListArray:
        """The ids of each of distinct chunks. A plain chunk's are those of its word and of its marks."""
        core = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(core, _PLAIN).to_numpy(zero_copy_only=False)
        some, rest = pa.array(np.flatnonzero(plain)), pa.array(np.flatnonzero(~plain))
        words = core.take(some)
        words = (pc.utf8_lower(words) if self._word_ends else words).dictionary_encode()
        tails = _after(chunks.take(some), core.take(some)).dictionary_encode()
        for known in (self._plain, self._odd, self._marks):
            if len(known.keys) > CACHE_CHUNKS:
                known.__init__()
        # two places to a chunk in the three tables, one behind the other: word and marks, or chunk and nothing
        place = np.zeros((len(chunks), 2), dtype=np.int64)
        word_at = self._plain.places(words.dictionary, self._new_plain)[words.indices.to_numpy()]
        odd_at = self._odd.places(chunks.take(rest), self._new_odd)
        mark_at = self._marks.places(pa.concat_arrays([pa.array([""]), tails.dictionary]).unique(), self._library)
        names = {x: int(k) for x, k in zip(pa.concat_arrays([pa.array([""]), tails.dictionary]).unique().to_pylist(), mark_at, strict=True)}
        tail_at = np.array([names[x] for x in tails.dictionary.to_pylist()], dtype=np.int64)[tails.indices.to_numpy()] if len(tails) else np.empty(0, np.int64)
        odd_base, mark_base = len(self._plain.keys), len(self._plain.keys) + len(self._odd.keys)
        place[plain, 0], place[~plain, 0] = word_at, odd_base + odd_at
        place[plain, 1], place[~plain, 1] = mark_base + tail_at, mark_base + names[""]
        tables = (self._plain, self._odd, self._marks)
        ends, base = [np.zeros(1, dtype=np.int64)], 0
        for known in tables:
            ends.append(base + known.ends[1:])
            base += len(known.flat)
        ragged = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate([known.flat for known in tables])))
        both = ragged.take(pa.array(place.ravel()))
        return pa.ListArray.from_arrays(both.offsets.take(pa.array(np.arange(0, 2 * len(chunks) + 1, 2))), both.values)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text."""
        if self._word_ends:
            return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        marked = pc.replace_substring(texts, "\n", f" \n {_BARE}")
        return pc.split_pattern(pc.binary_join_element_wise(_BARE, marked, ""), " ")

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = self._cut(texts)
        words = cut.flatten().dictionary_encode()
        taken = self._look_up(words.dictionary).take(words.indices)
        starts = taken.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return taken.flatten().to_numpy(zero_copy_only=False), starts.astype(np.int64)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._word_ends:
            whole = pc.equal(pc.ascii_trim_whitespace(texts), "")
        else:
            whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _IRREGULAR))
        for token in self._added:
            whole = pc.or_(whole, pc.match_substring(texts, token, ignore_case=True))
        whole = whole.to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._regular(texts)
        parts: list[np.ndarray] = [np.empty(0, dtype="<u4")] * len(texts)
        some = np.flatnonzero(~whole)
        if len(some):
            flat, starts = self._regular(texts.take(pa.array(some)))
            for k, i in enumerate(some):
                parts[i] = flat[starts[k] : starts[k + 1]]
        rest = np.flatnonzero(whole)
        for i, ids in zip(rest, self._library(texts.take(pa.array(rest)).to_pylist()), strict=True):
            parts[i] = np.frombuffer(ids, dtype="<u4")
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)

    def encode(self, texts: pa.Array):
        """Yield (ids, starts) for consecutive runs of texts; nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
            yield self._some(pa.concat_arrays([texts.slice(at, end - at)]))
            at = end


def _after(whole: pa.StringArray, core: pa.StringArray) -> pa.StringArray:
    """What is left of each string behind its first part."""
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int32, count=len(whole) + whole.offset + 1)[whole.offset :]
    size = pc.binary_length(core).to_numpy(zero_copy_only=False)
    length = np.diff(offsets) - size
    ends = np.append(0, np.cumsum(length)).astype(np.int32)
    at = np.repeat(offsets[:-1] + size - ends[:-1], length) + np.arange(ends[-1])
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[at] if len(at) else np.empty(0, dtype=np.uint8)
    return pa.StringArray.from_buffers(len(whole), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
