"""Word-wise BPE encoding and decoding with contiguous rank arrays.

A vocabulary file of merges with an end-of-word mark: text is put into its normal form, split into words,
and each word's bytes are merged on their own. A short word holds the boundaries of its parts and the rank
of every pair of neighbours in two contiguous arrays; the least rank is found by a scan, its boundary is
deleted, and the ranks beside it are looked up again. Words of one length are scanned side by side in numpy.
Scans are quadratic in a word, so words over SHORT bytes keep linked parts and a heap of pairs instead, with
the same merges in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from marginalia.llm.common import slices

SHORT = 128  # bytes of a word that is merged by scans
_SIDE = 4096  # words that are scanned side by side
_KEEP = 300_000  # words that a worker remembers
_KEEP_CHARS = 64  # of a word that is remembered
_SHIFT = 20  # bits of a token id
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 60  # the rank of neighbours that don't merge
_LAST = 0x17F
#: These have no marks to compose, one lower case wherever they stand, and the same blanks in all engines.
_PLAIN = re.compile(f"[\\x00-\\x1B\\x20-{chr(_LAST)}]*+")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself if it is a visible Latin-1 character, or
    else one of those from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def plain_pattern(pattern: str) -> str:
    """A pattern with the plain characters of its Unicode classes written out, for the faster engine."""

    def ranges(found: re.Match) -> str:
        inside = regex.compile(found[0])
        codes = [c for c in range(_LAST + 1) if inside.match(chr(c))]
        starts = [c for c in codes if c - 1 not in codes]
        ends = [c for c in codes if c + 1 not in codes]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))

    return re.sub(r"\\p\{\w+\}", ranges, pattern)


class WordBpe:
    """Encoder and decoder for a vocabulary file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not mark or model.get("continuing_subword_prefix") or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} isn't a vocabulary of merges with an end-of-word mark")
        vocabulary = model["vocab"]
        self.pairs: dict[int, int] = {}  # both ids to the rank, and the id that they become in its last bits
        for rank, (left, right) in enumerate(model["merges"]):
            self.pairs.setdefault(vocabulary[left] << _SHIFT | vocabulary[right], rank << _SHIFT | vocabulary[left + right])
        signs = byte_signs()
        self._inner, self._last = (np.array([vocabulary[s + end] for s in signs]) for end in ("", mark))
        self._keys = np.array(sorted(self.pairs), dtype=np.int64)
        self._values = np.array([self.pairs[k] for k in self._keys.tolist()], dtype=np.int64)
        self.find = re.compile(plain_pattern(split["pattern"]["Regex"])).findall
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer[0].pre_tokenize_str
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.tokens = {i: t.encode() for t, i in vocabulary.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.known: dict[str, bytes] = {}

    # -- words -----------------------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right  # below 0 where there is no part on the right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._values[at], _NONE)

    def _scanned(self, words: list[bytes]) -> list[bytes]:
        """Merges words of one length by scans. ``bounds`` has where each part of a word starts, and then its
        length; ``ids`` has a part's id where it starts; ``ranks`` has in column k the rank of the parts k and k + 1."""
        wide, n = len(words[0]), len(words)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(n, wide)
        ids = np.full((n, wide + 1), -1, dtype=np.int64)
        ids[:, : wide - 1], ids[:, wide - 1] = self._inner[raw[:, :-1]], self._last[raw[:, -1]]
        columns, live = np.arange(wide + 1), np.arange(n)
        bounds = np.tile(columns, (n, 1))
        ranks = self._look_up(ids[:, :-1], ids[:, 1:])
        while True:
            k = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), k]
            go = least != _NONE
            if not go.any():
                break
            if not go.all():
                live, bounds, ranks, k, least = (x[go] for x in (live, bounds, ranks, k, least))
            row, new, at = np.arange(len(live)), least & _MASK, k[:, None]
            ids[live, bounds[row, k]] = new
            ids[live, bounds[row, k + 1]] = -1
            bounds = np.take_along_axis(bounds, np.minimum(columns + (columns > at), wide), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] >= at), wide - 1), axis=1)
            ranks[row, k] = self._look_up(new, ids[live, bounds[row, k + 1]])
            row = np.flatnonzero(k)
            ranks[row, k[row] - 1] = self._look_up(ids[live[row], bounds[row, k[row] - 1]], new[row])
        there = ids >= 0
        data = ids[there].astype("<u4").tobytes()
        ends = (np.cumsum(there.sum(axis=1)) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _heaped(self, ids: list[int]) -> list[int]:
        """The same merges for long words: pairs in a heap by rank, then place; those that are gone by the
        time they come up are passed over."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: get(ids[a] << _SHIFT | ids[b], _NONE)
        heap = [(r, k) for k in range(n - 1) if (r := rank(k, k + 1)) != _NONE]
        heapq.heapify(heap)
        while heap:
            least, k = heapq.heappop(heap)
            gone = after[k]
            if ids[k] < 0 or gone >= n or rank(k, gone) != least:
                continue
            ids[k], ids[gone] = least & _MASK, -1
            after[k] = to = after[gone]
            if to < n:
                before[to] = k
            for a, b in ((before[k], k), (k, to)):
                if a >= 0 and b < n and (r := rank(a, b)) != _NONE:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                out[word] = np.array(self._heaped([*self._inner[list(raw[:-1])].tolist(), int(self._last[raw[-1]])]), dtype="<u4").tobytes()
            else:
                by_size.setdefault(len(raw), []).append((word, raw))
        for group in by_size.values():
            for k in range(0, len(group), _SIDE):
                part = group[k : k + _SIDE]
                out.update(zip((w for w, _ in part), self._scanned([raw for _, raw in part])))
        return out

    # -- texts -----------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens: in normal form (composed, lower case letter by letter),
        split by the file's pattern. Texts beyond the plain letters take the library's own tables, so that no
        two versions of Unicode meet."""
        return self.find(text.lower()) if _PLAIN.fullmatch(text) else [w for w, _ in self._split(self._normal(text))]

    def encode_batch(self, texts: list[str], added: bool = True) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; the file's added tokens are found in
        a text as it stands, unless ``added`` is False."""
        if len(self.known) > _KEEP:
            self.known.clear()
        known, split = self.known, []
        for text in texts:  # lists of words, and added tokens between them
            parts = self._added.split(text) if added and self._added and "<" in text else [text]
            split.append([p if k % 2 else self.words(p) for k, p in enumerate(parts)])
        fresh = self.encode_words(set().union(*(p for own in split for p in own[::2])).difference(known))
        known.update(fresh)
        get, join = known.__getitem__, b"".join
        out = [join([self.added[p] if k % 2 else join(map(get, p)) for k, p in enumerate(own)]) for own in split]
        for word in fresh:
            if len(word) > _KEEP_CHARS:
                del known[word]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that ids give: the file names no decoder, so that is their tokens with a space
        between; ids without a token give nothing."""
        return b" ".join([t for t in map(self.tokens.get, ids) if t is not None])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The encoder of a vocabulary file, kept by each worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes the column ``text`` of every row and decodes the ids again.

    Adds to the rows' columns (those of the same names are replaced): ``ids`` (array<int>, unless with_ids is
    False), ``n_tokens`` (long), ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the decoded text in UTF-8). Null texts count as empty: no ids, the digests of no
    bytes. Texts of any length go through whole; repeated rows each get their own result; an empty table
    gives an empty table. One pass without a shuffle; a worker holds a batch and a bounded memo.
    """
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    docs = docs.select([c for c in docs.columns if c not in new and c != "ids"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *["ids array<int>"] * with_ids, "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])
    place, names = docs.columns.index(text), [*docs.columns, *["ids"] * with_ids, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            raw = bpe.encode_batch([t or "" for t in batch.column(place).to_pylist()])
            back = [digest(bpe.decode_bytes(np.frombuffer(x, dtype="<u4").tolist())) for x in raw]
            arrays = list(batch.columns)
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))))
            arrays += [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(list(map(digest, raw)), pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)
