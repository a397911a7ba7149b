"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaves of the tree stand for the bytes of a piece; a leaf holds ``rank * leaves + position``
of the pair that starts there, so the root is the leftmost pair of the least rank. A merge changes
three leaves at most (the merged token, its left neighbour, the swallowed one), and each change
climbs one path to the root. Short pieces go through the tree side by side in numpy, one tree a
row; long pieces have a tree of their own, so a piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marginalia.llm.common import slices

_FREE = np.int32(2**31 - 1)  # a leaf or node without a pair
_SHIFT = 20  # bits of a token id in a pair's key
_SIDE = 64  # pieces of up to so many bytes go side by side
_KEEP = 300_000  # pieces that a worker remembers
_KEEP_CHARS = 64  # of a piece that is remembered


class ByteBpe:
    """Encoder and decoder for a rank file: token bytes by rank, a token's id being its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.pairs = pairs
        self._table(pairs)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    # -- merging ---------------------------------------------------------------------------

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing over the pairs' keys, for lookups of whole arrays."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self._down, slots = np.uint64(64 - bits), 1 << bits
        self._slots = np.full(slots + 64, -1, dtype=np.int64)
        self._rank_at = np.zeros(slots + 64, dtype=np.int32)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        spot = self._spot(keys)
        while len(keys):
            free = self._slots[spot] < 0
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(np.where(free, spot, -1), return_index=True)[1]] = True
            put = free & first
            self._slots[spot[put]], self._rank_at[spot[put]] = keys[put], ranks[put]
            keys, ranks, spot = keys[~put], ranks[~put], spot[~put] + 1

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._down).astype(np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        """Leaf values of the pairs (left, right) that start at ``at``; ids below 0 have no pair."""
        key = (left << _SHIFT) | right  # below 0 if an id is, so found nowhere
        key[right < 0] = -2
        spot = self._spot(key)
        there = self._slots[spot]
        value = np.where(there == key, self._rank_at[spot] * leaves + at, _FREE)
        off = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(off):
            spot[off] += 1
            there = self._slots[spot[off]]
            hit = off[there == key[off]]
            value[hit] = self._rank_at[spot[hit]] * leaves + at[hit]
            off = off[(there != key[off]) & (there >= 0)]
        return value

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most _SIDE bytes, all in one array of trees."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        leaves = 1 << max(1, int(sizes.max() - 1).bit_length())
        n, wide = len(pieces), leaves + 2  # position p stands in column p + 1, between two borders
        padded = b"".join([p.ljust(leaves, b"\0") for p in pieces])
        out = np.full((n, wide), -1, dtype=np.int64)
        inside = np.arange(leaves) < sizes[:, None]
        out[:, 1:-1] = np.where(inside, self.byte_ids[np.frombuffer(padded, dtype=np.uint8).reshape(n, leaves)], -1)
        trees = np.full((n, 2 * leaves), _FREE, dtype=np.int32)
        at = np.tile(np.arange(leaves), n)
        trees[:, leaves:] = self._leaf(out[:, 1:-1].ravel(), out[:, 2:].ravel(), at, leaves).reshape(n, leaves)
        width = leaves
        while width > 1:
            trees[:, width // 2 : width] = np.minimum(trees[:, width : 2 * width : 2], trees[:, width + 1 : 2 * width : 2])
            width //= 2
        ids, tree = out.ravel(), trees.ravel()
        after, before = (np.tile(np.arange(wide) + step, n) for step in (1, -1))
        live = np.arange(n)
        while True:
            best = tree[live * 2 * leaves + 1]
            live = live[best < _FREE]
            if not len(live):
                break
            best = best[best < _FREE].astype(np.int64)
            row, root = live * wide, live * 2 * leaves
            rank = best // leaves
            here = best - rank * leaves + 1
            gone = after[row + here]
            following, left = after[row + gone], before[row + here]
            ids[row + here], ids[row + gone] = rank, -1
            after[row + here] = following
            before[row + following] = here
            here_leaf = self._leaf(rank, ids[row + following], here - 1, leaves)
            left_leaf = self._leaf(ids[row + left], rank, left - 1, leaves)
            tree[root + leaves + gone - 1] = _FREE
            tree[root + leaves + here - 1] = here_leaf
            has = left > 0
            some = root[has]
            tree[some + leaves + left[has] - 1] = left_leaf[has]
            for base, spot in ((root, gone), (root, here), (some, left[has])):
                node = (leaves + spot - 1) >> 1
                while node[0] if len(node) else 0:
                    under = base + 2 * node
                    tree[base + node] = np.minimum(tree[under], tree[under + 1])
                    node >>= 1
        flat = out[:, 1:-1]
        there = flat >= 0
        counts = there.sum(axis=1)
        data = flat[there].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        starts = ends - counts * 4
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _alone(self, piece: bytes) -> bytes:
        """A long piece with a tree of its own."""
        size, pairs = len(piece), self.pairs
        leaves = 1 << max(1, (size - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        free = 1 << 62

        def leaf(at: int) -> int:
            to = after[at]
            rank = pairs.get(ids[at] << _SHIFT | ids[to]) if to < size else None
            return free if rank is None else rank * leaves + at

        tree = [free] * (2 * leaves)
        tree[leaves : leaves + size] = [leaf(i) for i in range(size)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < free:
            rank, here = divmod(tree[1], leaves)
            gone = after[here]
            ids[here], ids[gone] = rank, -1
            after[here] = to = after[gone]
            if to < size:
                before[to] = here
            put(gone, free)
            put(here, leaf(here))
            if before[here] >= 0:
                put(before[here], leaf(before[here]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > _SIDE:
                out[piece] = self._alone(raw)
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_size.values():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                out.update(zip((p for p, _ in part), self._side_by_side([raw for _, raw in part])))
        return out

    # -- texts -----------------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self.known) > _KEEP:
            self.known.clear()
        known = self.known
        split = [self.find(t) for t in texts]
        missing = {p for pieces in split for p in pieces if p not in known}
        fresh = self.encode_pieces(missing) if missing else {}
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= _KEEP_CHARS)
        return [b"".join([known.get(p) or fresh[p] for p in pieces]) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids, dtype=np.int64).tolist()))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, kept by each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes the column ``text`` of every row and decodes the ids again.

    Adds to the rows' columns (a column of the same name is replaced): ``ids`` (array<int>, unless
    with_ids is False), ``n_tokens`` (long), ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256``
    (of the bytes that decoding gives). Null texts count as empty: no ids, the digest of no bytes.
    Texts of any length go through whole; repeated rows each get their own result; an empty table
    gives an empty table. One pass without a shuffle; a worker holds a batch and a bounded memo.
    """
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    rest = [c for c in docs.columns if c not in new and c != "ids"]
    docs = docs.select(rest)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *["ids array<int>"] * with_ids, "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in slices(batches):
            ids = bpe.encode_batch([t or "" for t in batch.column(text).to_pylist()])
            arrays, names = list(batch.columns), list(batch.schema.names)
            if with_ids:
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            back = (bpe.decode_bytes(np.frombuffer(x, dtype="<u4")) for x in ids)
            arrays += [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names + list(new))

    return docs.mapInArrow(run, schema)
