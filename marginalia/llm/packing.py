"""Best-fit packing of token sequences, planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the plan needs no documents, only how many pieces
have each length: ``capacity`` numbers, whatever the size of the corpus. Pieces above a third of the
capacity share a sequence with at most one more of their kind; a greedy matching pairs the longest
with the longest that still fits. All shorter pieces then go, longest first, into the smallest
remaining gap that holds them. Equal steps are taken for all sequences of a kind at once, so the plan
has a few rows for each length. Pieces find their place by their number among those of their length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import slices, written


def _byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """texts -> list of id lists, equal to ``tokenizers`` with this byte-level BPE file and
    add_special_tokens=False (special tokens written out in a text count as such there too). The
    library's merging takes n log n steps for a piece of n bytes, so texts of any length go the same way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, special = _byte_of_char(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [library.encode(t, allowed_special="all") for t in texts]


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where pieces go: ``counts`` pieces of each length, sequences of ``capacity`` tokens.

    Returns sorted keys ``length << 44 | first number``, the rows (first number, first sequence,
    pieces of this length in a sequence, offset) that belong to them, and the number of sequences.
    """
    left = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be between 1 and the capacity")
    gaps: dict[int, list[list]] = {}  # gap -> [number of sequences, ((length, pieces), ...)]
    order: list[int] = []

    def put(gap: int, number: int, items: tuple) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append([number, items])

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            k = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while k >= 0 and not (left[large[k]] - (large[k] == length)):
                k -= 1
            if k < 0:
                put(capacity - length, left[length], ((length, 1),))
                left[length] = 0
            elif large[k] == length:
                put(capacity - 2 * length, left[length] // 2, ((length, 2),))
                left[length] %= 2
            else:
                other = large[k]
                number = min(left[length], left[other])
                put(capacity - length - other, number, ((length, 1), (other, 1)))
                left[length] -= number
                left[other] -= number
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        rest = left[length]
        while rest:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                if rest >= each:
                    put(capacity - each * length, rest // each, ((length, each),))
                rest %= each
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            gap = order[k]
            kinds = gaps[gap]
            number, items = kinds.pop()
            if not kinds:
                del gaps[gap]
                order.pop(k)
            placed = min(rest, number)
            if placed < number:
                put(gap, number - placed, items)
            last = items[-1]
            items = items[:-1] + ((length, last[1] + 1),) if last[0] == length else items + ((length, 1),)
            put(gap - length, placed, items)
            rest -= placed

    taken: dict[int, int] = {}
    rows, sequences = [], 0
    for gap in order:
        for number, items in gaps[gap]:
            offset = 0
            for length, each in items:
                first = taken.get(length, 0)
                rows.append((length << 44 | first, first, sequences, each, offset))
                taken[length] = first + number * each
                offset += each * length
            sequences += number
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return table[:, 0].copy(), table[:, 1:].copy(), sequences


def cut(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, and ids if asked
    for, then part and number, which tell the pieces of one length apart."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"] + ["ids"] * with_ids
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                ids.append(end)
                start, piece = 0, 0
                stop = len(ids) % capacity or capacity
                raw = np.array(ids, dtype="<u4")
                while start < len(ids):
                    own = raw[start:stop]
                    out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)], own.tolist() if with_ids else None))
                    seen[len(own)] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens, as few as best fit finds.

    ``docs`` has doc_id and text; other columns are not read. A document is its ids, then ``end``; a
    null text has no ids of its own. Longer ones are cut into pieces of ``capacity``, the first of
    which is what is left over. Returns per piece doc_id, piece, start, length, ids_crc32 (and ids if
    with_ids), sequence_id, offset. Pieces of a sequence stand side by side from offset 0. Repeated
    rows are packed each; rows with a null doc_id too; an empty table gives no rows. Ties between
    pieces of one length are broken by their place in the input.

    The pieces are written once. Counts by (length, part) give each piece its number among all of its
    length, without bringing a length together, so a length that holds a third of all pieces needs no
    large task. The driver sees one count per length; the plan that tasks get is a few rows per length.
    """
    pieces = written(cut(docs, path, pattern, capacity, end, with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    keys, rows, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)

    placed = pieces.join(starts, ["length", "part"]).withColumn("number", F.col("number") + F.col("earlier")).drop("part", "earlier")
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in shown), "sequence_id bigint", "offset bigint"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = rows[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            ahead = number - row[:, 0]
            sequence, offset = row[:, 1] + ahead // row[:, 2], row[:, 3] + ahead % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), pa.array(sequence), pa.array(offset)], names=[*shown, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema)
