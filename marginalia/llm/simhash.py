"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits.

A fingerprint has 8 bytes. If two differ in d bits at most, they differ in d byte positions at most,
so they agree in at least 8 - d positional bytes. The inverted index has postings for every choice of
7 - d positions with the bytes found there, one position fewer than that guaranteed minimum. Where two
fingerprints meet under a posting, their shared positional bytes are tallied; pairs that reach the
minimum stay, and their bits are counted. Postings of single positions would give the same pairs, but
each of their 2048 lists would hold 1/256 of all fingerprints, while 7 - d positions leave a list a share
of 2**-40 (at d = 2). Lists that are long all the same, as those of many near copies, are split by
further positions. Only distinct fingerprints enter the index, so copies cost nothing; a posting holds at
most 256**(d + 1) of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, free, roots, slices, small, written

_SHORT = 8  # fingerprints of lists that are tallied many lists at once
_PAIRS_UP_TO = 1024  # fingerprints of a list whose pairs are tallied; longer lists are split
_MANY = 200_000  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text. A-Z count as a-z, words end at white space (x20, x09-x0D),
    shingles of ``words`` words, repeats included, are hashed by XXH64 of their UTF-8; fewer words
    make one shingle, none make 0. A bit is 1 if it is set in over half the hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        return digest(join(parts), seed)
    count = len(parts) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, count, _MANY):
        own = parts[k : min(k + _MANY, count) + words - 1]
        hashes = np.array([digest(join(s), seed) for s in zip(*(own[i:] for i in range(words)))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint of ``text`` as a signed long."""
    docs = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words, seed) for t in batch.column("_text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return docs.mapInArrow(run, schema)


def _tallied(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, i, j) of pairs in lists of one length (lists x length): their shared positional bytes
    are tallied, pairs that reach the guaranteed minimum stay, and their bits are counted."""
    i, j = np.triu_indices(fps.shape[1], 1)
    differ = np.ascontiguousarray(fps[:, i] ^ fps[:, j])
    tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2, dtype=np.int8)
    row, pair = np.nonzero(tally >= 8 - distance)
    near = np.bitwise_count(differ[row, pair]) <= distance
    return row[near], i[pair[near]], j[pair[near]]


def _verified(fps: np.ndarray, ids: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Links for a list in which every pair has reached the minimum, without looking at pairs. Two
    fingerprints d bits apart lie within d/2 of some value between them (d even), or within (d-1)/2 and
    (d+1)/2. So each names all values it can turn into by flipping up to d//2 of the free bits, and for
    odd d the exact partner is looked up; who names the same value is linked."""
    free = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [np.uint64(1 << k) for k in range(64) if int(free) >> k & 1]
    flips = [np.uint64(0)]
    for size in range(1, distance // 2 + 1):
        flips += [np.bitwise_or.reduce(np.array(c, dtype=np.uint64)) for c in combinations(bits, size)]
    named = np.concatenate([fps ^ f for f in flips])
    owner = np.tile(ids, len(flips))
    order = np.argsort(named, kind="stable")
    named, owner = named[order], owner[order]
    starts = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    head = np.repeat(owner[starts], np.diff(np.append(starts, len(named))))
    yield np.stack([owner, head])[:, owner != head]
    if distance % 2:
        rank = np.argsort(fps)
        last = (distance + 1) // 2 + distance // 2
        for size in range(distance // 2 + 1, last + 1):
            for c in combinations(bits, size):
                other = fps ^ np.bitwise_or.reduce(np.array(c, dtype=np.uint64))
                at = rank[np.minimum(np.searchsorted(fps[rank], other), len(fps) - 1)]
                hit = fps[at] == other
                yield np.stack([ids[hit], ids[at[hit]]])


def _entry_links(fps: np.ndarray, ids: np.ndarray, shared: tuple[int, ...], distance: int) -> Iterator[np.ndarray]:
    """Links that connect what linked pairs of one list connect; all of it share the bytes at ``shared``.
    A list too long for its pairs is split by every further position: a pair that reaches the minimum
    shares one of them, until the list itself has reached it."""
    if len(fps) <= _PAIRS_UP_TO:
        _, i, j = _tallied(fps[None, :], distance)
        root = roots(len(fps), i, j)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        yield np.stack([ids[moved], ids[root[moved]]])
    elif len(shared) >= 8 - distance:
        yield from _verified(fps, ids, distance)
    else:
        for p in sorted(set(range(8)) - set(shared)):
            byte = (fps >> np.uint64(8 * p)).astype(np.uint8)
            order = np.argsort(byte, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                if len(own) > 1:
                    yield from _entry_links(fps[own], ids[own], (*shared, p), distance)


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between the nodes of ``distinct``, rows (fp, node), one per fingerprint: those within
    ``distance`` bits, or fewer that connect the same nodes. ``distance`` is from 1 to 6."""
    chosen = list(combinations(range(8), 7 - distance))
    masks = [sum(0xFF << 8 * p for p in c) for c in chosen]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # a row becomes 56 entries (at distance 2), so the few rows of a partition are spread out first
    spread = distinct.repartition(max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    entries = (
        spread.select("fp", "node", F.explode(F.array([F.struct(F.lit(k).cast("tinyint").alias("positions"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for k, m in enumerate(signed)])).alias("entry"))
        .groupBy("entry.positions", "entry.bytes")
        .agg(F.collect_list(F.struct("fp", "node")).alias("listed"))
        .where(F.size("listed") > 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, positions = batch.column("listed"), batch.column("positions").to_numpy()
            flat = lists.flatten()
            fps, ids = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            fps = fps.view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            sizes = np.diff(lists.offsets.to_numpy())
            out = [np.zeros((2, 0), dtype=np.int64)]
            for size in np.unique(sizes).tolist():
                own = starts[sizes == size]
                if size <= _SHORT:  # most lists: all of one length at once
                    at = own[:, None] + np.arange(size)
                    row, i, j = _tallied(fps[at], distance)
                    out.append(np.stack([ids[at[row, i]], ids[at[row, j]]]))
                else:
                    for s, k in zip(own.tolist(), positions[sizes == size].tolist()):
                        out += _entry_links(fps[s : s + size], ids[s : s + size], chosen[k], distance)
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return entries.select("positions", "listed").mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Near-duplicate groups: one row per document with the columns ``keep``, ``fp``, ``group`` (any
    number of its group) and ``component_id``, the smallest doc_id that links lead to, its own included.

    Nulls: a null text is empty, empty texts have fingerprint 0 and link like any other; a null
    doc_id gets the group of its fingerprint but never names one (null if all there are null).
    Repeated rows each get a row; an empty table gives none. No document or fingerprint reaches the
    driver: fingerprints are written, copies fold into one node before the index, and
    adaptive execution splits the last join where a fingerprint is frequent.
    """
    found = written(fingerprints(docs, words, seed, keep), "simhash")
    folded = found.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = written(folded.select("fp", "rep", F.monotonically_increasing_id().alias("node")), "distinct")
    linked = components(links(distinct.select("fp", "node"), distance))
    grouped = written(distinct.join(linked, "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("group")), "groups")
    names = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    return found.join(grouped.select("fp", "group").join(names, "group"), "fp")


def deduplicate(docs: DataFrame, grouped=groups, **options) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each near-duplicate group: that with the
    group's smallest doc_id, or where several of its texts share that, with the least hash. Rows that
    repeat a document are one; a document without an id stays only if its whole group has none.
    Groups are those of ``grouped``. Texts stay where they are but for rows that repeat a document, as
    long as the keys of what leaves are few enough to be sent to every task."""
    names = {"_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "_hash": F.xxhash64("text")}
    found = grouped(docs.select("doc_id", "text", *(c.alias(k) for k, c in names.items())), keep=("doc_id", "_key", "_hash"), **options)
    times = found.groupBy("group", "_key", "_hash").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "_key", "_hash")).alias("o"))
    least = times.groupBy("group").agg(F.min("o").alias("f"))
    key, sign = (free(k, docs.columns) for k in names)
    leaving = times.join(least, "group").where("o != f OR n > 1").select(F.col("_key").alias(key), F.col("_hash").alias(sign), (F.col("o") == F.col("f")).alias("stays"))
    leaving = written(leaving, "leaving")
    keyed = docs.withColumns({key: names["_key"], sign: names["_hash"]})
    once = keyed.join(small(leaving), [key, sign], "left_anti")
    repeated = keyed.join(small(leaving.where("stays").select(key, sign)), [key, sign], "left_semi").dropDuplicates([key, sign])
    return once.union(repeated).select([F.col(f"`{c}`") for c in docs.columns])
