"""Resampling of documents towards a target distribution, by hashed features.

A document's features are its runs of words, each in one of BUCKETS buckets. The counts of all documents are a
sparse matrix (documents by buckets), written once as compressed sparse rows, a block for each batch of
documents. Its column sums, and those of the target's texts, give the two distributions; a bucket's gain is
the logarithm of their ratio. A product of the blocks with the vector of gains gives the documents'
weights, and Gumbel noise keyed by doc_id turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import slices, written

BUCKETS = 10_000
_FLUSH = 300_000  # features whose buckets a task remembers
_BLOCK = "doc_id array<string>, words array<bigint>, ends array<bigint>, bucket array<smallint>, n array<int>"

#: A-Z as a-z, and every byte that is in no word as a blank.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters and what is beyond ASCII, A-Z as a-z."""
    return (text or b"").translate(_BYTES).split()


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < _FLUSH:
            self[feature] = found
        return found


def _buckets(parts: list[bytes], longest: int, known: _Buckets) -> np.ndarray:
    """The bucket of each run of 1 to ``longest`` words."""
    out = [np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts))]
    for size in range(2, longest + 1):
        runs = list(map(b" ".join, zip(*(parts[k:] for k in range(size)))))
        out.append(np.fromiter(map(known.__getitem__, runs), dtype=np.int64, count=len(runs)))
    return np.concatenate(out)


def count_matrix(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``texts`` (doc_id as string, text) as blocks of compressed sparse rows: doc_id and words (numbers
    of words) a document, ends (where a document's entries end), and each entry's bucket and count."""
    if buckets > 1 << 15:
        raise ValueError("buckets are stored as 16-bit numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in slices(batches):
            sizes, ends, at, times = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                parts = words(text.as_py())
                found, n = np.unique(_buckets(parts, longest, known), return_counts=True)
                sizes.append(len(parts))
                ends.append(len(found))
                at.append(found)
                times.append(n)
            row = [batch.column(0).to_pylist(), sizes, np.cumsum(ends), np.concatenate(at).astype(np.int16), np.concatenate(times).astype(np.int32)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int16(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in zip(row, kinds)], names=["doc_id", "words", "ends", "bucket", "n"])

    return texts.mapInArrow(run, _BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of all documents in each bucket; a task passes on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at, n = (batch.column(c)[k].values.to_numpy() for c in ("bucket", "n"))
                total += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)  # below 2^53 in a block
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in blocks.select("bucket", "n").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the source's), each with one more in every bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: str | None, seed: int) -> int:
    """floor(1000 x a Gumbel variable), a function of the seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(blocks: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id string, words, n_features, weight, score) of every document: the product of the blocks with the
    gains, over each document's number of features, rounded down."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    names = ["doc_id", "words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = (batch.column(c)[k].values for c in ("doc_id", "words"))
                ends, at, n = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("ends", "bucket", "n"))
                starts = np.append(0, ends[:-1])
                total, product = (np.append(0, np.cumsum(x)) for x in (n, n * own[at]))
                features = total[ends] - total[starts]
                weight = (product[ends] - product[starts]) // np.maximum(features, 1)
                score = weight + np.fromiter((noise(d, seed) for d in ids.to_pylist()), dtype=np.int64, count=len(ids))
                yield pa.RecordBatch.from_arrays([ids, sizes, *map(pa.array, (features, weight, score))], names=names)

    return blocks.mapInArrow(run, "doc_id string, words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every document's weight and score, and its rank if it is drawn.

    ``docs`` has doc_id and text, ``target`` has text; other columns are not read. Of the N documents with
    at least ``least_words`` words, floor(percent N / 100) are drawn: those of the highest scores, ties to
    smaller doc_ids. Returns doc_id, n_features, weight, score and rank (1, 2, 3 ... of those drawn, else null).
    Null and empty texts have no features and weight 0; a null doc_id has the noise of an empty one and comes
    before all others in ties. Repeated rows count each, and each has a row and, if drawn, a rank. An empty
    table gives no rows; with an empty target every bucket's target count is 0.

    Texts are read once each. Buckets and scores are what reaches the driver: scores are whole numbers
    within a few ten thousand, so the count of documents by score, which says which scores are drawn and how
    many documents come before each, is a small table at any number of documents.
    """
    kind = docs.schema["doc_id"].dataType
    blocks = written(count_matrix(docs.select(F.col("doc_id").cast("string"), "text"), longest, buckets), "counts")
    t = column_sums(count_matrix(target.select(F.lit(None).cast("string").alias("doc_id"), "text"), longest, buckets), buckets)
    found = written(weigh(blocks, gains(column_sums(blocks, buckets), t), seed).withColumn("doc_id", F.col("doc_id").cast(kind)), "weights")
    by_score = found.where(F.col("words") >= least_words).groupBy("score").count().toArrow()
    score, count = (by_score.column(c).to_numpy() for c in ("score", "count"))
    order = np.argsort(-score)
    score, count = score[order], count[order]
    before = np.cumsum(count) - count
    most = percent * int(count.sum()) // 100
    some = before < most
    least = int(score[some].min()) if some.any() else None
    unranked = found.withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if least is None:
        return unranked.select(columns)
    high = (F.col("words") >= least_words) & (F.col("score") >= least)
    starts = found.sparkSession.createDataFrame(list(zip(score[some].tolist(), before[some].tolist())), "score bigint, _before bigint")
    placed = found.where(high).withColumn("_own", F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))).join(F.broadcast(starts), "score")
    rank = F.col("_before") + F.col("_own")
    return placed.withColumn("rank", F.when(rank <= most, rank)).select(columns).union(unranked.where(~high).select(columns))
