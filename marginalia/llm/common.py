"""What the text operators share: shared storage, lineage cuts, batches, names, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import shared_dir, written

__all__ = ["components", "free", "roots", "shared_dir", "slices", "small", "written"]

#: Rows that a task turns into Python objects at once, and bytes; Arrow batches are bounded in bytes by Spark itself.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
BROADCAST_ROWS = 200_000
#: Links that a task turns into stars in one go; 16 bytes each.
PART_LINKS = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most BATCH_ROWS rows, and about BATCH_BYTES bytes or a single row."""
    for batch in batches:
        each = max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))
        size = min(BATCH_ROWS, each)
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until it is none of ``taken`` (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def small(rows: DataFrame) -> DataFrame:
    """To be broadcast if it has BROADCAST_ROWS rows of a few numbers at most; counted, not guessed. More rows
    meet the other side in a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that links (a, b) lead each of them to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, was, root)
        root = root[root]
        if (root == was).all():
            return root


def stars(links: pa.Table) -> pa.Table:
    """Links (hi, lo) from every node to the smallest that ``links`` (hi, lo) lead it to, but for that itself."""
    hi, lo = (links.column(c).to_numpy() for c in ("hi", "lo"))
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    root = roots(len(nodes), at[: len(hi)], at[len(hi) :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table([nodes[moved], nodes[root[moved]]], names=["hi", "lo"])


def _contracted(links: DataFrame, tasks: int, part: int) -> DataFrame:
    """``links`` (hi, lo), each task's share in its own stars, about ``part`` links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * part:  # nothing is left out: what is too much for one go makes several stars
                yield from stars(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if held:
            yield from stars(pa.Table.from_batches(held)).to_batches()

    return links.coalesce(tasks).mapInArrow(run, "hi bigint, lo bigint")


def components(links: DataFrame, rounds: int = 60, part: int = PART_LINKS) -> DataFrame:
    """Connected components of ``links`` (two columns of longs): rows (node, component), where
    component is the smallest node reachable. Nodes without links are absent.

    Tasks of about ``part`` links each replace their links by stars first. If one task has them all,
    these are the components. Otherwise alternating large-star and small-star steps follow: each keeps
    one link a node at most in the end, needs equi-joins and min() only, and takes a number of rounds
    logarithmic in the longest path. Minima are combined before the shuffle; adaptive execution splits
    joins at hot nodes. Each round is written to the shared folder. The rounds end when one has changed
    no link: as many are left, and none is new. Nothing but that number reaches the driver.
    """
    a, b = links.columns
    now = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), "links")
    left = now.count()
    for _ in range(rounds):
        if not left:
            break
        tasks = -(-left // part)
        now = written(_contracted(now, tasks, part), "links")
        if tasks == 1:
            break
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").where("y != m").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        least2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least2, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(small.union(least2.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        was, left = now.count(), after.count()
        before, now = now, after
        if was == left and after.join(before, ["hi", "lo"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(ends)
