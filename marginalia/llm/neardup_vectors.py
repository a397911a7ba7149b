"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine; on unit vectors that is a bound on their distance. Equal
vectors fold into one point with a weight first. A label's points are dealt into blocks of bounded
size, near points together by the signs of fixed projections; pairs of blocks whose covering radii keep
them too far apart are dropped, and each other pair is one task. There, every block has a cover tree:
levels of centres with halving radii, each level nested in the one above. The traversal goes down both
trees at once, drops a pair of nodes when the distance of their centres less both radii exceeds the
threshold, and takes all pairs below it at once when the distance plus both radii doesn't reach it. So
a dense cluster costs its points, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, roots, written

BLOCK = 2048  # points of a block
_SLACK = 1e-6  # distances are rounded; bounds that are closer than this decide nothing
_BROADCAST_ROWS = 200_000
_SALT = 16


class CoverTree:
    """Nodes over unit vectors; ``order`` lists the points so that each node has a slice of it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.children: list[list[int]] = []
        self.order = np.empty(len(vectors), dtype=np.int64)
        at = 0
        work = [(np.arange(len(vectors)), -1)]
        while work:  # depth first, so that a node's points stand together
            points, parent = work.pop()
            node = len(self.centre)
            if parent >= 0:
                self.children[parent].append(node)
            distance = self._distance(points, points[0]) if len(points) > 1 else np.zeros(1)
            self.centre.append(int(points[0]))
            self.radius.append(float(distance.max()))
            self.children.append([])
            self.start.append(at)
            if len(points) == 1 or self.radius[node] < 2 * _SLACK:
                self.radius[node] = self.radius[node] if len(points) > 1 else 0.0
                self.order[at : at + len(points)] = points
                at += len(points)
                self.stop.append(at)
                continue
            self.stop.append(at + len(points))
            half, parts = self.radius[node] / 2, []
            while len(points):
                near = distance <= half
                near[0] = True
                parts.append(points[near])
                points = points[~near]
                if len(points):
                    distance = self._distance(points, points[0])
            work += [(p, node) for p in reversed(parts)]
        self.radii = np.array(self.radius)
        self.centres = np.array(self.centre, dtype=np.int64)
        self.sizes = np.array(self.stop) - np.array(self.start)

    def _distance(self, points: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.vectors[points] @ self.vectors[to])))

    def points(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.stop[node]]


def link(left: np.ndarray, left_weight: np.ndarray, right: np.ndarray | None, right_weight: np.ndarray | None, cosine: float):
    """Links of unit vectors with a cosine of ``cosine`` or more, between two blocks or within one
    (right is None). Returns per point of both blocks, left first, the weight linked to it and the
    smallest point that it connects to."""
    same = right is None
    a = CoverTree(left)
    b = a if same else CoverTree(right)
    shift = 0 if same else len(left)
    weight = left_weight if same else np.concatenate([left_weight, right_weight])
    total = np.zeros(len(weight), dtype=np.int64)
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def take(p: np.ndarray, q: np.ndarray) -> None:
        """All pairs between the points p and the points q, which are others."""
        q = q + shift
        total[p] += weight[q].sum()
        total[q] += weight[p].sum()
        edges.append((q, np.full(len(q), p[0])))
        edges.append((p, np.full(len(p), q[0])))

    def exact(p: np.ndarray, q: np.ndarray, within: bool) -> None:
        dots = a.vectors[p] @ b.vectors[q].T
        i, j = np.nonzero(np.triu(dots >= cosine, 1) if within else dots >= cosine)
        i, j = p[i], q[j] + shift
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        edges.append((i, j))

    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        within = same and x == y
        under_x = a.children[x] or [x]
        under_y = b.children[y] or [y]
        if not a.children[x] and not b.children[y]:
            exact(a.points(x), b.points(y), within)
            continue
        nx, ny = np.array(under_x), np.array(under_y)
        dots = a.vectors[a.centres[nx]] @ b.vectors[b.centres[ny]].T
        distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))
        spread = a.radii[nx][:, None] + b.radii[ny][None, :]
        near = distance - spread <= limit + _SLACK
        if within:
            near = np.triu(near)
        single = (a.sizes[nx][:, None] == 1) & (b.sizes[ny][None, :] == 1)
        i, j = np.nonzero(near & single & (dots >= cosine))
        if within:
            i, j = i[i != j], j[i != j]
        if len(i):
            p, q = a.centres[nx[i]], b.centres[ny[j]] + shift
            np.add.at(total, p, weight[q])
            np.add.at(total, q, weight[p])
            edges.append((p, q))
        inside = distance + spread <= limit - _SLACK
        for i, j in zip(*np.nonzero(near & ~single)):
            u, v = int(nx[i]), int(ny[j])
            if within and u == v:
                if 2 * a.radius[u] <= limit - _SLACK:  # any two are within the threshold of each other
                    p = a.points(u)
                    total[p] += weight[p].sum() - weight[p]
                    edges.append((p, np.full(len(p), p[0])))
                else:
                    stack.append((u, v))
            elif inside[i, j]:
                take(a.points(u), b.points(v))
            else:
                stack.append((u, v))
    ends = [np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, dtype=np.int64) for k in (0, 1)]
    return total, roots(len(weight), *ends)


def _units(column) -> np.ndarray:
    raw = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _signs(units: np.ndarray, bits: int) -> np.ndarray:
    """Signs of ``bits`` fixed projections as one number."""
    planes = np.random.default_rng(20_011).standard_normal((64, units.shape[1]))[:bits]
    return ((units @ planes.T) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(units), dtype=np.int64)


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows; counted, not guessed."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label; other columns are not read): vec_id,
    n_links (others linked to it), component_id (smallest vec_id that links lead to), kept (whether
    that is its own).

    Vectors with equal, non-null labels and equal lengths are linked if their cosine, in double
    precision, is ``cosine`` or more. A vector that is null, empty, zero, or has null or non-finite
    components has no links. Repeated rows link with each other like other equal vectors; rows with a
    null vec_id link, but never name a component (unless all of it has null ids). An empty table gives
    no rows. The number of block pairs is quadratic in a label's blocks only as far as radii don't
    separate them. Points, links and components stay distributed.
    """
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("good", F.coalesce(good, F.lit(False)))
    folded = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    points = written(folded.select(F.monotonically_increasing_id().alias("point"), "label", F.size("embedding").alias("dim"), "embedding", "rep", "weight"), "points")

    group = ["label", "dim"]
    large = points.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*group, F.ceil(F.log2(F.col("n") / block)).cast("int").alias("bits"))
    with_bits = points.join(_small(large), group, "left").withColumn("bits", F.least(F.coalesce("bits", F.lit(0)), F.lit(40)))

    def cells(parts):
        for part in parts:
            part["cell"] = 0
            for (bits, _), own in part[part["bits"] > 0].groupby(["bits", "dim"]):
                part.loc[own.index, "cell"] = _signs(_units(own["embedding"]), int(bits))
            yield part[["point", *group, "weight", "embedding", "cell"]]

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"point bigint, label {kinds['label']}, dim int, weight bigint, embedding {kinds['embedding']}, cell bigint"
    celled = written(with_bits.select("point", *group, "weight", "embedding", "bits").mapInPandas(cells, schema), "cells")
    full = celled.groupBy(*group, "cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select(*group, "cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = celled.join(_small(full), [*group, "cell"], "left").withColumn("part", F.pmod(F.xxhash64("point"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    key = [*group, "cell", "part"]

    def ball(part: pd.DataFrame) -> pd.DataFrame:
        units = _units(part["embedding"])
        centre = units.mean(axis=0)
        radius = float(np.sqrt(((units - centre) ** 2).sum(axis=1)).max())
        return part[key].head(1).assign(centre=[centre], radius=radius)

    balls = written(dealt.groupBy(*key).applyInPandas(ball, f"label {kinds['label']}, dim int, cell bigint, part int, centre array<double>, radius double"), "balls")
    one = balls.select(*group, *(F.col(c).alias(f"{c}1") for c in ("cell", "part", "centre", "radius")), F.pmod(F.xxhash64("cell", "part"), F.lit(_SALT)).alias("salt"))
    two = balls.select(*group, *(F.col(c).alias(f"{c}2") for c in ("cell", "part", "centre", "radius")), F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(_SALT)))).alias("salt"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre1", "centre2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    ordered = (F.col("cell1") < F.col("cell2")) | ((F.col("cell1") == F.col("cell2")) & (F.col("part1") <= F.col("part2")))
    met = one.join(two, [*group, "salt"]).where(ordered).where(apart - F.col("radius1") - F.col("radius2") <= math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK)
    pairs = met.select(*group, "cell1", "part1", "cell2", "part2")
    sides = F.array(F.struct(F.col("cell1").alias("cell"), F.col("part1").alias("part"), F.lit(0).alias("side")), F.struct(F.col("cell2").alias("cell"), F.col("part2").alias("part"), F.lit(1).alias("side")))
    asked = pairs.withColumn("s", F.explode(sides)).select(*pairs.columns, "s.*").where((F.col("side") == 0) | (F.col("cell1") != F.col("cell2")) | (F.col("part1") != F.col("part2")))
    tasks = dealt.join(asked, key).select(*pairs.columns, "side", "point", "weight", "embedding")

    def dual(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "point"], ignore_index=True)
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        total, root = link(_units(left["embedding"]), left["weight"].to_numpy(), *((_units(right["embedding"]), right["weight"].to_numpy()) if len(right) else (None, None)), cosine)
        ids = part["point"].to_numpy()
        out = pd.DataFrame({"point": ids, "links": total, "root": ids[root]})
        return out[out["links"] > 0]

    found = written(tasks.groupBy(*pairs.columns).applyInPandas(dual, "point bigint, links bigint, root bigint"), "found")
    groups = components(found.where("point != root").select("point", "root"))
    summed = found.groupBy("point").agg(F.sum("links").alias("links"))
    known = points.join(summed, "point", "left").join(groups, F.col("point") == F.col("node"), "left").select("label", "embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    names = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = known.join(names, "component").select("label", "embedding", "n_links", "component_id", F.lit(True).alias("good"))
    return rows.join(named, ["label", "embedding", "good"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")
    )
