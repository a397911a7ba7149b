import math
import random

import numpy as np
import pytest
from marginalia.llm import neardup_vectors, queries


def brute(rows, cosine=0.93):
    """vec_id -> (links, component) by comparing all pairs; ids are distinct."""
    good = [(i, label, np.array(v, dtype=float)) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, p, a) in enumerate(good):
        for j, q, b in good[k + 1 :]:
            if p == q and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (links[i], root(i)) for i, _, _ in rows}


def clusters(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    out = centres[rng.integers(0, 4, n)] + spread * rng.standard_normal((n, dim))
    out[rng.integers(0, n, n // 5)] = out[0]
    return out


@pytest.mark.parametrize("seed, n, dim, spread", [(1, 60, 2, 0.3), (2, 80, 8, 0.2), (3, 80, 64, 1.0), (4, 200, 16, 0.05), (5, 1, 3, 1.0)])
@pytest.mark.parametrize("within", [True, False])
def test_trees_against_all_pairs(seed, n, dim, spread, within):
    x = neardup_vectors._units(clusters(seed, n, dim, spread))
    w = np.random.default_rng(seed).integers(1, 5, n)
    y, v = (None, None) if within else (neardup_vectors._units(clusters(seed + 50, n + 3, dim, spread)), np.ones(n + 3, dtype=np.int64))
    if y is not None:
        y[: n // 2] = x[: n // 2]
    total, root = neardup_vectors.link(x, w, y, v, 0.93)
    whole, weight = (x, w) if within else (np.vstack([x, y]), np.concatenate([w, v]))
    near = whole @ whole.T >= 0.93
    np.fill_diagonal(near, False)
    if not within:
        near[:n, :n] = near[n:, n:] = False
    assert (total == near @ weight).all()
    label = np.arange(len(whole))
    for _ in range(len(whole)):
        label = np.minimum(label, np.where(near, label[None, :], len(whole)).min(axis=1, initial=len(whole)))
    assert (root == label).all()


def test_tree_is_nested_with_halving_radii():
    tree = neardup_vectors.CoverTree(neardup_vectors._units(clusters(9, 300, 5, 0.3)))
    assert sorted(tree.order) == list(range(300))
    for node, under in enumerate(tree.children):
        if under:
            assert [tree.start[node], tree.stop[node]] == [tree.start[under[0]], tree.stop[under[-1]]]
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in under)


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    found = queries.QUERIES["op3_neardup_vectors"](spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_small_blocks_and_edges(spark):
    rng = random.Random(7)
    dense = clusters(11, 120, 6, 0.1)
    rows = [(k, [float(x) for x in v], rng.choice([1, 1, 1, 2])) for k, v in enumerate(dense)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 6, 1), (204, [float("inf")] + [0.0] * 5, 1), (205, rows[0][1], None), (206, [], 1), (207, [1e200] * 6, 1), (208, [1e-200] * 6, 1), (209, [1.0] * 5, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, point string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(frame, block=16).collect()}
    want = brute([(i, v if v is None or i not in (207, 208) else [1.0] * 6, label) for i, v, label in rows])
    assert found == want
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (7, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(frame).collect()), key=str)
    assert out == [(3, 2, 3), (3, 2, 3), (7, 0, 7), (None, 2, 3)]
