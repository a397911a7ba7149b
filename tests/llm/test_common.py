import random

import pytest

from marginalia.llm.common import components


def brute(links):
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    while True:
        before = dict(root)
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def random_links(seed):
    rng = random.Random(seed)
    return [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]


@pytest.mark.parametrize("part", [16, 1 << 20])
@pytest.mark.parametrize(
    "links",
    [
        [],
        [(5, 5)],
        [(k, k + 1) for k in range(100)],
        [(100 - k, 99 - k) for k in range(60)],
        [(7, k) for k in range(90)] + [(-3, 7), (7, -3), (7, 8)],
        random_links(1),
        [(a << 40, b << 40) for a, b in random_links(2)],
    ],
)
def test_components(spark, links, part):
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    rows = [(r.node, r.component) for r in components(frame, part=part).collect()]
    assert len(rows) == len(set(rows))
    assert dict(rows) == brute(links)
