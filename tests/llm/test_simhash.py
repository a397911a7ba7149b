import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from marginalia.llm import queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, distance=2):
    """doc -> smallest doc reachable, by comparing all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "One two THREE", "a b c d", "Ä É ſ K a b\x0bc\x1cd", "a " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    monkeypatch.setattr(simhash, "_MANY", 64)
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("size", [5, 400])
def test_links_connect_what_pairs_connect(spark, distance, size):
    rng = random.Random(size + distance)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {}
    while len(set(fps.values())) < size:
        value = rng.choice(base)
        low = rng.choice([0, 16])
        for _ in range(rng.randint(0, 9)):
            value ^= 1 << low + rng.randrange(16)
        fps.setdefault(value, len(fps))
    ids = {i: v for v, i in fps.items()}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in ids.items()], "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.links(frame, distance)).collect()}
    assert {i: found.get(i, i) for i in ids} == grouped(ids, distance)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    want = grouped(fps)
    rows = queries.QUERIES["op5_simhash"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_frame_edges(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (5, None, 2), (4, "", 3), (None, "a b c d", 4), (None, "z", 5), (9, "q " * 50_000, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    found = defaultdict(list)
    for r in simhash.groups(frame).collect():
        found[r.doc_id].append(r.component_id)
    assert sorted(found[1]) == [1, 1] and found[5] == [4] and found[4] == [4] and found[9] == [9]
    assert sorted(found[None], key=str) == [1, None]
    assert simhash.groups(frame.limit(0)).count() == 0
