import hashlib
import math
import struct

import numpy as np
import xxhash
from marginalia.llm import multiset, queries
from pyspark.sql import functions as F


def edited(texts):
    order = sorted(texts)
    out = {}
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 4
        out[i] = text[: len(text) - cut] + following[:cut]
    return out


def lanes_of(text):
    """The lanes of a text, one paragraph and one shingle at a time."""
    out = np.zeros(multiset.LANES, dtype=object)
    for paragraph in (text or "").split("\n"):
        for k in range(multiset.EQUAL // 2):
            h = xxhash.xxh64_intdigest(paragraph.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
            out[2 * k] += h & 0xFFFFFFFF
            out[2 * k + 1] += h >> 32
        words = paragraph.split(" ")
        for k in range(len(words)):
            h = 42
            for w in words[k : k + 3]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            out[multiset.EQUAL] += 1
            for b in range(64):
                out[multiset.EQUAL + 1 + b] += h >> b & 1
    return [int(x) % 2**32 for x in out]


def likeness_of(a, b):
    if a == b:
        return 1.0
    x, y = (np.array(v[multiset.EQUAL + 1 :], dtype=float) * 2 - v[multiset.EQUAL] for v in (a, b))
    norm = math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())
    return min(1.0, max(0.0, (x * y).sum() / norm)) if norm else 0.0


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    other, order = edited(texts), sorted(texts)
    own, changed = ({i: lanes_of(t[i]) for i in order} for t in (texts, other))
    as_hex = lambda v: "".join(f"{x:08x}" for x in v)
    for r in queries.QUERIES["op6_multiset"](spark, sf).collect():
        following = order[(order.index(r.doc_id) + 1) % len(order)]
        assert r.fingerprint == as_hex(own[r.doc_id]) and r.edited_fingerprint == as_hex(changed[r.doc_id])
        assert math.isclose(r.near_edited, likeness_of(own[r.doc_id], changed[r.doc_id]), abs_tol=1e-9)
        assert math.isclose(r.near_next, likeness_of(own[r.doc_id], own[following]), abs_tol=1e-9)


def test_equal_lanes_do_not_follow_from_one_another(spark):
    """The pairs of lanes are hashes under different seeds, not functions of one hash of the paragraph."""
    seeds = {xxhash.xxh64_intdigest(struct.pack("<i", k), 42) for k in range(multiset.EQUAL // 2)}
    assert len(seeds) == multiset.EQUAL // 2
    (row,) = prints(spark, ["one paragraph"])
    assert row[: multiset.EQUAL] == lanes_of("one paragraph")[: multiset.EQUAL]
    h = xxhash.xxh64_intdigest(b"one paragraph", 42)  # what all lanes would follow from if the paragraph came first
    assert row[0] != xxhash.xxh64_intdigest(struct.pack("<i", 0), h) & 0xFFFFFFFF


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = edited(texts)
    rows = queries.QUERIES["op6_multiset"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text, prints = {}, {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        prints.setdefault(r.fingerprint, set()).add(tuple(sorted(text.split("\n"))))
        if want[r.doc_id] == text:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in rows if r.n_chars > 800]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.3 > sum(r.near_next for r in long) / len(long)


def prints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.lanes for r in multiset.lanes(frame, ["k"], "t").orderBy("k").collect()]


def test_order_insertion_and_deletion(spark):
    whole, turned, part, rest, other = prints(spark, ["a b c\nd e\nd e\nf", "f\nd e\na b c\nd e", "a b c\nd e", "d e\nf", "a b c\nd e\nf"])
    assert whole == turned != other
    frame = spark.createDataFrame([(whole, part, rest)], "w array<bigint>, p array<bigint>, r array<bigint>")
    row = frame.select(multiset.added("p", "r").alias("a"), multiset.removed("w", "r").alias("d"), multiset.likeness("w", "w").alias("one")).first()
    assert row.a == whole and row.d == part and row.one == 1.0
    assert all(0 <= x < 2**32 for x in whole) and len(whole) == multiset.LANES


def test_frame_edges(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (3, None, 2), (None, "", 3), (5, "x" * 100_000, 4), (1 << 40, "é\U0001f600ab", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = multiset.with_edits(frame).collect()
    assert len(out) == 6 and sum(r.doc_id == 1 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].edited_sha256 == hashlib.sha256(b"a b c ").hexdigest()
    assert by_id[5].edited_sha256 == hashlib.sha256(("x" * 75_000 + "é\U0001f600ab").encode()).hexdigest()
    assert by_id[1 << 40].edited_sha256 == hashlib.sha256("é\U0001f600a".encode()).hexdigest()
    assert by_id[3].lanes == by_id[None].lanes == by_id[3].edited_lanes
    assert multiset.with_edits(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = queries.QUERIES["op6_multiset"](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert F is not None
