import hashlib
import math
import random
import re
import zlib

import pytest
from marginalia.llm import resample

from tests.llm.sql import equal_rows


def features(text, longest):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for texts, count in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for f in features(text, longest)[1]:
                count[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((-r[3], -math.inf if r[0] is None else r[0], k) for k, r in enumerate(out) if r[4])
    rank = {k: place for place, (_, _, k) in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(([*r[:4], rank.get(k)] for k, r in enumerate(out)), key=str)


def check(spark, rows, target, **how):
    docs = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, rank long, weight string")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = resample.resample(docs, goal, **how)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and found.schema["doc_id"].dataType.simpleString() == "bigint"
    assert sorted((list(r) for r in found.collect()), key=str) == brute(rows, target, **{{"least_words": "least"}.get(k, k): v for k, v in how.items()})


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "x1", "中文", "ABC", "zz", "q\x7fr", "a-b"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(300, 1)))
    rows += [rows[3], rows[3], (None, "the of " * 40), (None, "the of " * 40), (400, None), (401, ""), (402, "...!"), (-7, "abc " * 200_000)]
    check(spark, rows, [*texts(20, 2), None, ""])


@pytest.mark.parametrize("how", [{"longest": 3, "buckets": 97}, {"percent": 50, "least_words": 0, "buckets": 11}, {"percent": 0}, {"percent": 100, "seed": 1}])
def test_parameters(spark, how):
    check(spark, list(enumerate(texts(120, 3))), texts(9, 4), **how)


def test_ties_go_to_smaller_ids(spark):
    """Copies of one row tie in all but their place; exactly as many as asked for are drawn."""
    check(spark, [(5, "the of x1 " * 10)] * 95 + list(enumerate(texts(5, 5))), texts(3, 6), percent=30)


def test_empty_tables(spark):
    check(spark, [(1, "the of " * 30)] * 10, [])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs.select("text")).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(resample, "_FLUSH", 3)
    known = resample._Buckets(100)
    found = [known[b"%d" % k] for k in range(20)]
    assert found == [zlib.crc32(b"%d" % k) % 100 for k in range(20)] and len(known) == 3
    with pytest.raises(ValueError):
        resample.count_matrix(None, buckets=1 << 16)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    assert equal_rows(spark, "op12_resampling", f"/root/testdata/{size}") >= 200
