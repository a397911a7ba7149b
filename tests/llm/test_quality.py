import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from marginalia.llm import quality, queries
from pyspark.sql import functions as F

GOOD = ["the cat sat on the mat .", "a dog sat on the log .", "the dog saw the cat .", "a cat and a dog ran ."]


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(GOOD) for _ in range(rng.randint(1, 8))), "en") for k in range(n)]
    bad = [(n + k, " ".join(rng.choice(["ZZ!!", "x|y", "%%"]) for _ in range(20)), "en") for k in range(20)] + [(n + 20 + k, "cat " * 30, "en") for k in range(5)]
    return rows, bad


def kneser_ney(sequences, size):
    """Plain interpolated modified Kneser-Ney over lists of ids: (a, b, c) -> probability."""
    three = Counter()
    for ids in sequences:
        p = [quality._BEGIN] * 2 + list(ids)
        three.update(zip(p, p[1:], p[2:]))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def level(table, context):
        d = quality.discounts(Counter(table.values()))
        total, cut = defaultdict(float), defaultdict(float)
        for k, c in table.items():
            total[context(k)] += c
            cut[context(k)] += d[min(c, 3) - 1]
        return d, total, cut

    d3, t3, g3 = level(three, lambda k: k[:2])
    d2, t2, g2 = level(two, lambda k: k[0])
    d1, t1, g1 = level(one, lambda k: 0)

    def p1(c):
        n = one.get(c, 0)
        return (n - d1[min(n, 3) - 1] if n else 0) / t1[0] + g1[0] / t1[0] / size

    def p2(b, c):
        if b not in t2:
            return p1(c)
        n = two.get((b, c), 0)
        return (n - d2[min(n, 3) - 1] if n else 0) / t2[b] + g2[b] / t2[b] * p1(c)

    def p3(a, b, c):
        if (a, b) not in t3:
            return p2(b, c)
        n = three.get((a, b, c), 0)
        return (n - d3[min(n, 3) - 1] if n else 0) / t3[a, b] + g3[a, b] / t3[a, b] * p2(b, c)

    return p3


@pytest.fixture(scope="module")
def frames(spark):
    good, bad = corpus()
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    return docs, labels


def test_model_equals_plain_kneser_ney(frames):
    docs, labels = frames
    model, used = quality.fit(docs, labels.where("quality = 1"), max_docs=120)
    assert len(used) == 120
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = model.tokens.size
    p3 = kneser_ney([model.tokens.ids(texts[i]).tolist() for i in used], size)
    rng = np.random.default_rng(1)
    keys = rng.integers(0, size, (400, 3))
    keys = np.concatenate([keys, np.stack([x[:-2], x[1:-1], x[2:]], axis=1)]) if (x := model.tokens.ids(texts[used[0]])).size > 2 else keys
    found = model.log10((keys[:, 0] * size + keys[:, 1]) * size + keys[:, 2])
    assert np.allclose(found, [math.log10(p3(*k)) for k in keys.tolist()], atol=1e-4)
    every = np.arange(size)
    for a, b in keys[:20, :2].tolist() + keys[-5:, :2].tolist():
        assert abs((10.0 ** model.log10((a * size + b) * size + every).astype(float)).sum() - 1) < 1e-4


def test_rejects_junk_and_keeps_clean(frames):
    docs, labels = frames
    out = {r.doc_id: r for r in quality.classify(docs, labels, max_docs=120).collect()}
    assert len(out) == docs.count()
    assert not any(r.rejected for i, r in out.items() if i < 300) and all(r.rejected for i, r in out.items() if i >= 300)
    assert all(r.rejected == (r.perplexity > r.threshold) for r in out.values())


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("rejected").cast("double")).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[0] > 0.9 and share[1] < 0.01


@pytest.mark.parametrize("word, want", [("Hello", "\0Aa"), ("STÖ!!", "\0A!!"), ("a***", "\0a**"), ("12.5%", "\0" + "0.0%"), ("|", "\0|"), ("éàü", "\0a")])
def test_shape(word, want):
    assert quality.shape(word) == want


def test_frame_edges(spark, frames):
    docs, labels = frames
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (None, GOOD[0], None), (9003, GOOD[0], "en"), (9003, GOOD[0], "en"), (9004, (GOOD[0] + " ") * 5000, "xx")], "doc_id long, text string, lang string")
    both = docs.union(odd).withColumn("perplexity", F.lit("x"))
    out = quality.classify(both, labels, max_docs=120)
    assert out.columns == ["doc_id", "text", "lang", "perplexity", "threshold", "rejected"] and out.count() == docs.count() + 6
    assert not any(r.rejected for r in out.where("doc_id > 9000 OR doc_id IS NULL").collect())
    assert quality.classify(docs, labels.limit(0)).where("rejected").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_small_languages_have_their_own_threshold(spark):
    rng = random.Random(8)
    own = ["le chat dort ici .", "un chien court vite .", "la pluie tombe fort ."]
    rows = [(k, " ".join(rng.choice(GOOD) for _ in range(8)), "en") for k in range(600)]
    rows += [(1000 + k, " ".join(rng.choice(own) for _ in range(8)), "fr") for k in range(60)]
    rows += [(2000 + k, " ".join(f"o{rng.randrange(10**6)}x{rng.randrange(9)}" for _ in range(20)), "zz") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, lang in rows if lang == "en" or lang == "fr" and i < 1020], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels, max_docs=100).collect()}
    assert sum(r.lang == "fr" and r.rejected for r in out.values()) == 0
    assert not any(r.rejected for r in out.values() if r.lang == "zz")  # nothing is known of it
    assert out[1000].threshold > out[0].threshold and out[2000].threshold == math.inf


def test_many_languages(spark):
    """Medians and thresholds are a table: the plan does not grow with the languages."""
    rows = [(k, f"la le li lo lu {k % 7} na ne ni", f"l{k % 5000}") for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    found = quality.classify(docs, labels, max_docs=200)
    assert found.count() == 10_000 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert found.where("rejected").count() == 0


def test_repeated_ids_stay_within_the_bound(spark):
    rows = [(k % 3, "word " * 50) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, picked = quality.fit(docs, docs.select("doc_id").distinct(), max_chars=2500)
    assert len(picked) <= 1


def test_all_of_the_first_half_is_learned_from(spark):
    """No bound on texts: a word that stands only in those that come last by the hash is known."""
    ids = spark.range(9000).withColumnRenamed("id", "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    order = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id")).collect()]
    docs = spark.createDataFrame([(i, GOOD[k % 4] + (" late ." if k > 4100 else "")) for k, i in enumerate(order)], "doc_id long, text string")
    model, used = quality.fit(docs, docs.select("doc_id"))
    assert used is None and "late" in model.tokens.id


@pytest.mark.parametrize("held", [0, 60])
def test_rest_of_the_model_in_joins(spark, frames, monkeypatch, held):
    """Where tasks hold only frequent trigrams, or none, documents get the scores of the whole model."""
    docs, labels = frames
    odd = spark.createDataFrame([(9001, None, "en"), (None, GOOD[0] + " the unseen cat", None), (9003, (GOOD[1] + " log the ") * 3000, "en"), (9003, "mat mat . the", "en")], "doc_id long, text string, lang string")
    both = docs.union(odd).withColumn("_row", F.lit("x"))
    told = lambda: sorted(((str(r.doc_id), r.text or "", r.rejected, r.perplexity, r.threshold) for r in quality.classify(both, labels).collect()), key=lambda r: r[:2])
    whole = told()
    monkeypatch.setattr(quality, "HELD", held)
    model, more, used = quality._fitted(both, labels.where("quality = 1"))
    assert not model.whole and more is not None and (model.three.keys >= 0).sum() <= held and used is None
    parts = told()
    assert [r[:3] for r in parts] == [r[:3] for r in whole]
    assert np.allclose([r[3:] for r in parts], [r[3:] for r in whole], rtol=1e-4)
    kept = {(str(r.doc_id), r.text or "") for r in quality.accepted(both, labels).collect()}
    assert kept == {r[:2] for r in whole if not r[2]}
