import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from marginalia.llm import lm, queries


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), and the counts of training words"""
    tokens = {i: split(t) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}, c


def by_hand(text, model, c, head, most):
    """The log10-probability of a text under a trained model, one word at a time."""
    ranked = sorted(c, key=lambda w: (-c[w], (w or "").encode()))
    # as many words as frequent() takes: whole classes of counts
    own = [w for w in ranked[:head] if w is not None][: most - 1]
    target = {None: 0} | {w: k + 1 for k, w in enumerate(own)}
    tail = lambda w: zlib.crc32((w or "").encode()[-2:]) % lm.TAILS
    of = lambda w: target.get(w, most + tail(w))
    size, room = Counter(), Counter()
    for w, n in c.items():
        size[of(w)] += n
        room[of(w)] += 1
    near = lambda w: of(w) if of(w) < min(most, lm.NEAR_OWN) else lm.NEAR_OWN + tail(w)
    far = lambda w: of(w) if of(w) < min(most, lm.FAR_OWN) else lm.FAR_OWN + tail(w) % (lm.FAR - lm.FAR_OWN)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    tokens, out = [None, None, *split(text)], 0.0
    for two, one, w in zip(tokens, tokens[1:], tokens[2:]):
        s = (p["far"][far(two)] @ p["A"] + p["near"][near(one)] @ p["B"]) @ p["target"].T + p["bias"][:, 0] + model.log_share
        out += (s[of(w)] - np.log(np.exp(s).sum())) / math.log(10)
        if of(w) >= most:
            out += math.log10((c[w] + 0.1) / (size[of(w)] + 0.1 * (room[of(w)] + 1)))
    return out


@pytest.mark.parametrize("head, vocabulary", [(lm.HEAD, lm.VOCABULARY), (300, 200), (200, 300)])
def test_scores_equal_those_by_hand(spark, sf, monkeypatch, head, vocabulary):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, c = plain(rows)
    kept, train = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda *x: kept.append(train(*x)) or kept[0])
    listed = []
    take = lm.frequent
    monkeypatch.setattr(lm, "frequent", lambda *x: listed.append(take(*x)) or listed[0])
    found = lm.score(spark.read.parquet(f"{sf}/documents.parquet"), head=head, vocabulary=vocabulary, steps=50).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        if n < 60 and r.doc_id % (3 if vocabulary < 1000 else 12) == 0:
            assert math.isclose(r.score, by_hand(texts[r.doc_id], kept[0], c, len(listed[0][0]), vocabulary), rel_tol=1e-4)


def test_held_out_texts_gain(spark):
    found = [r for r in queries.QUERIES["op10_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in found) * math.log(10) / sum(r.n_tokens for r in found)
    assert gain > 0.1


def test_query_columns(spark, sf):
    assert queries.QUERIES["op10_lm"](spark, sf).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(1)
    chain = rng.dirichlet(np.full(6, 0.2), size=(6, 6))
    seq = [0, 0]
    for _ in range(20_000):
        seq.append(int(rng.choice(6, p=chain[seq[-2], seq[-1]])))
    c = np.array(seq)
    keys = lm.pack(np.append([0, 0], c[:-2]), np.append(0, c[:-1]), c)
    model = lm.LogBilinear(np.bincount(c), near=6, far=6)
    model.start()
    keys, counts = np.unique(keys, return_counts=True)
    for _ in range(300):
        model.train(keys, counts, np.random.default_rng(2), batch=64)
    far, near, true = keys >> 32, keys >> 16 & 0xFFFF, keys & 0xFFFF
    a, b = model.contexts()
    z = np.array([model.normaliser(f) for f in range(6)])
    scores = (a[:, None] + b[None]) @ model.p["target"].T + model.log_share + model.p["bias"][:, 0] - z[:, :, None]
    assert np.allclose(np.exp(scores).sum(axis=2), 1, atol=1e-4)
    share = np.bincount(c) / len(c)
    assert (counts * scores[far, near, true]).sum() / len(c) > (share * np.log(share)).sum() + 0.1


def test_examples():
    vocabulary = lm.Vocabulary([b"", b"a", b"b"], np.array([3, 2, 1]))
    ids, ends = np.array([1, 2, 0, 0, 2, 1, 1, 0], dtype=np.uint16), np.array([3, 4, 8])
    far, near = lm.examples(ids, ends, vocabulary)
    assert near.tolist() == [0, 1, 2, 0, 0, 2, 1, 1] and far.tolist() == [0, 0, 1, 0, 0, 0, 2, 1]
    assert [len(x) for x in lm.examples(ids[:0], ends[:0], vocabulary)] == [0, 0]


def test_every_token_is_an_example(spark, sf, monkeypatch):
    """What tasks train on is all of the training texts' tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").coalesce(2)
    kept = []
    monkeypatch.setattr(lm, "trained", lambda texts, *x: kept.append(sum(len(r.ids) // 2 for r in texts.collect())) or x[1].value)
    found = lm.score(docs).collect()
    assert kept[0] == sum(r.n_tokens for r in found if not r.held_out) == found[0].train_tokens


def test_turns_keep_the_counts():
    model = lm.LogBilinear(np.ones(50), near=4, far=4)
    counts = np.array([1, 2, 33, 5000] * 10)
    steps = []
    model.step = lambda far, near, true, count, noise: steps.append((true, count))
    model.train(np.arange(40), counts, np.random.default_rng(1), batch=16)
    total = np.bincount(np.concatenate([t for t, _ in steps]), np.concatenate([c for _, c in steps]))
    assert np.allclose(total, counts) and max(c.max() for _, c in steps) <= 32


def test_frame_edges(spark):
    rows = [(3, "a b a", 1), (3, "a b a", 1), (4, None, 2), (None, "a c", 3), (5, "x " * 60_000, 4), (6, "", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = lm.score(frame, steps=20).collect()
    assert len(found) == 6 and sorted(r.n_tokens for r in found) == [1, 1, 3, 4, 4, 60_001]
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert lm.score(frame.limit(0), steps=5).count() == 0
    alone = lm.score(frame.where("doc_id = 4"), steps=5, folds=1).collect()
    assert alone[0].n_known == 0 and alone[0].train_tokens == 0 and alone[0].held_out


def network(spark, rows, parts, trainers):
    """The arrays that training gives for rows of ids in so many partitions."""
    frame = spark.createDataFrame([(np.array(r, dtype=np.uint16).tobytes(),) for r in rows], "ids binary").repartition(parts)
    words = spark.sparkContext.broadcast(lm.Vocabulary([b"", *(b"w%d" % k for k in range(9))], np.arange(10, 0, -1), 20))
    start = spark.sparkContext.broadcast(lm.LogBilinear(np.arange(276, 0, -1.0)))
    before = {k: v.copy() for k, v in start.value.p.items()}
    found = lm.trained(frame, words, start, 30, trainers)
    assert all((before[k] == start.value.p[k]).all() for k in before)  # the start stays as it was
    return found.p


def test_training_follows_from_the_rows_alone(spark):
    """Whatever the partitions, their order and the workers that have trained before."""
    rng = np.random.default_rng(3)
    rows = [[*rng.integers(1, 10, rng.integers(1, 40)), 0] for _ in range(200)]
    one = network(spark, rows, 1, 3)
    for parts in (1, 4, 7):
        again = network(spark, rows[::-1], parts, 3)
        assert all(np.allclose(one[k], again[k], atol=1e-6) for k in one)


def test_trainers_of_equal_rows_agree(spark):
    """The average of models that learn the same is that model, as all begin at one start."""
    rows = [[1, 2, 3, 0]] * 40
    assert all(np.array_equal(a, b) for a, b in zip(network(spark, rows, 4, 1).values(), network(spark, rows, 1, 5).values()))


def test_long_words_stay_out_of_the_head(spark):
    rows = [(k, f"{'x' * 1_000_000}{k} a b") for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    head, _ = lm.frequent(lm.word_counts(frame), 1000)
    assert sorted(head) == [b"", b"a", b"b"]
    found = lm.score(frame, steps=5).collect()
    assert all(r.n_tokens == 4 and math.isfinite(r.score) and r.n_known == (3 if r.held_out else 4) for r in found)
