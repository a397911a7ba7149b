import random
import re
from collections import Counter

import numpy as np
import pytest
from marginalia.llm import collocations

from tests.llm.sql import equal_rows


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, least=2, longest=4, share=80, most=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def texts(seed, n, words="a b c dd é the 中 x-y Z".split(), longest=40):
    rng = random.Random(seed)
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "! ", "\x0b"]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(0, longest)))) for _ in range(n)]


def frame_of(spark, rows):
    return spark.createDataFrame([(k, lang, text, 1, "p") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string")


def test_equals_brute_force(spark):
    rows = texts(1, 150) + [("en", None), ("en", ""), ("xx", " \t\n.,"), ("en", "a " * 3000), ("fr", "A b c dd " * 500)] + texts(1, 20)
    assert rows_of(collocations.collocations(frame_of(spark, rows), least=2)) == brute(rows, 2)


@pytest.mark.parametrize("least, longest, share, most", [(3, 2, 80, 5), (2, 3, 50, 7), (30, 4, 80, 2000), (2, 5, 100, 9)])
def test_parameters(spark, least, longest, share, most):
    rows = texts(2, 120)
    found = collocations.collocations(frame_of(spark, rows), least, longest, share, most)
    assert rows_of(found) == brute(rows, least, longest, share, most)


def test_words_on_one_cell(spark, monkeypatch):
    """Eight cells, so that words share their sizes."""
    whole = collocations.levels
    monkeypatch.setattr(collocations, "levels", lambda words: whole(words, 3))
    rows = texts(3, 60, [f"w{k}" for k in range(12)], 300)
    assert rows_of(collocations.collocations(frame_of(spark, rows), least=2)) == brute(rows, 2)


def test_small_buffers(spark):
    """Texts in many parts, and tasks that pass their counts on early."""
    rows = texts(5, 40, [f"w{k}" for k in range(12)], 300)
    frame = frame_of(spark, rows).where("lang IS NOT NULL").select("lang", "text")
    whole, small = (collocations.word_counts(frame, *how) for how in ((), (5, 2)))
    assert sorted(whole.collect()) == sorted(small.collect())
    words = whole.where("c >= 2")
    cells = spark.sparkContext.broadcast(collocations.levels(words))
    counts = [sorted(collocations.phrases(collocations.mined(collocations.routed(frame, cells, 4, *how), words, 2, 4, 3), 2).collect()) for how in ((), (5, 2))]
    assert counts[0] == counts[1] and len(counts[0]) > 100


def test_every_occurrence_has_one_owner():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("abcd").encode() for _ in range(rng.randint(1, 30))]
        order = {w: rng.choice([k, collocations._NOWHERE, 1]) for k, w in enumerate(set(words))}  # ties and gaps
        places = np.array([order[w] for w in words])
        found = Counter()
        for sent in collocations.stretches(words, places, 0, len(words), 4):
            before, parts = sent[0], sent[1:].split()
            assert 1 < len(parts) <= 7 and order[parts[before]] == max(order[w] for w in parts)
            found.update(tuple(parts[a:b]) for a in range(before + 1) for b in range(before + 1, len(parts) + 1) if 2 <= b - a <= 4)
        spans = [tuple(words[a : a + s]) for s in (2, 3, 4) for a in range(len(words) - s + 1)]
        assert found == Counter(p for p in spans if all(order[w] < collocations._NOWHERE for w in p))


def test_long_texts_keep_their_pieces():
    text = b"One  two,three\tFOUR\x0b" * 9 + b"x" * 100
    assert sum(collocations.tokens(text, 1), []) == [*([b"one", b"two", b".", b"three", b"four", b"."] * 9), b"x" * 100, b"."]


def test_exact_beyond_64_bits(spark):
    a = 4 * 10**13
    found = spark.createDataFrame([("en", "a b", a), ("en", "b c", a), ("en", "a b c", a - 1)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", w, a + 7) for w in "abc"], "lang string, word string, c long")
    for r in collocations.scored(found, words, 4).collect():
        left, right = (a + 7, a + 7) if r.phrase != "a b c" else (a + 7, a)
        assert (r.l, r.r, r.score) == (left, right, 2_000_000 * r.a // (left + right))


def test_empty_tables(spark):
    frame = frame_of(spark, [("en", "a b")])
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame).count() == 0


def test_stretches_are_dealt_once(spark):
    """Their n-grams are counted where they are, without a second shuffle."""
    sent = spark.createDataFrame([("en", b"b", b"\x01a b", 2)], "lang string, pivot binary, stretch binary, c long")
    words = spark.createDataFrame([("en", "b", 2)], "lang string, word string, c long")
    found = collocations.mined(sent, words, 1, 4, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [("en", "a b", True, 2)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    assert equal_rows(spark, "op11_collocations", f"/root/testdata/{size}") > 40
