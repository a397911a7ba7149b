import random

import corpus_pipeline
import numpy as np
import pytest
from marginalia.llm import shingles, simhash


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def smallest(texts, least=0.8):
    """doc -> smallest doc reachable, by comparing all pairs of sets."""
    sets, root = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            common, size = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and root[a] != root[b] and common >= least * size - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {}
    for k in range(150):
        if k % 3 and out:
            words = out[rng.choice(list(out))].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        out[k] = " ".join(words)
    return out | {150: "", 151: None, 152: " \t"}


def test_stage_drops_all_near_copies_and_nothing_else(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert kept == set(smallest(texts).values())


def test_ends_beyond_the_largest_frequency(spark, texts, monkeypatch):
    """Where frequencies are no longer told apart, no pair is lost."""
    whole = shingles._met
    monkeypatch.setattr(shingles, "_met", lambda docs, clusters, often: whole(docs, clusters, often, 1))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert kept == set(smallest(texts).values())


def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert {1, 2, 582, 643, 709} <= kept and not {255, 56, 875, 770, 944} & kept  # 0.83, 0.97, 0.81, 0.84, 0.81


def test_repeats_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "z y"), (3, "q r"), (None, "a b c d"), (None, "lone"), (None, "lone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in simhash.deduplicate(frame, shingles.groups).collect()), key=str)
    assert found == sorted([(1, "a b c d"), (3, "q r"), (3, "z y"), (None, "lone")], key=str)
    assert simhash.deduplicate(frame.limit(0), shingles.groups).count() == 0


def test_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    whole = shingles.shingles(text)
    monkeypatch.setattr(shingles, "_MANY", 64)
    assert np.array_equal(shingles.shingles(text), whole)


@pytest.mark.parametrize("size", [64, 4000, 1 << 24])
def test_components_in_parts(spark, texts, monkeypatch, size):
    """Components larger than a task are verified in parts, with the same result."""
    monkeypatch.setattr(shingles, "GROUP_BYTES", size)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, shingles.groups).collect()}
    assert kept == set(smallest(texts).values())


def test_linked_group_of_near_copies_is_not_compared_by_pairs(monkeypatch):
    base = np.arange(1000, dtype=np.uint64) << np.uint64(40)
    sets = [np.unique(np.append(base[k % 7 :], np.uint64(k + 1))) for k in range(400)]
    counted = []
    monkeypatch.setattr(shingles, "alike", lambda *x: counted.append(x) or 9 * x[0] >= 4 * (x[1] + x[2]))
    out = shingles.linked(list(range(400)), list(range(400)), sets, np.zeros(1 << 16, dtype=np.int64))
    assert len(out) == 399 and len(counted) < 2000


def test_fingerprint_is_simhash_of_five_words():
    rng = random.Random(6)
    for n in (0, 1, 4, 5, 6, 300):
        text = " ".join(f"w{k}x{rng.randrange(10**6)}" for k in range(n))
        assert shingles.fingerprint(shingles.shingles(text)) % (1 << 64) == simhash.fingerprint(text, 5)


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """Without least hashes and lists, what the index of fingerprints connects is found, and verified."""
    rng = random.Random(4)
    out = {}
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        out[2 * k] = " ".join(words)
        out[2 * k + 1] = " ".join([*words, "end"])
    sets = {i: shingles.shingles(t) for i, t in out.items()}
    near = {k for k in range(60) if ((shingles.fingerprint(sets[2 * k]) ^ shingles.fingerprint(sets[2 * k + 1])) & (1 << 64) - 1).bit_count() <= shingles.RADIUS}
    monkeypatch.setattr(shingles, "least", lambda own: [None, None])
    monkeypatch.setattr(shingles, "_met", lambda docs, clusters, often: spark.createDataFrame([], "a bigint, b bigint"))
    docs = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, shingles.groups).collect()}
    assert len(near) > 30 and {2 * k + 1 for k in range(60)} - kept == {2 * k + 1 for k in near}


def test_variants_of_one_text_are_not_pairs(spark, monkeypatch):
    """Texts that share most of their shingles, but less than 0.8, don't make a pair of each two of them."""
    rng = random.Random(9)
    base, out = [f"w{k}" for k in range(200)], {}
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(200), 2 if k < 40 else 4):
            words[at] = f"new{rng.randrange(10**9)}"
        out[k] = " ".join(words)
    made, real = {}, shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name: made.setdefault(name, real(df, name)) if name == "pairs" else real(df, name))
    docs = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, shingles.groups).collect()}
    assert kept == set(smallest(out).values())
    assert made["pairs"].count() < 1500
