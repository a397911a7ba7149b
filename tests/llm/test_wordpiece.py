import random

import public_tokenizers
import pytest
from marginalia.llm import queries, wordpiece
from marginalia.llm.packing import _byte_of_char

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(word, first, inside):
    at, pieces, longest = 0, 0, max(map(len, first | inside), default=0)
    while at < len(word):
        vocabulary = inside if at else first
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 0
        at, pieces = end, pieces + 1
    return pieces


@pytest.mark.parametrize("seed", range(60))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    draw = lambda k: bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, k)))
    first, inside = {draw(6) for _ in range(rng.randint(1, 12))}, {draw(5) for _ in range(rng.randint(0, 12))}
    automaton = wordpiece.Automaton(first, inside)
    for _ in range(200):
        word = draw(14)
        assert automaton.count(word) == brute(word, first, inside)


def vocabulary():
    import json

    chars = _byte_of_char()
    tokens = [bytes(chars[c] for c in t) for t in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"] if t != "<|endoftext|>"]
    return {t[1:] for t in tokens if t.startswith(b" ") and len(t) > 1}, {t for t in tokens if not t.startswith(b" ")}


def test_query(spark, sf):
    first, inside = vocabulary()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {}
    rows = queries.QUERIES["op9_wordpiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r.doc_id].encode().split()
        pieces = [known[w] if w in known else known.setdefault(w, brute(w, first, inside)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(p or 1 for p in pieces), pieces.count(0))


def test_frame_edges(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 1), (2, " \t\n", 2), (3, "a" * 200_000, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = wordpiece.count_tokens(frame, PATH).collect()
    assert [r.n_words for r in out] == [2, 2, 0, 0, 1] and out[0].n_tokens == out[1].n_tokens and out[2].n_tokens == 0
    assert wordpiece.count_tokens(frame.limit(0), PATH).count() == 0
