import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from marginalia.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def brute(ranks, piece):
    """Merges by looking at all pairs each time."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("text", ["", " ", "a", "a" * 5000, "ab" * 400, "é中\U0001f600" * 30, "  \n\n  x", "é" * 31, "é" * 33, "<|endoftext|>", "\0\x01"])
def test_edges(bpe, other, text):
    assert bpe.encode(text) == other.encode_ordinary(text)
    assert bpe.decode_bytes(bpe.encode(text)) == text.encode()


def test_random_texts(bpe, other):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("aábeo t\n!1中'sth") for _ in range(rng.randint(0, 90)))
        assert bpe.encode(text) == other.encode_ordinary(text)


def test_ties_and_brute_force(bpe):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcthe") for _ in range(rng.randint(2, 100))) for _ in range(200)] + ["aaaa", "ababab"]
    found = bpe.encode_pieces(pieces)
    for p in pieces:
        ids = np.frombuffer(found[p], dtype="<u4").tolist()
        if p.encode() not in bpe.ranks:
            assert ids == brute(bpe.ranks, p.encode())


def test_long_piece_takes_its_own_tree(bpe):
    ids = bpe.encode("xyz" * 50_000)
    assert bpe.decode_bytes(ids) == b"xyz" * 50_000


def test_frame_edges(spark):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, 8), (None, "", 9), (3, "x" * 100_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = byte_bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 5 and out[0].ids == out[1].ids and out[0].n_tokens == len(out[0].ids)
    nothing = hashlib.sha256(b"").hexdigest()
    assert out[2].ids == [] and out[2].ids_sha256 == nothing == out[3].decoded_sha256
    assert out[4].decoded_sha256 == hashlib.sha256(b"x" * 100_000).hexdigest()
    assert byte_bpe.encode_documents(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library(spark, sf, other):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_byte_bpe"](spark, sf).collect():
        ids = np.array(other.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
