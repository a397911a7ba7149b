import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from marginalia.llm import queries, word_bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def theirs(library, text):
    return library.encode(text, add_special_tokens=False).ids


EDGES = [
    "", " ", "a", "A" * 500, "ab" * 4000, "é中\U0001f600" * 30, "  \n\n  x", "éa", "ΑΣ ΟΔΟΣ", "İstanbul", "\0\x01\x1c\x1d!", "it's we'll I'D '", "x y\u0085z",
    "<|endoftext|>", "a<|endoftext|>B <|startoftext|><|endoftext|>", "<|endoftext", "<|ENDOFTEXT|>", "12½ ²x", "´`^" * 60,
]


@pytest.mark.parametrize("text", EDGES)
def test_edges(bpe, library, text):
    assert bpe.encode(text) == theirs(library, text)
    assert bpe.decode_bytes(bpe.encode(text)).decode() == library.decode(theirs(library, text), skip_special_tokens=False)


def test_every_plain_letter_and_its_neighbours(bpe, library):
    for c in range(word_bpe._LAST + 0x100):
        for form in ("{0}", "a{0}b", "1{0} {0}x", "'{0}", "{0}'s"):
            text = form.format(chr(c))
            assert bpe.encode(text) == theirs(library, text), hex(c)


def test_random_texts(bpe, library):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aábeo t\n!1Ħ'sthREß<|中Σ") for _ in range(rng.randint(0, 90)))
        assert bpe.encode(text) == theirs(library, text)


def brute(bpe, word):
    """Merges by looking at all pairs each time."""
    raw = word.encode()
    ids = [*bpe._inner[list(raw[:-1])].tolist(), int(bpe._last[raw[-1]])]
    while found := [(bpe.pairs[p], k) for k in range(len(ids) - 1) if (p := ids[k] << 20 | ids[k + 1]) in bpe.pairs]:
        least, k = min(found)
        ids[k : k + 2] = [least & 0xFFFFF]
    return ids


def test_scans_and_heaps_equal_brute_force(bpe):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcthesn") for _ in range(n)) for n in [*range(1, 60), *[word_bpe.SHORT - 1, word_bpe.SHORT, word_bpe.SHORT + 1, 300] * 5]] + ["aaaa", "ababab"]
    found = bpe.encode_words(words)
    for w in words:
        assert np.frombuffer(found[w], dtype="<u4").tolist() == brute(bpe, w)


def test_memo_is_bounded(bpe, monkeypatch):
    monkeypatch.setattr(word_bpe, "_KEEP", 10)
    own = word_bpe.WordBpe(PATH)
    for k in range(8):
        text = " ".join(f"w{k}x{j}" for j in range(9)) + " " + "y" * 500
        assert own.encode(text) == bpe.encode(text)
    assert len(own.known) < 40 and "y" * 500 not in own.known


def test_added_tokens_may_be_plain_text(bpe):
    assert bpe.encode_batch(["a<|endoftext|>"], added=False) != bpe.encode_batch(["a<|endoftext|>"])


def test_frame_edges(spark):
    rows = [(1, "Hello world", 7, "n"), (1, "Hello world", 7, "n"), (2, None, 8, None), (None, "", 9, "m"), (3, "xy" * 50_000, 1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, name string")
    out = word_bpe.encode_documents(frame, PATH).collect()
    assert len(out) == 5 and out[0].ids == out[1].ids and out[0].n_tokens == len(out[0].ids) and out[0].name == "n"
    nothing = hashlib.sha256(b"").hexdigest()
    assert out[2].ids == [] and out[2].ids_sha256 == nothing == out[3].decoded_sha256 and out[2].text is None
    assert out[4].n_tokens == len(out[4].ids) > 1
    assert word_bpe.encode_documents(frame.limit(0), PATH).count() == 0
    assert "ids" not in word_bpe.encode_documents(frame, PATH, with_ids=False).columns


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op13_word_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = theirs(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
