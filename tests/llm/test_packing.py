import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from marginalia.llm import packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expand(counts, capacity):
    keys, rows, sequences = packing.plan(counts, capacity)
    bins = defaultdict(list)
    for length, n in counts.items():
        for number in range(n):
            row = rows[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            ahead = number - row[0]
            bins[row[1] + ahead // row[2]].append((row[3] + ahead % row[2] * length, length))
    return bins, sequences


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_gapless_and_no_worse_than_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 30, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    bins, sequences = expand(Counter(lengths), capacity)
    assert len(bins) == sequences
    assert Counter(x for b in bins.values() for _, x in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * x > capacity for _, x in b) <= 2
    assert sequences <= best_fit_decreasing(lengths, capacity) + 1
    assert sequences >= -(-sum(lengths) // capacity)


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(1)
    small = {x: rng.randint(1, 50) for x in range(1, 2049)}
    few, many = packing.plan(small, 2048), packing.plan({x: n * 10**6 for x, n in small.items()}, 2048)
    assert len(many[0]) < 30_000 and len(few[0]) < 30_000


def test_bad_length():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(PATH), packing.encoder(PATH, public_tokenizers.PATTERN)
    texts = ["", "a b", "Hello, wörld!\n\n x", "中文 text", "a<|endoftext|>b", "x" * 3000, " " * 70]
    assert own(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own(["ab " * 80_000])[0] == library.encode("ab " * 80_000, add_special_tokens=False).ids


def check(rows, texts):
    library = Tokenizer.from_file(PATH)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_packing"](spark, sf).collect()
    check(rows, texts)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) * 1.02 + 1


def test_frame_edges(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "b c", "y"), (3, None, None), (4, "", "z")], "doc_id long, text string, length string")
    rows = packing.pack(frame, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2, 2, 3] and all(r.ids[-1] == 0 for r in rows)
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset + r.length for r in rows)[-1] == 9
    assert packing.pack(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
