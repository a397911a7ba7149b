import corpus_pipeline
import public_tokenizers
import pytest
from marginalia.llm import quality, secrets, simhash
from tokenizers import Tokenizer

from tests.llm.test_packing import check
from tests.llm.test_shingles import smallest


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, over the smallest table that holds every kind of case."""
    docs, out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, "/root/testdata/sf0.01").collect()
        out.append({r.doc_id: r for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_keep_the_columns(stages):
    assert all(list(rows[next(iter(rows))].asDict()) == corpus_pipeline.COLUMNS for rows in stages)


def test_quality_stage(spark, stages):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id for r in quality.classify(docs, labels).where("NOT rejected").collect()}
    assert stages[0].keys() == want
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean - want) <= 0.01 * len(clean)


def test_dedup_stage(stages):
    """Five-word shingles and a similarity of 0.8, as near-duplicate stages are to take."""
    assert stages[1].keys() == set(smallest({i: r.text for i, r in stages[0].items()}).values())


def test_secret_stage(stages):
    assert stages[2].keys() == stages[1].keys()
    for i, r in stages[2].items():
        before = stages[1][i].text
        assert r.text == secrets.redact(before, secrets.spans(before)) and r.n_chars == len(r.text)
        assert r.text == before or "[SECRET]" in r.text


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    check(rows, {i: r.text for i, r in stages[2].items()})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = max(rows, key=lambda r: r.length)
    ids = library.encode(stages[2][some.doc_id].text, add_special_tokens=False).ids + [0]
    assert some.ids == ids[some.start : some.start + some.length]


def test_dedup_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "z y x w"), (3, "q r s t"), (None, "a b c d"), (None, "lone one"), (None, "lone one"), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in simhash.deduplicate(frame).collect()), key=str)
    assert found == sorted([(1, "a b c d"), (3, "q r s t"), (3, "z y x w"), (None, "lone one"), (5, None)], key=str)
    assert simhash.deduplicate(frame.limit(0)).count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names clash with those
    that stages use, and no rows at all."""
    long = " ".join(f"word{k % 977} and{k}" for k in range(60_000))
    rows = [
        (1, "some plain words in a row here", "en", "s", 30), (1, "some plain words in a row here", "en", "s", 30), (2, None, "en", "s", 0), (3, "", None, None, None),
        (None, "a text that has no id of its own", "de", "s", 32), (5, long, "en", "s", len(long)), (6, long + " password=abcdef123", "en", "s", len(long)), (7, "x" * 300_000, "fr", "s", 300_000),
    ]
    extra = ["_sum", "_tokens", "_key", "_hash", "secrets", "group", "node", "fp", "rejected", "stays", "piece", "_text"]
    frame = spark.createDataFrame([(*r, *(str(k) for k in range(len(extra)))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    for name, docs in (("full", frame), ("none", frame.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    after = [spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after.append(stage(spark, after[-1], str(tmp_path / "full")))
        assert after[-1].columns == corpus_pipeline.COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in after[2].collect()), key=str)
    texts = [t for _, t in kept]
    assert len(set(texts)) == len(texts) and (5, long) in kept and 6 not in [i for i, _ in kept]  # 6 is nearly 5
    assert {1, None, 5} <= {i for i, _ in kept}
    found = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert {r.doc_id for r in found} == {i for i, _ in kept}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = sum((r.ids for r in sorted((r for r in found if r.doc_id == 5), key=lambda r: r.piece)), [])
    assert whole == library.encode(long, add_special_tokens=False).ids + [0]
