"""The text operators as named queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import table
from marginalia.llm import byte_bpe, collocations, lm, multiset, neardup_vectors, packing, quality, resample, secrets, simhash, warc, word_bpe, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op4_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT d.page_id, d.payload_bytes, d.payload_digest,
           CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN f.first IS NULL OR f.first = d.page_id THEN NULL ELSE f.first END AS refers_to
    FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as the archives give it back."""
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's secrets."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op6_multiset")
def op6_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited form, and how alike they are."""
    found = multiset.with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        multiset.as_hex("lanes").alias("fingerprint"), multiset.as_hex("edited_lanes").alias("edited_fingerprint"),
        multiset.likeness("lanes", "edited_lanes").alias("near_edited"), multiset.likeness("lanes", "next_lanes").alias("near_next"),
    )


@query("op3_neardup_vectors")
def op3_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_lm")
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under unigrams and under the network."""
    return lm.score(table(spark, sf_dir, "documents"))


@query("op9_wordpiece")
def op9_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and word pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's threshold and what follows."""
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), with_text=False)
    return found.select("doc_id", "lang", "perplexity", "threshold", "rejected")


@query("op13_word_bpe")
def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("text")


@query(
    "op11_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    w AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
    four AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
    g AS (
        SELECT lang, 1 AS size, w1 AS phrase FROM four
        UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM four WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM four WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM four WHERE w4 IS NOT NULL
    ),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
    total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 30),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS left_part, array_to_string(ws[k + 1:], ' ') AS rest FROM c, (VALUES (1), (2), (3)) t(k) WHERE k < size),
    s AS (
        SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, k, (2000000::HUGEINT * cuts.a) // (x.a::HUGEINT + y.a) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.left_part JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest
    ),
    least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, array_to_string(ws[i:i + part - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, ws, a, part, unnest(range(1, size - part + 2)) AS i FROM c, (VALUES (2), (3)) t(part) WHERE part < size) GROUP BY ALL
    ),
    kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to four words that occur 30 times or more."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_resampling",
    r"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ),
    x AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)
    ),
    f AS (SELECT doc_id, unnest(ws) AS w FROM x),
    h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)),
    b AS (
        SELECT w, list_transform(range(1, length(h), 2), lambda j: 16 * (instr('0123456789ABCDEF', substr(h, j, 1)) - 1) + instr('0123456789ABCDEF', substr(h, j + 1, 1)) - 1) AS bytes FROM h
    ),
    u AS (
        SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM b, crc
    ),
    n AS (SELECT doc_id, bucket, count(*) AS n FROM f JOIN u USING (w) GROUP BY ALL),
    sums AS (SELECT bucket, sum(n) FILTER (doc_id IS NOT NULL) AS s, sum(n) FILTER (doc_id IS NULL) AS t FROM n GROUP BY bucket),
    every AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
    gain AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, every
    ),
    weights AS (SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN gain USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id),
    d AS (
        SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
        FROM x LEFT JOIN weights USING (doc_id) WHERE doc_id IS NOT NULL
    ),
    scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
    drawn AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= 20
        QUALIFY rank <= (10 * (SELECT count(*) FROM scores WHERE n_features >= 20)) // 100
    )
    SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN drawn USING (doc_id)
    """,
)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's words, and the ranks of the tenth drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
