"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo 2**32. So the order of paragraphs doesn't matter, and the fingerprint of a
document with a paragraph more or less follows by adding or subtracting that paragraph's vector.

The lanes, 73 of 32 bits: EQUAL lanes hold hashes of the whole paragraph, each pair under a seed of its
own (the paragraph is hashed after the seed, so no two pairs are functions of one another), and decide
equality; one lane counts shingles; ALIKE lanes hold, for each bit of a 64-bit hash, in how many of the
paragraph's three-word shingles it is set. Twice an ALIKE lane less the count is a sum of random signs,
one per shingle, so the normalised product of two fingerprints estimates how many shingles their
documents share, with a standard error of 1/8 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import written

EQUAL, ALIKE = 8, 64
LANES = EQUAL + 1 + ALIKE
_MODULUS = 1 << 32
_LOW = 0x00000000FFFFFFFF
_TWO = 0x0000000100000001  # two lanes of 32 bits side by side
_NULL_ID = -(1 << 63)  # a null doc_id, where ids are sorted or joined


def lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``copies`` and ``lanes`` (array<bigint>) for each distinct ``keys``; rows with equal
    keys must have equal texts, and copies tells how many they are. No shuffle if the rows of a key
    are together already; otherwise one, of a row per key and task."""
    paragraph = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "_paragraph"))
    words = paragraph.select(*keys, "_p", *(F.xxhash64(F.lit(k), "_paragraph").alias(f"_e{k}") for k in range(EQUAL // 2)), F.split("_paragraph", " ").alias("_w"))
    zipped = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.size("_w")).alias("b"), F.slice("_w", 3, F.size("_w")).alias("c"))
    shingles = words.select(*keys, "_p", *(f"_e{k}" for k in range(EQUAL // 2)), F.posexplode(zipped).alias("_s", "_t"))
    hashed = shingles.select(*keys, "_p", "_s", *(f"_e{k}" for k in range(EQUAL // 2)), F.xxhash64("_t.a", "_t.b", "_t.c").alias("_h"))
    once = lambda c: F.when(F.col("_s") == 0, c).otherwise(0)  # noqa: E731  a paragraph counts at its first shingle
    sums = hashed.groupBy(*keys).agg(
        F.sum(F.when((F.col("_p") == 0) & (F.col("_s") == 0), 1).otherwise(0)).alias("copies"),
        F.count("*").alias("_n"),
        *(F.sum(once(F.col(f"_e{k}").bitwiseAND(F.lit(_LOW)))).alias(f"_low{k}") for k in range(EQUAL // 2)),
        *(F.sum(once(F.shiftrightunsigned(f"_e{k}", 32))).alias(f"_high{k}") for k in range(EQUAL // 2)),
        *(F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_TWO))).alias(f"_a{k}") for k in range(ALIKE // 2)),
    )
    whole = lambda c: F.expr(f"pmod({c} div copies, {_MODULUS}L)")
    wide = [*(whole(f"_{side}{k}") for k in range(EQUAL // 2) for side in ("low", "high")), whole("_n")]
    wide += [whole(f"(_a{k} & {_LOW}L)") for k in range(ALIKE // 2)] + [whole(f"shiftrightunsigned(_a{k}, 32)") for k in range(ALIKE // 2)]
    return sums.select(*keys, "copies", F.array(*wide).alias("lanes"))


def added(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of two documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(_MODULUS)))


def removed(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(_MODULUS)))


def as_hex(c: Column | str) -> Column:
    """A fingerprint as one string, 8 hexadecimal digits a lane."""
    return F.concat_ws("", F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(a: str, b: str) -> Column:
    """From 0 to 1: an estimate of the shingles that two fingerprints' documents share; 1 if equal."""

    def signs(c: str) -> Column:
        return F.transform(F.slice(c, EQUAL + 2, ALIKE), lambda x: (2 * x - F.element_at(c, EQUAL + 1)).cast("double"))

    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(product(signs(a), signs(a))) * F.sqrt(product(signs(b), signs(b)))
    near = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(signs(a), signs(b)) / norm))).otherwise(0.0)
    return F.when(F.col(a) == F.col(b), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(near)


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, previous, previous_n) for rows (key, n) with distinct keys: the key before in ascending
    order, and the last for the first. Sorted by ranges; only the ranges' ends, a row each, meet in
    one task."""
    ranged = written(ids.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("range").agg(F.max_by(F.struct("key", "n"), "key").alias("last"))
    order = Window.orderBy("range")
    before = ends.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    inside = Window.partitionBy("range").orderBy("key")
    own = ranged.select("key", "range", F.lag(F.struct("key", "n")).over(inside).alias("own"))
    return own.join(before, "range").select("key", F.coalesce("own", "end").alias("b")).select("key", F.col("b.key").alias("previous"), F.col("b.n").alias("previous_n"))


def with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, lanes and edited_lanes of the text and of
    its edited form (its last floor(n_chars/4) code points replaced by the first as many of the next
    document by doc_id, the first after the last), next_lanes (the next document's).

    Nulls: a null text is empty; a null doc_id comes before all others. Repeated rows each get a row.
    Where a doc_id has several texts, the smallest is what comes before it sees as the next. An empty
    table gives no rows. Texts are shuffled once by doc_id, and the quarter that moves to the previous
    document once more; fingerprints are summed where the texts are.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    before = neighbours(own.groupBy("key").agg(F.max(F.length("text")).alias("n")))
    dealt = own.repartition("key")
    heads = dealt.join(before, "key").groupBy(F.col("previous").alias("to")).agg(F.min(F.expr("substring(text, 1, CAST(previous_n div 4 AS INT))")).alias("head"))
    both = dealt.join(heads, F.col("key") == F.col("to"), "left").select(
        "key", "text", F.length("text").alias("n_chars"),
        F.expr("concat(substring(text, 1, length(text) - CAST(length(text) div 4 AS INT)), substring(coalesce(head, ''), 1, CAST(length(text) div 4 AS INT)))").alias("edited"),
    )
    keyed = both.select("key", "n_chars", F.xxhash64("text").alias("text_hash"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    summed = lanes(keyed.select("key", "n_chars", "text_hash", "edited_sha256", "v.which", "v.t"), ["key", "n_chars", "text_hash", "edited_sha256", "which"], "t")
    paired = written(
        summed.groupBy("key", "n_chars", "text_hash", "edited_sha256", "copies")
        .agg(F.map_from_entries(F.collect_list(F.struct("which", "lanes"))).alias("m"))
        .select("key", "n_chars", "text_hash", "edited_sha256", "copies", F.col("m")[0].alias("lanes"), F.col("m")[1].alias("edited_lanes")),
        "fingerprints",
    )
    following = paired.join(before, "key").groupBy(F.col("previous").alias("to")).agg(F.min_by("lanes", "text_hash").alias("next_lanes"))
    full = paired.join(following, F.col("key") == F.col("to"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return full.select(F.when(F.col("key") != _NULL_ID, F.col("key")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "lanes", "edited_lanes", "next_lanes")
