"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trigrams of trusted texts are counted and summed in shards; the counts of continuations and contexts
follow from them by further grouped sums, and joins of these tables give every seen n-gram its
interpolated probability and every context the weight of the next lower order. One half of the trusted
texts, by a hash of their ids, is what the model learns from, all of it; the other half sets thresholds.
The model grows with the texts: tasks hold the most frequent trigrams, and the places of documents whose
trigram is none of these meet the rest of the model in joins. A document's score is its
mean negative log10-probability a token, drawn towards its language's median where the text is short.
Documents above a threshold, set by quantiles of the scores of that other half of the language,
are rejected.

Frequent words stand for themselves; a rare word is known by its shape (runs of capitals, small letters
and digits, and its other signs), and a word that repeats the one before by how
often it has been repeated.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free, slices, small, written

HELD = 340_000  # n-grams that a task holds; where the model has more, the others are met in joins
LEAST_SHARE, LEAST_COUNT = 1e-4, 3  # of all tokens, and occurrences; rarer words are known by their shape
LEAST_SHAPE = 1e-6  # of all tokens; rarer shapes are unknown words, so that tasks can hold the vocabulary
LONG = 60  # characters of a word at most
SHRINK = 12.0  # tokens' worth of the language's median in each score
QUANTILE, MARGIN = 0.99, 0.3  # the threshold lies MARGIN above this quantile
_UNKNOWN, _REPEATS, _BEGIN, _FIRST = 0, 5, 6, 7  # ids of what isn't a word; 1 to _REPEATS: so many repeats in a row
_KEEP = 60_000  # rare words whose ids a worker remembers

_RUNS = ((re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^Aa0])\1+"), r"\1\1"))


def shape(word: str) -> str:
    """The shape of a word: A, a and 0 for runs of capitals, small letters and digits, other signs as
    they are, but no more than two in a row; shapes end after eight places."""
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return "\0" + word[:8]


def parts(text: str | None) -> list[str]:
    """The words of a text; what has no white space for LONG characters is cut there into words, so that
    every character counts."""
    found = (text or "").split()
    if max(map(len, found), default=0) <= LONG:
        return found
    return [w[k : k + LONG] for w in found for k in range(0, len(w), LONG)]


class Tokens:
    """Ids of words by a vocabulary of words and shapes."""

    def __init__(self, vocabulary: list[str]):
        self.id = {w: _FIRST + k for k, w in enumerate(vocabulary)}
        self.size = _FIRST + len(vocabulary)
        self.rare: dict[str, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        words = parts(text)
        get, rare, out = self.id.get, self.rare, []
        if len(rare) > _KEEP:
            rare.clear()
        last, run = None, 0
        for w in words:
            if w == last:
                run += 1
                out.append(min(run, _REPEATS))
                continue
            last, run = w, 0
            i = get(w)
            if i is None:
                i = rare.get(w)
                if i is None:
                    i = rare[w] = get(shape(w), _UNKNOWN)
            out.append(i)
        return np.array(out, dtype=np.int64)


def grams(ids: np.ndarray, size: int) -> np.ndarray:
    """The trigram that ends at each place, as one number."""
    padded = np.concatenate([np.full(2, _BEGIN, dtype=np.int64), ids])
    return (padded[:-2] * size + padded[1:-1]) * size + padded[2:]


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (counts_of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too few n-grams to estimate from
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _cut(c: str, d: tuple[float, float, float]):
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def _estimate(table: DataFrame, context: str, lower: DataFrame, d: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(key, c, p) of each n-gram and (context, back) of each context, from rows (key, context,
    suffix, c) and the lower order's (suffix, q)."""
    sums = table.groupBy(context).agg(F.sum("c").alias("total"), F.sum(_cut("c", d)).alias("cut")).withColumn("back", F.col("cut") / F.col("total"))
    rows = table.join(sums, context).join(lower, "suffix")
    return rows.select("key", "c", ((F.col("c") - _cut("c", d)) / F.col("total") + F.col("back") * F.col("q")).alias("p")), sums.select(context, "back")


def _of_counts(table: DataFrame) -> dict[int, int]:
    return {r.c: r.n for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}


class _Table:
    """A read-only map from numbers to numbers by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.down = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 128, -1, dtype=np.int64)
        self.values = np.zeros((1 << bits) + 128, dtype=np.float32)
        spot = self._spot(keys)
        while len(keys):
            first = np.zeros(len(keys), dtype=bool)
            free = self.keys[spot] < 0
            first[np.unique(np.where(free, spot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[spot[put]], self.values[spot[put]] = keys[put], values[put]
            keys, values, spot = keys[~put], values[~put], spot[~put] + 1

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def get(self, keys: np.ndarray, absent: float) -> np.ndarray:
        spot = self._spot(keys)
        there = self.keys[spot]
        out = np.where(there == keys, self.values[spot], np.float32(absent))
        off = np.flatnonzero((there != keys) & (there >= 0))
        while len(off):
            spot[off] += 1
            there = self.keys[spot[off]]
            hit = off[there == keys[off]]
            out[hit] = self.values[spot[hit]]
            off = off[(there != keys[off]) & (there >= 0)]
        return out


class KneserNey:
    """What tasks hold of the model: log10-probabilities of trigrams, backed by bigrams and single tokens, or
    if the model is not ``whole`` only those of frequent trigrams."""

    def __init__(self, tokens: Tokens, one: np.ndarray, three, back_three=None, two=None, back_two=None):
        self.tokens, self.whole = tokens, two is not None
        log = lambda rows, c: _Table(rows.column(0).to_numpy(), np.log10(rows.column(c).to_numpy()).astype(np.float32))
        self.three = log(three, "p")
        if self.whole:
            self.back_three, self.two, self.back_two = log(back_three, "back"), log(two, "p"), log(back_two, "back")
            self.one = np.log10(one).astype(np.float32)

    def log10(self, trigrams: np.ndarray) -> np.ndarray:
        """NaN where only the rest of the model tells."""
        size = self.tokens.size
        found = self.three.get(trigrams, np.nan)
        if not self.whole:
            return found
        k = np.flatnonzero(np.isnan(found))
        rest = trigrams[k]
        bigram = rest % (size * size)
        lower = self.two.get(bigram, np.nan)
        j = np.flatnonzero(np.isnan(lower))
        lower[j] = self.back_two.get(bigram[j] // size, 0.0) + self.one[bigram[j] % size]
        found[k] = self.back_three.get(rest // size, 0.0) + lower
        return found


class Rest:
    """The model as tables, for trigrams that tasks don't hold."""

    def __init__(self, size: int, one: DataFrame, unseen: float, three: DataFrame, back_three: DataFrame, two: DataFrame, back_two: DataFrame):
        self.size, self.unseen, self.three = size, unseen, three
        self.one, self.two, self.back_three, self.back_two = (F.broadcast(t) if t.count() <= HELD else t for t in (one, two, back_three, back_two))

    def log10(self, keys: DataFrame) -> DataFrame:
        """(key, log10) of distinct trigrams, in the same way as KneserNey.log10."""
        size, bigram = self.size, F.col("key") % (self.size * self.size)
        rows = keys.join(self.three.select("key", F.col("p").alias("p3")), "key", "left")
        rows = rows.withColumns({"context3": F.expr(f"key div {size}L"), "bigram": bigram, "context2": F.expr(f"key % {size * size}L div {size}L"), "suffix": F.col("key") % size})
        rows = rows.join(self.back_three.select(F.col("context").alias("context3"), F.col("back").alias("back3")), "context3", "left")
        rows = rows.join(self.two.select(F.col("key").alias("bigram"), F.col("p").alias("p2")), "bigram", "left")
        rows = rows.join(self.back_two.select(F.col("context").alias("context2"), F.col("back").alias("back2")), "context2", "left").join(self.one, "suffix", "left")
        weight = lambda c: F.log10(F.coalesce(c, F.lit(1.0)))
        lower = F.coalesce(F.log10("p2"), weight("back2") + F.log10(F.coalesce("q", F.lit(self.unseen))))
        return rows.select("key", F.coalesce(F.log10("p3"), weight("back3") + lower).alias("log10"))


def _in_half(k: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k


def _picked(docs: DataFrame, trusted: DataFrame, max_docs: int | None, max_chars: int | None) -> list[int]:
    """At most so many ids of the first half, in the order of the hash, with at most so many characters."""
    found = docs.select("doc_id", F.length("text").alias("n")).where("n > 0").where(_in_half(0)).join(trusted.select("doc_id").distinct(), "doc_id")
    found = found.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id")  # all rows of an id are read
    picked, chars = [], 0
    for r in (found if max_docs is None else found.limit(max_docs)).collect():
        if max_chars is None or chars + r.n <= max_chars:
            chars += r.n
            picked.append(r.doc_id)
    return picked


def _held(three: DataFrame) -> DataFrame:
    """The most frequent trigrams, HELD at most."""
    level = F.floor(F.log2("c") * 64)
    levels = three.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # some thousands of rows at most
    kept = np.cumsum([r.n for r in levels]) <= HELD
    return three.where(level >= levels[kept.sum() - 1].level) if kept.any() else three.limit(0)


def learned(texts: DataFrame) -> tuple[KneserNey, Rest | None]:
    """The model of all rows of ``texts`` (text): what tasks hold, and the whole of it as tables where that is
    more. The vocabulary (words and shapes by their shares of all tokens) and HELD n-grams at most
    reach the driver."""
    spark = texts.sparkSession

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = Counter(w for t in batch.column(0).to_pylist() for w in parts(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = Counter()
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[shape(w)] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    words = written(texts.mapInArrow(word_counts, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    often = F.col("c") >= max(LEAST_COUNT, LEAST_SHARE * total)
    shapes = words.where(~often).mapInArrow(shaped, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where(F.col("c") >= max(LEAST_COUNT, LEAST_SHAPE * total))
    tokens = Tokens([w for rows in (words.where(often), shapes) for w in sorted(r.word for r in rows.collect())])
    size, sent = tokens.size, spark.sparkContext.broadcast(tokens)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            all_of = [grams(sent.value.ids(t), size) for t in batch.column(0).to_pylist()]
            keys, counts = np.unique(np.concatenate(all_of), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "c"])

    three = written(texts.mapInArrow(trigrams, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")), "trigrams")
    three = three.select("key", "c", F.expr(f"key div {size}L").alias("context"), (F.col("key") % (size * size)).alias("suffix"))
    two = written(three.groupBy(F.col("suffix").alias("key")).agg(F.count("*").alias("c")), "bigrams")
    two = two.select("key", "c", F.expr(f"key div {size}L").alias("context"), (F.col("key") % size).alias("suffix"))
    one = two.groupBy(F.col("suffix").alias("key")).agg(F.count("*").alias("c"))

    singles = one.toPandas()
    total, d = singles["c"].sum(), discounts(Counter(singles["c"].tolist()))
    cut = np.select([singles["c"] == 1, singles["c"] == 2], d[:2], d[2])
    unseen = float(cut.sum() / total / size)
    p1 = np.full(size, unseen)
    p1[singles["key"]] += (singles["c"] - cut) / total
    lower = spark.createDataFrame([(int(k), float(p1[k])) for k in singles["key"]], "suffix bigint, q double")
    p2, back2 = _estimate(two, "context", lower, discounts(_of_counts(two)))
    p2 = written(p2, "bigrams")
    p3, back3 = _estimate(three, "context", p2.select(F.col("key").alias("suffix"), F.col("p").alias("q")), discounts(_of_counts(three)))
    if three.count() + 2 * two.count() <= HELD:
        return KneserNey(tokens, p1, p3.select("key", "p").toArrow(), *(f.toArrow() for f in (back3, p2.select("key", "p"), back2))), None
    p3, back3 = written(p3, "trigrams"), written(back3, "contexts")
    return KneserNey(tokens, p1, _held(p3).select("key", "p").toArrow()), Rest(size, lower, unseen, p3, back3, p2, back2)


def fit(docs: DataFrame, trusted: DataFrame, max_docs: int | None = None, max_chars: int | None = None) -> tuple[KneserNey | None, list[int] | None]:
    """learned() of trusted texts: all those whose ids are in the first half by a hash, or, for a model of bounded size,
    whole texts in the order of that hash up to ``max_docs`` of them and ``max_chars`` characters. With
    the model come the ids, or None for the whole half. (None, []) if there is no text."""
    model, _, picked = _fitted(docs, trusted, max_docs, max_chars)
    return model, picked


def _fitted(docs: DataFrame, trusted: DataFrame, max_docs: int | None = None, max_chars: int | None = None):
    picked, ids = None, trusted.select("doc_id").where(_in_half(0)).distinct()
    if max_docs is not None or max_chars is not None:
        picked = _picked(docs, trusted, max_docs, max_chars)
        ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id bigint")
    texts = docs.select("doc_id", "text").where(_in_half(0)).where(F.length("text") > 0)
    texts = written(texts.join(small(ids), "doc_id", "left_semi").select("text"), "trusted")
    return (None, None, []) if texts.isEmpty() else (*learned(texts), picked)


def scored(docs: DataFrame, model: KneserNey, sum_name: str = "_sum", tokens_name: str = "_tokens", missed_name: str = "_missed", with_text: bool = True) -> DataFrame:
    """Adds the negative log10-probability of the whole text and its tokens to every row, and those trigrams
    that the sum leaves to the rest of the model."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    fields = [f for k, f in enumerate(docs.schema.fields) if with_text or k != place]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{sum_name}` double, `{tokens_name}` bigint, `{missed_name}` array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            ids = [own.tokens.ids(t) for t in batch.column(place).to_pylist()]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            all_of = np.concatenate([*(grams(i, own.tokens.size) for i in ids), np.zeros(0, dtype=np.int64)])
            found = own.log10(all_of)
            missed = np.isnan(found)
            sums = np.concatenate([[0.0], np.cumsum(np.where(missed, 0.0, found))])
            ends = np.cumsum(sizes)
            cuts = np.append(0, np.cumsum(missed))[np.append(0, ends)]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(all_of[missed]))
            kept = [c for k, c in enumerate(batch.columns) if with_text or k != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[ends - sizes] - sums[ends]), pa.array(sizes), lists], names=[*names, sum_name, tokens_name, missed_name])

    return docs.mapInArrow(run, schema)


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, margin: float, with_text: bool, **bounds) -> tuple[DataFrame, DataFrame, str] | None:
    """The rows of ``docs`` with a number each, perplexity, threshold and rejected by that number, and the name
    of the number; None without a model."""
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    model, more, used = _fitted(docs, trusted, **bounds)
    if model is None:
        return None
    row, total, tokens, missed = (free(c, docs.columns) for c in ("_row", "_sum", "_tokens", "_missed"))
    rows = written(scored(docs.withColumn(row, F.monotonically_increasing_id()), model, total, tokens, missed, with_text), "scored")
    slim = rows.select(row, "doc_id", "lang", total, tokens)
    if more is not None:
        places = rows.select(row, F.explode(missed).alias("key"))
        left = places.join(more.log10(places.select("key").distinct()), "key").groupBy(row).agg(F.sum("log10").alias("_more"))
        slim = written(slim.join(left, row, "left").withColumn(total, F.col(total) - F.coalesce("_more", F.lit(0.0))).drop("_more"), "sums")
    rest = slim.where(F.col(tokens) > 0).join(trusted, "doc_id", "left_semi")
    if used is None:
        rest = rest.where(_in_half(1))
    else:
        rest = rest.join(small(docs.sparkSession.createDataFrame([(i,) for i in used], "doc_id bigint")), "doc_id", "left_anti")
    plain = rest.withColumn("mean", F.col(total) / F.col(tokens))
    overall = plain.agg(F.percentile_approx("mean", 0.5, 10_000)).first()[0]
    if overall is None:  # every trusted text was learned from
        overall = slim.where(F.col(tokens) > 0).agg(F.percentile_approx(F.col(total) / F.col(tokens), 0.5, 10_000)).first()[0] or 0.0
    medians = plain.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("mean", 0.5, 10_000).alias("_median"))
    score = (F.col(total) + SHRINK * F.coalesce("_median", F.lit(float(overall)))) / (F.col(tokens) + SHRINK)
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    medians = written(medians, "medians")
    final = written(rest.join(small(medians), same, "left").select("lang", score.alias("score")), "scores")
    top = final.agg(F.percentile_approx("score", quantile, 10_000)).first()[0]
    # the lift towards the limit of all languages falls with the texts that are expected beyond the quantile
    own = final.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"), F.percentile_approx("score", quantile, 10_000).alias("_q"))
    lift = F.greatest(F.lit(0.0), F.lit(top) - F.col("_q")) / (1 + F.col("_n") * (1 - quantile))
    limits = written(own.join(medians.withColumnRenamed("_lang", "_other"), F.col("_lang").eqNullSafe(F.col("_other"))).select("_lang", "_median", (F.col("_q") + lift + margin).alias("_limit")), "limits")
    limit = F.coalesce("_limit", F.lit(math.inf))
    told = slim.join(small(limits), same, "left").select(row, F.pow(F.lit(10.0), score).alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"), ((F.col(tokens) > 0) & (score > limit)).alias("rejected"))
    return rows.drop(total, tokens, missed), told, row


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in docs.columns if c not in ("perplexity", "threshold", "rejected")])


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, with_text: bool = True, **bounds) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text and lang are read) with ``perplexity``,
    ``threshold`` and ``rejected``; columns of these names are replaced. Not ``with_text``, the text is left out.

    ``labels`` has doc_id and quality; rows with quality 1 are trusted. The model learns from one half of them
    (or, with ``bounds``, from less: see fit); the medians and thresholds are taken over all others. perplexity is
    10 ** score, threshold that of the row's language: its own quantile plus the margin, lifted towards the
    quantile of all languages (never lowered) by the less the more texts it has. A language without such texts
    has no threshold (infinity): none of its rows is rejected. Medians and thresholds are a table by language,
    which is sent to every task if it is small and joined if not. Nulls: a null text is empty, a null lang is a
    language of its own, a null doc_id has no label. Empty texts have no tokens and are never rejected.
    Repeated rows are each classified; without trusted texts no row is rejected and perplexity is null.
    """
    docs = _plain(docs)
    found = _judged(docs, labels, quantile, margin, with_text, **bounds)
    if found is None:
        docs = docs if with_text else docs.drop("text")
        return docs.withColumns({"perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "rejected": F.lit(False)})
    rows, told, row = found
    return rows.join(told, row).drop(row)


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, **bounds) -> DataFrame:
    """The rows and columns of ``docs`` that classify() doesn't reject; texts stay where they are, as long as the
    rejected rows are few enough to be sent to every task."""
    found = _judged(_plain(docs), labels, quantile, margin, True, **bounds)
    if found is None:
        return docs
    rows, told, row = found
    return rows.join(small(written(told.where("rejected").select(row), "rejected")), row, "left_anti").drop(row)
