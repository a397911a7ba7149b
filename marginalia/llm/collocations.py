"""Phrase collocations by pivot partitions.

Every word of a language has a place in an order from frequent to rare, and an n-gram is owned by its rarest
word, its pivot (the leftmost, if that word repeats). Each occurrence of a word sends the stretch around it,
up to the next rarer word on each side and cut at words that are too rare for any phrase, to the
partition of that word; there the n-grams through the occurrence are counted, from pairs to longer ones, and
no other partition counts them. Equal stretches are combined before they are sent. Words so frequent that one task could not hold their
partition have it dealt by stretch, and the parts are summed.

The order comes from an array of CELLS bytes that every task has: the size of the largest count among the
words that fall on a cell, 0 where none of them is frequent enough. It has the same size for any corpus; words
on one cell are told apart by their hashes, so the order is one of all words, whatever falls together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import slices, written

NO_LANG = "und"
CELLS_BITS = 24
_CHUNK_BITS = 14  # cells that reach the driver as one row
_LEVELS = 4  # sizes of counts to a power of 2; 63 powers are 252 sizes
_FLUSH = 200_000  # distinct words or stretches that a task holds before it passes their counts on
_WORDS = 1 << 20  # words of a text that are looked at at once
_SEED = 11

#: A-Z as a-z, blanks as blanks, and a sign of its own for what ends a piece; no word has one of these.
_END = b"."
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c in b"\x20\x09" else c for c in range(256))
_BETWEEN = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


def tokens(text: bytes, block: int = _WORDS) -> Iterator[list[bytes]]:
    """The words of a text and _END after each piece, about ``block`` at a time; a list goes on where the last
    one ended."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + 8 * block)  # not within a word
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_BYTES).replace(_END, b" . ").split()
        at = end
    yield [_END]


def _by_lang(batch: pa.RecordBatch, block: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens) of the texts of a batch (lang, text)."""
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        raw = text.as_py()
        if raw:
            for part in tokens(raw, block):
                yield lang, part


def word_counts(texts: DataFrame, flush: int = _FLUSH, block: int = _WORDS) -> DataFrame:
    """(lang, word, c) over all words of the rows (lang, text)."""
    names = ["lang", "word", "c"]

    def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            own.pop(_END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, part in _by_lang(batch, block):
                seen.setdefault(lang, Counter()).update(part)
            if sum(map(len, seen.values())) > flush:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    return texts.mapInArrow(run, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def _hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def levels(frequent: DataFrame, bits: int = CELLS_BITS) -> np.ndarray:
    """The array of cells for words (lang, word, c). It is put together from chunks that tasks fill; only
    those with a frequent word reach the driver, 2^bits bytes at most."""
    names = ["cell", "level"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(_hash(lang, [word])[0]) >> (64 - bits) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
            sizes = 1 + np.floor(np.log2(batch.column(2).to_numpy()) * _LEVELS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sizes)], names=names)

    def chunk(rows: pa.Table) -> pa.Table:
        at, level = (rows.column(c).to_numpy() for c in ("cell", "level"))
        own = np.zeros(1 << _CHUNK_BITS, dtype=np.uint8)
        np.maximum.at(own, at & ((1 << _CHUNK_BITS) - 1), level.astype(np.uint8))
        return pa.table([pa.array([int(at[0]) >> _CHUNK_BITS], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "levels"])

    each = frequent.select("lang", "word", "c").mapInArrow(cells, "cell bigint, level int").groupBy("cell").agg(F.max("level").alias("level"))
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in each.groupBy(F.shiftright("cell", _CHUNK_BITS)).applyInArrow(chunk, "chunk bigint, levels binary").toLocalIterator():
        own = np.frombuffer(r.levels, dtype=np.uint8)[: len(out)]
        out[r.chunk << _CHUNK_BITS : (r.chunk << _CHUNK_BITS) + len(own)] = own
    return out


class _Places(dict):
    """The place of each word of one language in the order: frequent words first; the last place is that of
    words that are in no phrase."""

    def __init__(self, lang: str, cells: np.ndarray):
        super().__init__({_END: _NOWHERE})
        self.seed, self.cells, self.shift = xxhash.xxh64_intdigest(lang.encode(), _SEED), cells, 64 - (len(cells).bit_length() - 1)

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        level = int(self.cells[h >> self.shift])
        self[word] = found = (255 - level) << 54 | h & ((1 << 54) - 1) if level else _NOWHERE
        return found


_NOWHERE = 1 << 62


def stretches(words: list[bytes], places: np.ndarray, start: int, stop: int, longest: int) -> Iterator[bytes]:
    """The stretch of each word from ``start`` to ``stop`` that has a word beside it which is no rarer, after a byte
    that says how many words stand before it; those are more frequent, what is after it too, or the word itself."""
    n, wide = len(places), longest - 1
    padded = np.full(n + 2 * wide, _NOWHERE, dtype=np.int64)
    padded[wide : wide + n] = places
    left, right = (np.zeros(n, dtype=np.int64) for _ in range(2))
    go_left = go_right = places < _NOWHERE
    for k in range(1, longest):
        go_left = go_left & (padded[wide - k : wide - k + n] < places)
        go_right = go_right & (padded[wide + k : wide + k + n] <= places)
        left += go_left
        right += go_right
    at = start + np.flatnonzero((left + right)[start:stop])
    before, join = [bytes([k]) for k in range(longest)], b" ".join
    return (before[a] + join(words[i:e]) for a, i, e in zip(left[at].tolist(), (at - left[at]).tolist(), (at + right[at] + 1).tolist()))


def routed(texts: DataFrame, cells: Broadcast, longest: int, flush: int = _FLUSH, block: int = _WORDS) -> DataFrame:
    """(lang, pivot, stretch, c): what occurrences send (see stretches), combined in each task."""
    names = ["lang", "pivot", "stretch", "c"]

    def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            pivots = [x[1:].split(b" ", x[0] + 1)[x[0]] for x in own]
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(pivots, pa.binary()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Places] = {}
        seen: dict[str, Counter] = {}

        def look(lang: str, words: list[bytes], start: int, stop: int) -> None:
            if lang not in known:
                known[lang] = _Places(lang, cells.value)
            places = np.fromiter(map(known[lang].__getitem__, words), dtype=np.int64, count=len(words))
            seen.setdefault(lang, Counter()).update(stretches(words, places, start, stop, longest))

        for batch in slices(batches):
            held: dict[str, list[bytes]] = {}  # texts of a language one after the other
            done: dict[str, int] = {}  # how many of them have been looked at, the rest stand for what follows
            for lang, part in _by_lang(batch, block):
                own = held.setdefault(lang, [])
                own += part
                if len(own) > block:
                    stop = len(own) - longest + 1
                    look(lang, own, done.get(lang, 0), stop)
                    kept = min(stop, longest - 1)
                    held[lang], done[lang] = own[stop - kept :], kept
            for lang, own in held.items():
                look(lang, own, done.get(lang, 0), len(own))
            if sum(map(len, known.values())) > flush:
                known = {}
            if sum(map(len, seen.values())) > flush:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    return texts.mapInArrow(run, "lang string, pivot binary, stretch binary, c bigint")


def owned(pivot: bytes, sent: list[bytes], times: list[int], least: int, longest: int) -> dict[bytes, int]:
    """The n-grams of one pivot that occur ``least`` times in the stretches that were sent to it. Those of two words
    come first: whatever is longer holds one of them, and is counted only where that one is kept."""
    split = [x[1:].split(b" ") for x in sent]
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    for x, words, c in zip(sent, split, times):
        at = x[0]
        if at:
            w = words[at - 1]
            left[w] = left.get(w, 0) + c
        if at + 1 < len(words):
            w = words[at + 1]
            right[w] = right.get(w, 0) + c
    left, right = ({w: c for w, c in side.items() if c >= least} for side in (left, right))
    out = {w + b" " + pivot: c for w, c in left.items()} | {pivot + b" " + w: c for w, c in right.items()}
    longer: dict[bytes, int] = {}
    join = b" ".join
    for x, words, c in zip(sent, split, times):
        if len(words) == 2:
            continue
        at = x[0]
        before = at if at and words[at - 1] in left else 0
        after = len(words) - at - 1
        if after and words[at + 1] not in right:
            after = 0
        if before + after > 1:
            for i in range(before + 1):
                for j in range(max(0, 2 - i), min(after, longest - 1 - i) + 1):
                    p = join(words[at - i : at + j + 1])
                    longer[p] = longer.get(p, 0) + c
    out.update((p, c) for p, c in longer.items() if c >= least)
    return out


def mined(sent: DataFrame, words: DataFrame, least: int, longest: int, tasks: int) -> DataFrame:
    """(lang, phrase, hot, a): what partitions count. ``words`` has (lang, word, c): one with more than an eighth of a
    task's share of all words is hot, and dealt by stretch; its phrases have a count in each part, however small."""
    every = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = words.where(F.col("c") * 8 * tasks > every).select("lang", F.col("word").cast("binary").alias("pivot"), F.lit(True).alias("hot"))  # fewer than 8 rows a task
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("stretch"), F.lit(tasks))).otherwise(F.lit(-1))
    dealt = sent.join(F.broadcast(hot), ["lang", "pivot"], "left").select("lang", "pivot", share.cast("int").alias("part"), "stretch", "c")
    names = ["lang", "phrase", "hot", "a"]
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, times = None, [], []  # the key that the rows are of so far
        out: list[tuple] = []

        def mine() -> None:
            lang, pivot, part = now
            out.extend((lang, p, part >= 0, a) for p, a in owned(pivot, held, times, least if part < 0 else 1, longest).items())

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            n, keys = batch.num_rows, [batch.column(k) for k in range(3)]
            same = np.ones(n - 1, dtype=bool)
            for c in keys:
                same &= pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
            sent_here, times_here = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in (3, 4))  # a scalar each would take longer
            for a, b in zip(edges, edges[1:]):
                key = tuple(c[a].as_py() for c in keys)
                if key != now:
                    if held:
                        mine()
                    now, held, times = key, [], []
                held += sent_here[a:b]
                times += times_here[a:b]
            if len(out) > _FLUSH:
                yield rows()
                out = []
        if held:
            mine()
        if out:
            yield rows()

    keys = ["lang", "pivot", "part"]
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, phrase string, hot boolean, a bigint")


def phrases(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a) of the n-grams that occur ``least`` times, from what partitions have counted."""
    parts = found.where("hot").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("NOT hot").select("lang", "phrase", "a").union(parts)


def _exact(c: Column) -> Column:
    return c.cast("decimal(30,0)")


def _cut(k: int) -> tuple[Column, Column]:
    """The first k words of a phrase, and the rest."""
    first = F.substring_index("phrase", " ", k)
    return first, F.substr("phrase", F.length(first) + 2)


def scored(found: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) for phrases (lang, phrase, a): the lowest-scoring cut."""
    size = F.size(F.split("phrase", " ", -1))
    cuts = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), _cut(k)[0].alias("first"), _cut(k)[1].alias("rest")) for k in range(1, longest))), lambda s: s["k"] < size))
    each = found.withColumn("_c", cuts).select("lang", "phrase", "a", "_c.*")
    counts = found.select("lang", "phrase", "a").union(words.select("lang", "word", "c"))
    for side, name in (("first", "l"), ("rest", "r")):
        each = each.join(counts.toDF("lang", side, name), ["lang", side])
    value = F.expr("CAST(2000000 AS DECIMAL(30,0)) * a div (CAST(l AS DECIMAL(30,0)) + r)")
    least = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("_m")
    return each.groupBy("lang", "phrase").agg(F.first("a").alias("a"), least).select("lang", "phrase", "a", "_m.l", "_m.r", "_m.score")


def covered(found: DataFrame, longest: int, share: int) -> DataFrame:
    """(lang, phrase, longer) of the phrases within a longer one, with the count of the most frequent of those."""
    parts = F.split("phrase", " ", -1)
    spans = [(at, size) for size in range(2, longest) for at in range(longest - size + 1)]
    inside = F.array(*(F.when((F.size(parts) > size) & (F.size(parts) >= at + size), F.array_join(F.slice(parts, at + 1, size), " ")) for at, size in spans))
    return found.select("lang", F.explode(inside).alias("phrase"), "a").where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``most`` phrases of 2 to ``longest`` words that occur ``least`` times.

    ``docs`` has the columns ``text`` and ``lang``; no other is read. A-Z count as a-z; phrases lie within
    pieces, which end at ``.,;:!?`` and at line ends; words stand between blanks. f counts all occurrences
    in a language. A phrase's score is floor(2000000 a / (l + r)) for the cut into two parts (a = f(phrase), l and
    r those of the parts) that makes it lowest, the first such cut; phrases inside a longer one with
    100 f(longer) >= ``share`` a are left out. Returns lang, rank (from 1: by score and a, descending, then
    phrase in the order of its UTF-8), phrase, a, l, r, n (the language's words) and score. Null and empty texts
    have no words, a null language is ``und``; repeated rows count each; texts and words of any length go through
    whole; an empty table gives no rows.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    counts = written(word_counts(texts), "words")
    total = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    words = written(counts.where(F.col("c") >= least), "frequent")
    cells = docs.sparkSession.sparkContext.broadcast(levels(words))  # 2^CELLS_BITS bytes
    found = written(phrases(written(mined(routed(texts, cells, longest), words, least, longest, tasks), "mined"), least), "phrases")
    kept = scored(found, words, longest).join(covered(found, longest, share), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * _exact(F.col("longer")) < share * _exact(F.col("a")))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for groups in (tasks, max(1, int(tasks**0.5))):  # the first of each part, so that no task sorts a whole language
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
