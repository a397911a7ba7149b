"""LM scoring: a log-bilinear model of words, trained by noise-contrastive estimation in numpy.

Targets are the VOCABULARY most frequent words, the end of a text, and TAILS kinds of other words (by
their last two bytes); a word of a tail has its share of the tail by the corpus counts. The score of a
target after two words is ``(far . A + near . B) . target + bias``, with learned vectors and matrices.
The words before a target have a vector each if they are frequent (NEAR_OWN, FAR_OWN), or that of their
tail. That leaves NEAR * FAR contexts, so the normaliser of every one is taken exactly, over all targets,
by batched matrix products; the probabilities of all words after any context sum to 1, where the words
that were never seen have one place in each tail.

Counts of words are taken over all training texts. The network too goes through every token of every
training text: trainers, as many as there are TRAINER tokens, learn from their own texts from one common
start, and the vectors are averaged by how many examples moved them. So work and evidence grow with the corpus, a task holds one model and one
buffer of tokens, and the driver holds one model.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BATCH_ROWS, slices, written

TAILS = 256
VOCABULARY = (1 << 16) - TAILS  # targets of their own, the end among them; all ids fit 16 bits
NEAR_OWN, FAR_OWN = 256, 16  # words that have a vector of their own as the last word, and the last but one
NEAR, FAR = NEAR_OWN + TAILS, 32
SIZE = 16  # of a vector
END = b""  # no word is empty
HEAD = 1 << 18  # words, at most, whose counts every task has; all other words meet their counts in a join
HEAD_BYTES = 64  # of a word of the head
TRAINER = 1 << 21  # tokens, about, that one trainer learns from
_FLUSH, _FLUSH_BYTES = 200_000, 32 << 20  # distinct words that a task holds before it passes their counts on
_BUFFER = 1 << 22  # tokens whose examples a task counts at once
_ADD = 0.1


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z as a-z, ended by END."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail(word: bytes) -> int:
    """Which of the tails a word belongs to."""
    return zlib.crc32(word[-2:]) % TAILS


# -- counts ----------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c bigint) over all whole texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
            if len(seen) > _FLUSH or sum(map(len, seen)) > _FLUSH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words of HEAD_BYTES at most above some count, ``most`` at most, most frequent first, and their counts. The count is
    found from how many words have counts of about a size, 16 sizes to a power of 2, so only those words
    are sent."""
    counts = counts.where(F.length("word") <= HEAD_BYTES)
    sizes = counts.groupBy(F.floor(F.log2("c") * 16).alias("s")).agg(F.count("*").alias("n")).collect()
    least, seen = math.inf, 0
    for r in sorted(sizes, key=lambda r: -r.s):
        seen += r.n
        if seen > most:
            break
        least = r.s
    if least == math.inf:
        return [], np.zeros(0, dtype=np.int64)
    rows = counts.where(F.floor(F.log2("c") * 16) >= int(least)).select("word", "c").toArrow()  # ``most`` rows
    found, c = rows.column("word").to_pylist(), rows.column("c").to_numpy()
    order = sorted(range(len(found)), key=lambda k: (-c[k], found[k]))
    return [found[k] for k in order], c[order]


class Vocabulary:
    """The place of each head word, its count, and its target."""

    def __init__(self, head: list[bytes], counts: np.ndarray, most: int = VOCABULARY):
        self.size = most
        self.place = {w: k for k, w in enumerate(head)}
        self.counts = counts.astype(np.float64)
        own = [w for w in head if w != END][: most - 1]
        target = {END: 0} | {w: k + 1 for k, w in enumerate(own)}
        self.target = np.array([target.get(w, most + tail(w)) for w in head], dtype=np.uint16)
        self.targets = most + TAILS
        kinds = np.array([0, *(tail(w) for w in own), *(0 for _ in range(most - 1 - len(own))), *range(TAILS)])
        ids = np.arange(self.targets)
        self.near = np.where(ids < min(most, NEAR_OWN), ids, NEAR_OWN + kinds).astype(np.int32)
        self.far = np.where(ids < min(most, FAR_OWN), ids, FAR_OWN + kinds % (FAR - FAR_OWN)).astype(np.int32)

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, target) of each word."""
        get = self.place.get
        places = np.array([get(w, -1) for w in tokens], dtype=np.int64)
        rare = np.flatnonzero(places < 0)
        found = self.target[places] if len(self.target) else np.zeros(len(places), dtype=np.uint16)
        for k in rare.tolist():
            found[k] = self.size + tail(tokens[k]) if tokens[k] != END else 0
        return places, found


# -- the network -----------------------------------------------------------------------------


class LogBilinear:
    """Scores of targets after the vectors of two words before them. At first the targets' vectors are 0
    and their biases the logarithms of their shares, so the untrained model is that of single words."""

    def __init__(self, share: np.ndarray, near: int = NEAR, far: int = FAR, size: int = SIZE, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = (share + 0.5) / (share + 0.5).sum()
        self.log_share, self.cumulative = np.log(share).astype(np.float32), np.cumsum(share)
        normal = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
        self.p = {
            "near": normal(near, size), "far": normal(far, size), "target": np.zeros((len(share), size), dtype=np.float32), "bias": np.zeros((len(share), 1), dtype=np.float32),
            "A": np.eye(size, dtype=np.float32) * np.float32(0.5), "B": np.eye(size, dtype=np.float32),
        }

    def copy(self) -> LogBilinear:
        """A model with arrays of its own, so that training leaves this one as it is."""
        other = copy.copy(self)
        other.p = {k: v.copy() for k, v in self.p.items()}
        return other

    def start(self, rate: float = 0.05) -> None:
        """Forgets what training has seen."""
        self.rate = np.float32(rate)
        self.square = {k: np.full((len(v), 1), 1e-6, dtype=np.float32) for k, v in self.p.items()}
        self.moved = {k: np.zeros(len(v)) for k, v in self.p.items()}

    def _row_step(self, name: str, rows: np.ndarray, grad: np.ndarray, times: np.ndarray) -> None:
        """A step of Adagrad on distinct rows, one rate a row."""
        square = self.square[name]
        square[rows] += np.einsum("ij,ij->i", grad, grad)[:, None] / np.float32(grad.shape[1])
        self.p[name][rows] -= self.rate * grad / np.sqrt(square[rows])
        self.moved[name][rows] += times

    def _summed(self, rows: np.ndarray, grad: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        return ranked[starts], np.add.reduceat(grad[order], starts, axis=0), np.add.reduceat(count[order], starts)

    def step(self, far: np.ndarray, near: np.ndarray, true: np.ndarray, count: np.ndarray, noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation on examples that occur ``count`` times: tells the true
        targets from ``noise``, targets drawn by their shares, which the examples of a batch share."""
        p, k = self.p, np.float32(math.log(len(noise)))
        rf, rn = p["far"][far], p["near"][near]
        h = rf @ p["A"] + rn @ p["B"]
        t, u = p["target"][true], p["target"][noise]
        # the shares stand in the score and in the noise alike, and cancel
        gain = 1 / (1 + np.exp(np.clip(k - np.einsum("bd,bd->b", h, t) - p["bias"][true, 0], -30, 30))) - 1
        false = h @ u.T
        false += p["bias"][noise, 0] - k
        np.clip(false, -30, 30, out=false)
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        gain *= count
        false *= count[:, None]
        dh = gain[:, None] * t + false @ u
        rows = np.concatenate([true, noise])
        grad = np.empty((len(rows), h.shape[1] + 1), dtype=np.float32)
        grad[: len(true), :-1], grad[: len(true), -1] = gain[:, None] * h, gain
        grad[len(true) :, :-1], grad[len(true) :, -1] = false.T @ h, false.sum(axis=0)
        rows, grad, times = self._summed(rows, grad, np.concatenate([count, np.zeros(len(noise), dtype=count.dtype)]))
        dn, df = dh @ p["B"].T, dh @ p["A"].T
        da, db = rf.T @ dh, rn.T @ dh
        self._row_step("target", rows, grad[:, :-1], times)
        self._row_step("bias", rows, grad[:, -1:], times)
        self._row_step("near", *self._summed(near.astype(np.int16), dn, count))
        self._row_step("far", *self._summed(far.astype(np.int16), df, count))
        for name, g in (("A", da), ("B", db)):
            self._row_step(name, np.arange(len(g)), g, np.full(len(g), count.sum()))

    def train(self, keys: np.ndarray, counts: np.ndarray, rng, batch: int = 2048, noise: int = 64, most: int = 32) -> int:
        """Goes through all examples (keys as in pack), each in as many turns as its count needs at ``most``
        a turn, in a new order; returns the number of steps."""
        turns = -(-counts // most)
        keys, counts = np.repeat(keys, turns), np.repeat(counts / turns, turns).astype(np.float32)
        order = rng.permutation(len(keys))
        keys, counts = keys[order], counts[order]
        for at in range(0, len(keys), batch):
            own = keys[at : at + batch]
            drawn = np.minimum(np.searchsorted(self.cumulative, rng.random(noise)), len(self.cumulative) - 1)
            self.step(own >> 32, own >> 16 & 0xFFFF, own & 0xFFFF, counts[at : at + batch], drawn)
        return -(-len(keys) // batch)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """What the last word but one, and the last, add to the vector of a context."""
        return self.p["far"] @ self.p["A"], self.p["near"] @ self.p["B"]

    def normaliser(self, far: int) -> np.ndarray:
        """Natural logarithms of the sums over all targets, for all contexts with one far word."""
        a, b = self.contexts()
        h, bias = a[far] + b, self.log_share + self.p["bias"][:, 0]
        out = np.empty(len(h))
        for k in range(0, len(h), 64):
            s = h[k : k + 64] @ self.p["target"].T
            s += bias
            top = s.max(axis=1, keepdims=True)
            s -= top
            out[k : k + 64] = top[:, 0] + np.log(np.exp(s, out=s).sum(axis=1))
        return out


def examples(ids: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(far, near) of each target of texts that stand one after the other and stop at ``ends``; before
    a text ends stand."""
    before = np.concatenate([np.zeros(2, dtype=ids.dtype), ids])
    one, two = before[1:-1].copy(), before[:-2].copy()
    starts = np.append(0, ends[:-1])[np.diff(np.append(0, ends)) > 0]
    one[starts] = 0
    two[starts] = 0
    two[starts[starts + 1 < len(ids)] + 1] = 0
    return vocabulary.far[two], vocabulary.near[one]


def pack(far: np.ndarray, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Examples as one number each."""
    return far.astype(np.int64) << 32 | near.astype(np.int64) << 16 | ids


def _joined(column: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and where each row ends."""
    rows = [np.frombuffer(x, dtype=np.uint16) for x in column]
    return np.concatenate([np.zeros(0, dtype=np.uint16), *rows]), np.cumsum([len(r) for r in rows], dtype=np.int64)


def trained(texts: DataFrame, vocabulary, start, steps: int, trainers: int = 1) -> LogBilinear:
    """The average of the models that ``trainers`` make of the rows ``ids`` of ``texts``, each from a copy of the
    same start and on rows of its own, dealt by a hash of their ids. A trainer goes through all of its tokens, and again
    while it has made fewer than ``steps`` steps. A row of a table weighs as much as examples that moved it;
    rows that none has moved stay as they were. What a trainer makes follows from its rows alone, in
    whatever order and wherever they come."""
    size = len(start.value.p["A"])
    parts = ("near", "far", "target", "bias", "A", "B")
    names = ["part", "k", "n", *(f"v{j}" for j in range(size))]

    def run(table: pa.Table) -> pa.Table:
        own, model = vocabulary.value, start.value.copy()
        model.start()
        rng, done, held, size_held = np.random.default_rng(11), 0, [], 0
        rows = sorted(table.column("ids").to_pylist(), key=lambda x: (len(x), x))
        for k in range(0, len(rows), BATCH_ROWS):
            ids, ends = _joined(rows[k : k + BATCH_ROWS])
            held.append(pack(*examples(ids, ends, own), ids))
            size_held += len(ids)
            if size_held >= _BUFFER:
                done += model.train(*np.unique(np.concatenate(held), return_counts=True), rng)
                held, size_held = [], 0
        if size_held:
            last = np.unique(np.concatenate(held), return_counts=True)
            done += model.train(*last, rng)
            while done < steps:
                done += model.train(*last, rng)
        found = []
        for number, name in enumerate(parts if done else ()):
            at = np.flatnonzero(model.moved[name])
            values = model.p[name][at]
            columns = [pa.array(values[:, j]) if j < values.shape[1] else pa.nulls(len(at), pa.float32()) for j in range(size)]
            found.append(pa.table([pa.array(np.full(len(at), number, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(model.moved[name][at]), *columns], names=names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.float64(), *[pa.float32()] * size)], names=names)

    dealt = texts.select("ids", F.pmod(F.xxhash64("ids"), F.lit(trainers)).alias("trainer"))
    moved = dealt.groupBy("trainer").applyInArrow(run, "part int, k int, n double, " + ", ".join(f"{c} float" for c in names[3:]))
    averaged = moved.groupBy("part", "k").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in names[3:]))
    rows = averaged.toArrow()  # as many as the model has
    model = start.value.copy()
    part, at = (rows.column(c).to_numpy() for c in ("part", "k"))
    values = [rows.column(c).to_numpy(zero_copy_only=False) for c in names[3:]]
    for number, name in enumerate(parts):
        own = part == number
        for j in range(model.p[name].shape[1]):
            model.p[name][at[own], j] = values[j][own]
    return model


# -- scoring ---------------------------------------------------------------------------------


def score(docs: DataFrame, folds: int = 10, head: int = HEAD, vocabulary: int = VOCABULARY, steps: int = 400) -> DataFrame:
    """Scores every document by a model of those whose crc32(doc_id as text) mod ``folds`` isn't 0.

    ``docs`` has doc_id and text; other columns are not read. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (add-0.1 unigrams, one place for what is unknown) and score (the
    network's), both log10-probabilities of the whole text and its end. Nulls: a null text is empty and
    scores its end; a null doc_id belongs to the training texts. Repeated rows count and score each. An
    empty table gives no rows; with no training text, nothing is known and all counts are 0.

    Every text becomes ids once, 2 bytes a token, which are written and then read for training and for
    scoring. Every task makes ``steps`` steps of training at least, so that small tables train too.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(1)).alias("fold"))
    counts = written(word_counts(docs.where("fold != 0")), "words")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = Vocabulary(*frequent(counts, head), vocabulary)
    shared = spark.sparkContext.broadcast(known)

    def by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, v = np.zeros(own.targets, dtype=np.int64), np.zeros(own.targets, dtype=np.int64)
        for batch in batches:
            _, found = own.look_up(batch.column("word").to_pylist())
            np.add.at(n, found, batch.column("c").to_numpy())
            np.add.at(v, found, 1)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(v[some])], names=["k", "n", "v"])

    size, room = np.zeros(known.targets), np.zeros(known.targets)
    sums = counts.mapInArrow(by_target, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()  # a row a target
    at = sums.column("k").to_numpy()
    size[at], room[at] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    log_room = np.log10(size + _ADD * (room + 1))[vocabulary:]  # of the tails
    log_all = float(np.log10(total + _ADD * (types + 1)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        base_of = np.log10(own.counts + _ADD) - log_all
        in_tail = own.target >= own.size
        within_of = np.zeros(len(base_of))
        within_of[in_tail] = np.log10(own.counts[in_tail] + _ADD) - log_room[own.target[in_tail].astype(np.int64) - own.size]
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows, rare = [], ([], [], [], [])
            for doc_id, text, fold in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words(text)
                places, found = own.look_up(tokens)
                in_head = places >= 0
                at = places[in_head]
                rows.append((key, doc_id, fold == 0, len(tokens), len(at), float(base_of[at].sum()), float(within_of[at].sum()), found.tobytes()))
                for word, times in Counter(tokens[k] for k in np.flatnonzero(~in_head).tolist()).items():
                    for column, x in zip(rare, (key, word, times, -1 if word == END else tail(word))):
                        column.append(x)
                key += 1
            null = lambda kind, n: pa.nulls(n, kind)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            names = ["key", "doc_id", "held_out", "n_tokens", "n_head", "base", "within", "ids", "word", "times", "k"]
            n, r = len(rows), len(rare[0])
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)), null(pa.binary(), n), null(pa.int64(), n), null(pa.int32(), n)], names=names)
            if r:
                yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), *(null(kind, r) for kind in kinds[1:]), pa.array(rare[1], pa.binary()), pa.array(rare[2], pa.int64()), pa.array(rare[3], pa.int32())], names=names)

    both = written(docs.mapInArrow(encode, "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, base double, within double, ids binary, word binary, times bigint, k int"), "ids")
    texts = both.where("ids IS NOT NULL")
    start = spark.sparkContext.broadcast(LogBilinear(size))
    network = spark.sparkContext.broadcast(trained(texts.where("NOT held_out"), shared, start, steps, max(1, total // TRAINER)))

    def sums_over_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for far in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(NEAR, far)), pa.array(np.arange(NEAR)), pa.array(network.value.normaliser(far))], names=["far", "near", "z"])

    z = np.zeros((FAR, NEAR))
    table = spark.range(FAR).repartition(FAR).mapInArrow(sums_over_targets, "far bigint, near bigint, z double").toArrow()  # a row a context
    z[table.column("far").to_numpy(), table.column("near").to_numpy()] = table.column("z").to_numpy()
    normalisers = spark.sparkContext.broadcast(z)

    def by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model, z = shared.value, network.value, normalisers.value
        (a, b), bias = model.contexts(), model.log_share + model.p["bias"][:, 0]
        names = ["key", "doc_id", "held_out", "n_tokens", "n_head", "base", "within"]
        for batch in slices(batches):
            ids, ends = _joined(batch.column("ids").to_pylist())
            far, near = examples(ids, ends, own)
            found = np.zeros(len(ids) + 1)
            for k in range(0, len(ids), _BUFFER):
                s = slice(k, k + _BUFFER)
                dots = np.einsum("bd,bd->b", a[far[s]] + b[near[s]], model.p["target"][ids[s]])
                found[1:][s] = dots + bias[ids[s]] - z[far[s], near[s]]
            np.cumsum(found, out=found)
            sums = (found[ends] - found[np.append(0, ends[:-1])]) / math.log(10) if len(ends) else np.zeros(0)
            model_score = pa.array(sums + batch.column("within").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), model_score], names=[*names, "model"])

    scored = texts.drop("word", "times", "k").mapInArrow(by_model, "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, base double, within double, model double")
    room_of = F.element_at(F.array(*(F.lit(float(x)) for x in log_room)), F.col("k") + 1)
    log_c = F.log10(F.coalesce("c", F.lit(0)) + _ADD)
    rare = (
        both.where("word IS NOT NULL")
        .select("key", "word", "times", "k")
        .join(counts, "word", "left")
        .groupBy("key")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"),
            F.sum(F.col("times") * (log_c - log_all)).alias("base_rare"),
            F.sum(F.col("times") * F.when(F.col("k") >= 0, log_c - room_of).otherwise(0.0)).alias("model_rare"),
        )
    )
    return scored.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("model_rare", F.lit(0.0))).alias("score"),
    )
