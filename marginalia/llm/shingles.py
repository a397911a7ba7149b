"""Near-duplicates by SimHash and sets of word shingles: all pairs with a Jaccard similarity of 0.8 or more, exactly.

Each set of shingles has a SimHash fingerprint. The index of fingerprints (simhash.links: shared bytes by position
are tallied) connects those at most RADIUS bits apart; what it connects is verified on whole sets. Pairs at 0.8 lie
about 10 bits apart, beyond what bytes guarantee, so the sets that remain apart are looked at exactly:

Take any order of all shingles that is the same everywhere. Two sets A and B that are alike share at
least ceil(0.8 |A|) of A's shingles, so they meet among the first |A| - ceil(0.8 |A|) + 1 of A's and as
many of B's. These are listed under their shingles, the rarest first (by counts of a sample of texts,
which moves the cost only: every order gives the same pairs). Pairs are tallied over all lists that they
meet in; those whose tally leaves room for 0.8 are verified on whole sets. Where a list has more than two sets, each comes with
the parities of its shingles in PARITIES classes: a shingle that one of two sets lacks changes one parity, so
sets with more different parities than 0.8 allows them different shingles are no pair.

Groups of near copies would meet in all pairs. So what the fingerprints connect comes together first, in tasks of
bounded size, and is linked there; some sets of each cluster, and all that are alone, then do so by least hashes,
which most sets that are alike have in common. The lists are looked at for pairs of different clusters only:
a large group of near copies costs its sets, not its pairs, and no pair between clusters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import simhash
from marginalia.llm.common import components, slices, small, written

WORDS, SEED = 5, 42
RADIUS = 3  # bits between fingerprints that the index connects
PARITIES = 1024
_MANY = 200_000  # shingles that are hashed at once
_HELD = 500_000  # sets that a task knows it has listed
_TOLD = 1000  # sets of a list whose pairs are told at once
_BITS = 16  # of a shingle's hash, by which its frequency is counted
GROUP_BYTES = 16 << 20  # of texts that are verified in one task, about
_SAMPLE = 8  # one text in so many is counted for the order


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending XXH64 hashes; words and short texts are as in
    simhash.fingerprint, a text without words has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        return np.array([digest(join(parts), SEED)], dtype=np.uint64)
    count, found = len(parts) - words + 1, []
    for k in range(0, count, _MANY):
        own = parts[k : min(k + _MANY, count) + words - 1]
        found.append(np.array([digest(join(s), SEED) for s in zip(*(own[i:] for i in range(words)))], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def node(own: np.ndarray) -> int:
    """A set's number, the same for equal sets."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def fingerprint(own: np.ndarray) -> int:
    """The 64-bit SimHash of a set, as a signed number: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(own), _MANY):
        ones += np.unpackbits(own[k : k + _MANY].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def parities(own: np.ndarray) -> bytes:
    """Whether each class of hashes has an odd number of the set's."""
    return np.packbits(np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def alike(common, a, b):
    """Whether sets of sizes a and b with so many common shingles have a Jaccard of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def first(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, one of which every set alike has among its own first."""
    order = np.lexsort((own, often[own >> np.uint64(64 - _BITS)]))
    return own[order[: len(own) - -(-4 * len(own) // 5) + 1]]


def _often(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total += np.bincount((shingles(text) >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "c"])

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(_SAMPLE)) == 0).select("text")
    out = np.zeros(1 << _BITS, dtype=np.int64)
    for r in some.mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect():  # 2**16 rows at most
        out[r.k] = r.c
    return out


def linked(names: list[int], clusters: list[int], sets: list[np.ndarray], often: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of names whose sets are alike, or fewer that, with ``clusters``, connect the same names."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    names, clusters, sets = ([x[k] for k in order] for x in (names, clusters, sets))
    numbers = {c: k for k, c in reversed(list(enumerate(clusters)))}
    root, out = [numbers[c] for c in clusters], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    listed = [first(s, often) for s in sets]
    values, entry, times = np.unique(np.concatenate(listed), return_inverse=True, return_counts=True)
    entry[times[entry] == 1] = -1  # no other set has these
    cuts = np.append(0, np.cumsum([len(x) for x in listed]))
    holders: dict[int, dict[int, list[int]]] = {}  # entry -> sets by their cluster, ascending in size
    for k, own in enumerate(sets):
        tried = set()
        for e in entry[cuts[k] : cuts[k + 1]].tolist():
            if e < 0:
                continue
            by_root = holders.setdefault(e, {})
            for r in list(by_root):
                now = find(r)
                if now != r:  # clusters have joined since
                    moved = by_root.pop(r)
                    by_root[now] = sorted(by_root[now] + moved) if now in by_root else moved
            for r in list(by_root):
                if find(r) == find(k):
                    continue
                for c in reversed(by_root[r]):
                    if 5 * len(sets[c]) < 4 * len(own):
                        break
                    if c not in tried:
                        tried.add(c)
                        at = np.searchsorted(own, sets[c])
                        common = np.count_nonzero(own[np.minimum(at, len(own) - 1)] == sets[c])
                        if alike(common, len(own), len(sets[c])):
                            out.append((names[k], names[c]))
                            root[find(c)] = find(k)
                            break
            by_root.setdefault(find(k), []).append(k)
    return out


def verified(texts: DataFrame, often) -> DataFrame:
    """Links (a, b) of rows (deal, part, node, cluster, text), as linked() finds them for each (deal, part,
    component). ``deal`` says which rows come to one task."""

    def of_task(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict] = {}
        for part, component, name, cluster, text in zip(*(table.column(c).to_pylist() for c in ("part", "component", "node", "cluster", "text"))):
            groups.setdefault((component, part), {})[name] = (cluster, text)
        out = []
        for own in groups.values():
            if len(own) > 1:
                out += linked(list(own), [c for c, _ in own.values()], [shingles(t) for _, t in own.values()], often.value)
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return texts.groupBy("deal").applyInArrow(of_task, "a bigint, b bigint")


def _parts(size):
    """How many tasks so many characters of texts need."""
    return F.greatest(F.lit(1), F.ceil(size / GROUP_BYTES)).cast("long")


def least(own: np.ndarray) -> list[int | None]:
    """The least of a set's hashes in each of two mixed orders; sets that are alike have each in common
    with a chance of 0.8 or more."""
    if not len(own):
        return [None] * 2
    return [int((own * np.uint64(k)).min().view(np.int64)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _clustered(rows: DataFrame, links: DataFrame) -> DataFrame:
    near = components(links).select("node", F.col("component").alias("_c"))
    return rows.join(near, "node", "left").withColumn("cluster", F.coalesce("_c", "node")).drop("_c")


def _within(docs: DataFrame, rows: DataFrame, by: str, often) -> DataFrame:
    """Links that verification finds among rows (node, cluster, size, _key, _hash, ...) that have the column
    ``by`` in common and are in different clusters. Groups too large for a task are dealt into parts."""
    groups = rows.groupBy(F.col(by).alias("component")).agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), _parts(F.sum("size")).alias("parts"), F.sum("size").alias("whole"))
    groups = written(groups.where("low < high").select("component", "parts", "whole"), "groups")
    total = groups.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    placed = rows.join(groups, F.col(by) == F.col("component")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    share = F.pmod(F.xxhash64("component"), F.lit(max(1, 2 * total // GROUP_BYTES)))  # small groups share tasks
    placed = written(placed.select("node", "cluster", "component", "part", "_key", "_hash", F.when(F.col("parts") == 1, share).otherwise(F.xxhash64("component", "part")).alias("deal")), "placed")
    return written(verified(docs.join(small(placed), ["_key", "_hash"]), often), "links")


_MOST = (1 << 23) - 1  # the frequency from which the end of a list no longer tells lists apart


def _met(docs: DataFrame, clusters: DataFrame, often, most: int = _MOST) -> DataFrame:
    """(a, b): pairs of sets of different clusters that may be alike, by how many of their first shingles
    are the same. Say A's first shingles end before B's in the order of all shingles. Then whatever A
    and B share up to there is among the first of both, and the rest of A is what else they can share;
    pairs for which both together are too few are dropped. Ends from the frequency ``most`` on are not told
    apart; then the larger set is taken for A. ``clusters`` has (node, parities, cluster) of all sets, the
    cluster of those that are in one with others. Lists of more than two sets
    leave the first pass as they are, a row for each set, and are looked at for pairs once their parities are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            rows = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
            for text in batch.column(0).to_pylist():
                own = shingles(text)
                name = node(own)
                if not len(own) or name in done:  # a task lists each set once
                    continue
                if len(done) < _HELD:
                    done.add(name)
                listed = first(own, often.value)
                end = min(int(often.value[listed[-1] >> np.uint64(64 - _BITS)]), most) << 40 | int(listed[-1] >> np.uint64(24))
                rows[0].append(listed.view(np.int64))
                for column, x in zip(rows[1:], (name, len(own), end)):
                    column.append(np.full(len(listed), x))
            h, names, n, end = (np.concatenate(c) for c in rows)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(names), pa.array(n.astype(np.int32)), pa.array(end)], names=["h", "node", "n", "end"])

    entries = docs.select("text").mapInArrow(run, "h bigint, node bigint, n int, end bigint")
    # Most lists are of one set, so nothing is combined before the shuffle.
    entries = entries.join(small(clusters.where("cluster IS NOT NULL").select("node", "cluster")), "node", "left").select("h", "node", "n", "end", F.coalesce("cluster", "node").alias("cluster")).repartition("h").sortWithinPartitions("h")
    sides = [f"{c}{k}" for k in "12" for c in ("node", "n", "end")]

    def walked(batches: Iterator[pa.RecordBatch], of_lists) -> Iterator[pa.RecordBatch]:
        open_list: list[pa.RecordBatch] = []  # the last list so far, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut or (open_list and open_list[-1].column(0)[0].as_py() != h[0]):
                yield from of_lists(pa.Table.from_batches([*open_list, batch.slice(0, cut)]))
                open_list = []
            open_list.append(batch.slice(cut))
        if open_list:
            yield from of_lists(pa.Table.from_batches(open_list))

    def bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return starts, np.diff(np.append(starts, len(h)))

    def sorted_out(lists: pa.Table) -> Iterator[pa.RecordBatch]:
        h, node, n, end, cluster = (c.to_numpy().astype(np.int64) for c in lists.columns)
        starts, sizes = bounds(h)
        two = starts[sizes == 2]  # most lists that are not of one set
        two = two[(cluster[two] != cluster[two + 1]) & (5 * np.minimum(n[two], n[two + 1]) >= 4 * np.maximum(n[two], n[two + 1]))]
        i, j = np.where(node[two] < node[two + 1], two, two + 1), np.where(node[two] < node[two + 1], two + 1, two)
        several = (sizes > 2) & (np.minimum.reduceat(cluster, starts) < np.maximum.reduceat(cluster, starts))
        more = np.flatnonzero(np.repeat(several, sizes))
        first_side = np.append(i, more)
        none = pa.nulls(len(more), pa.int64())
        second_side = [pa.concat_arrays([pa.array(c[j]), none]) for c in (node, n, end)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[first_side]) for c in (h, cluster, node, n, end)), *second_side], names=["h", "cluster", *sides])

    def met_in(lists: pa.Table) -> Iterator[pa.RecordBatch]:
        h, node, n, end, cluster = (c.to_numpy().astype(np.int64) for c in lists.columns[:5])
        marks = np.frombuffer(b"".join(lists.column(5).to_pylist()), dtype=np.uint64).reshape(len(h), -1)
        told: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            i, j = np.concatenate(told, axis=1)
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(c[x]) for x in (i, j) for c in (node, n, end)], names=sides)

        starts, sizes = bounds(h)
        for s, e in zip(starts.tolist(), (starts + sizes).tolist()):
            _, at = np.unique(node[s:e], return_index=True)  # tasks may have listed the same set
            at += s
            _, of = np.unique(cluster[at], return_inverse=True)
            largest = of == np.bincount(of).argmax()
            at = np.append(at[~largest], at[largest])  # those of the largest cluster meet the others only
            for k in range(np.count_nonzero(~largest)):
                own, others = at[k], at[k + 1 :]
                others = others[(cluster[others] != cluster[own]) & (5 * np.minimum(n[others], n[own]) >= 4 * np.maximum(n[others], n[own]))]
                differ = np.bitwise_count(marks[others] ^ marks[own]).sum(axis=1, dtype=np.int64)
                others = others[9 * differ <= n[others] + n[own]]
                told.append(np.stack([np.full(len(others), own), others]))
                if len(told) > _TOLD:
                    yield rows()
                    told = []
        if told:
            yield rows()

    listed = written(entries.mapInArrow(lambda b: walked(b, sorted_out), ", ".join(f"{c} bigint" for c in ("h", "cluster", *sides))), "lists")
    longer = listed.where("node2 IS NULL").select("h", F.col("node1").alias("node"), "n1", "end1", "cluster").join(clusters.select("node", "parities"), "node")
    longer = longer.select("h", "node", "n1", "end1", "cluster", "parities").repartition("h").sortWithinPartitions("h")
    pairs = longer.mapInArrow(lambda b: walked(b, met_in), ", ".join(f"{c} bigint" for c in sides))
    met = listed.where("node2 IS NOT NULL").select(*sides).union(pairs).groupBy(*sides).agg(F.count("*").alias("c"))
    beyond = F.least("end1", "end2") >= most << 40
    longest = F.when(beyond, F.greatest("n1", "n2")).when(F.col("end1") < F.col("end2"), F.col("n1")).when(F.col("end2") < F.col("end1"), F.col("n2")).otherwise(F.greatest("n1", "n2"))
    rest = F.expr("4L") * longest / 5  # of A, at most
    return met.where(9 * (F.col("c") + rest) >= 4 * (F.col("n1") + F.col("n2"))).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "_key", "_hash")) -> DataFrame:
    """SimHash groups with an exact check: the columns ``keep`` of ``docs`` (_key and _hash, which tell a text, among them) and ``group``,
    the same for texts that pairs of similar shingle sets connect. Texts without words are one group.
    Sets are known by 64-bit hashes of their 64-bit shingle hashes. Nothing but the 2**16 counts that
    order shingles, and numbers of rows, reaches the driver."""
    docs = docs.select(*keep, F.col("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), "node bigint, size bigint, fp bigint, least0 bigint, least1 bigint, parities binary"])
    names = [*keep, "node", "size", "fp", "least0", "least1", "parities"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in batch.column("text").to_pylist():
                own = shingles(t)
                rows.append((node(own), len(t or ""), fingerprint(own), *least(own), parities(own)))
            *numbers, marks = zip(*rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in numbers), pa.array(marks, pa.binary())], names=names)

    found = written(docs.mapInArrow(named, schema), "shingles")
    often = docs.sparkSession.sparkContext.broadcast(_often(docs))
    texts = docs.select("_key", "_hash", "text")
    one = found.groupBy("node").agg(F.min(F.struct("_key", "_hash", *names[len(keep) + 1 :])).alias("f"))
    sets = written(one.select("node", "f.*"), "sets")
    distinct = written(sets.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = distinct.join(components(simhash.links(distinct, RADIUS)), "node", "left").select("fp", F.coalesce("component", "node").alias("near"))
    numbers = sets.drop("parities")
    links = _within(texts, numbers.join(near, "fp").withColumn("cluster", F.col("node")), "near", often)
    for by in ("least0", "least1"):
        rows = _clustered(numbers, links)
        few = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(4))))
        some = rows.groupBy("cluster").agg(few.alias("some")).where("size(some) > 1").select(F.explode("some").alias("node"))
        alone = rows.where("cluster = node")  # each cluster's first set, and all sets that are alone
        chosen = written(rows.join(some.union(alone.select("node")).distinct(), "node"), "chosen")
        links = links.union(_within(texts, chosen, by, often))
    clusters = written(components(links).select("node", F.col("component").alias("cluster")), "clusters")

    pairs = written(_met(docs, sets.select("node", "parities").join(clusters, "node", "left"), often), "pairs")
    ends = pairs.select(F.xxhash64("a", "b").alias("component"), F.explode(F.array("a", "b")).alias("node"))
    ends = written(ends.join(sets.select("node", "size", "_key", "_hash"), "node"), "ends")
    sent = ends.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    deal = F.pmod(F.col("component"), F.lit(max(1, 4 * sent // GROUP_BYTES)))
    met = texts.join(small(ends), ["_key", "_hash"]).select("component", "node", "text", F.lit(0).cast("long").alias("part"), F.col("node").alias("cluster"), deal.alias("deal"))
    links = links.union(written(verified(met, often), "links"))
    return found.join(components(links), "node", "left").select(*keep, F.coalesce("component", "node").alias("group"))
