"""Mechanisms that make synthetic tables: AIM, MST, MWEM with a graphical model, one-way models; over all
rows or over clients' rows.

Spark answers the workload once (per client where rows stay with clients); the control loop, the noise of
answers and the model are small and on the driver; rows are drawn by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators import marginals, shard, workload
from marginalia.operators.workload import Query
from marginalia.plans import accounting, synth
from marginalia.plans.pgm import GraphicalModel, JunctionTree, Measurement, estimate

Answers = dict[Query, np.ndarray]


def answers(counts: DataFrame, domain: Domain, work: Sequence[Query]) -> Answers:
    """Dense answers of a workload whose cells fit the driver by its choice of queries."""
    out = {q: np.zeros(domain.size(q)) for q in work}
    names = {marginals.name(q): q for q in work}
    for r in counts.select("query_id", "cell", "cnt").toLocalIterator():
        out[names[r.query_id]][r.cell] = r.cnt
    return out


@dataclass
class Result:
    model: GraphicalModel
    ledger: accounting.Ledger
    chosen: list[Query]
    decode: dict[str, tuple[np.ndarray, np.ndarray]] | None = None  # see compressed_domain

    def rows(self, spark, n: int | None = None, seed: str | int = 0) -> DataFrame:
        return synth.rows(spark, self.model, n, seed, self.decode)


def _choose(scores: dict[Query, float], eps: float, sensitivity: float, rng: np.random.Generator) -> Query:
    keys = list(scores)
    noisy = np.array([scores[q] for q in keys]) * (eps / (2 * sensitivity)) + rng.gumbel(size=len(keys))
    return keys[int(np.argmax(noisy))]


def _noisy(x: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return x + rng.normal(0, sigma, x.size)


def allowed(candidates: Sequence[Query], model: GraphicalModel, domain: Domain, megabytes: float) -> list[Query]:
    """Queries that the model covers already, or that keep its cliques within the limit."""
    free = [q for q in candidates if any(set(q) <= set(c) for c in model.cliques)]
    rest = [q for q in candidates if q not in set(free)]
    return free + [q for q in rest if JunctionTree(domain, [*model.cliques, q]).megabytes() <= megabytes]


def aim_loop(truth: Callable[[int], tuple[Answers, float]], domain: Domain, work: Sequence[Query], eps: float, delta: float, seed: int, megabytes: float = 80.0, iterations: int = 100, final: int = 500, pick: Callable | None = None, rounds: int | None = None) -> Result:
    """AIM: measure all single attributes, then round by round the query that the model answers worst for
    its noise; halve the noise when a measurement told too little; spend what is left in the last round.

    ``truth(round)`` gives the answers to work from and by how much one row changes them.
    """
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    rho = ledger.rho
    weights = workload.scores(work)
    candidates = list(weights)
    ones = [q for q in candidates if len(q) == 1]
    planned = rounds + len(ones) if rounds else 16 * len(domain)
    sigma = math.sqrt(planned / (2 * 0.9 * rho))
    choice = math.sqrt(8 * 0.1 * rho / planned)
    x, change = truth(0)
    measured: list[Measurement] = []
    for q in ones:
        ledger.gaussian(sigma)
        measured.append(Measurement(q, _noisy(x[q], sigma * change, rng), sigma * change))
    model = estimate(domain, measured, iterations=iterations)
    chosen, t, last = [], 0, False
    while not last:
        t += 1
        left = rho - ledger.spent
        if left < 2 * (accounting.gaussian_cost(sigma) + accounting.exponential_cost(choice)):
            if left <= rho * 1e-9:
                break
            sigma, choice, last = math.sqrt(1 / (2 * 0.9 * left)), math.sqrt(8 * 0.1 * left), True
        x, change = truth(t)
        usable = allowed(candidates, model, domain, megabytes * (ledger.spent + accounting.gaussian_cost(sigma)) / rho)
        usable = usable or ones
        if pick is None:
            seen = model.many(usable)
            gaps = {q: weights[q] * (np.abs(x[q] - seen[q].flat()).sum() - math.sqrt(2 / math.pi) * sigma * change * domain.size(q)) for q in usable}
            q = _choose(gaps, choice, max(weights[c] for c in usable) * change, rng)
        else:
            q = pick(usable, weights, rng)
        ledger.exponential(choice)
        ledger.gaussian(sigma)
        chosen.append(q)
        measured.append(Measurement(q, _noisy(x[q], sigma * change, rng), sigma * change))
        before = model.project(q).flat()
        model = estimate(domain, measured, iterations=final if last else iterations, warm=model)
        if np.abs(model.project(q).flat() - before).sum() <= math.sqrt(2 / math.pi) * sigma * change * domain.size(q):
            sigma, choice = sigma / 2, choice * 2
    return Result(model, ledger, chosen)


def aim(df: DataFrame, domain: Domain, work: Sequence[Query], eps: float, delta: float, seed: int = 0, **options) -> Result:
    """AIM over all rows."""
    closed = workload.closure(work)
    known = answers(marginals.marginals(df, domain, closed), domain, closed)
    return aim_loop(lambda t: (known, 1.0), domain, work, eps, delta, seed, **options)


def random_aim(df: DataFrame, domain: Domain, work: Sequence[Query], eps: float, delta: float, seed: int = 0, **options) -> Result:
    """AIM with queries drawn at random, with odds by weight."""

    def pick(usable, weights, rng):
        w = np.array([weights[q] for q in usable], dtype=float)
        return usable[int(rng.choice(len(usable), p=w / w.sum()))]

    return aim(df, domain, work, eps, delta, seed, pick=pick, **options)


def mwem_pgm(df: DataFrame, domain: Domain, work: Sequence[Query], eps: float, delta: float, rounds: int = 5, seed: int = 0, megabytes: float = 25.0, iterations: int = 300) -> Result:
    """Each round measures the worst answered query; the model may grow in proportion to the rounds. The number of
    rows is not taken as known: it is measured first, at the price of a round."""
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    share = ledger.rho / (rounds + 1)
    sigma, choice = accounting.gaussian_sigma(share / 2), accounting.exponential_epsilon(share / 2)
    known = answers(marginals.marginals(df, domain, work), domain, work)
    ledger.gaussian(accounting.gaussian_sigma(share))
    total = max(1.0, float(next(iter(known.values())).sum() + rng.normal(0, accounting.gaussian_sigma(share))))
    model = GraphicalModel(domain, [(a,) for a in domain.attrs], total)
    measured, chosen = [], []
    for t in range(1, rounds + 1):
        usable = [q for q in allowed(work, model, domain, megabytes * t / rounds) if q not in chosen]
        if not usable:
            break
        seen = model.many(usable)
        gaps = {q: np.abs(known[q] - seen[q].flat()).sum() - domain.size(q) for q in usable}
        q = _choose(gaps, choice, 1.0, rng)
        ledger.exponential(choice)
        ledger.gaussian(sigma)
        chosen.append(q)
        measured.append(Measurement(q, _noisy(known[q], sigma, rng), sigma))
        model = estimate(domain, measured + [Measurement((a,), np.full(domain[a], total / domain[a]), total * 10) for a in domain.attrs if not any(a in m.query for m in measured)], total, iterations, warm=model)
    return Result(model, ledger, chosen)


def mst(df: DataFrame, domain: Domain, eps: float, delta: float, seed: int = 0, iterations: int = 500) -> Result:
    """Single attributes, then a tree of pairs chosen by how far each pair is from independent, one edge
    at a time by the exponential mechanism. Values that look rare in the first answers share one code, in the
    model and in all that follows; rows drawn from it have them again, in equal parts."""
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    third = ledger.rho / 3
    ones, pairs = [(a,) for a in domain.attrs], workload.k_way(domain.attrs, 2)
    known = answers(marginals.marginals(df, domain, [*ones, *pairs]), domain, [*ones, *pairs])
    sigma = accounting.gaussian_sigma(third, len(ones))
    measured = []
    for q in ones:
        ledger.gaussian(sigma)
        measured.append(Measurement(q, _noisy(known[q], sigma, rng), sigma))
    small, maps = compressed_domain(domain, {m.query[0]: m.y for m in measured}, sigma)
    decode = {a: _values(c) for a, c in maps.items() if small[a] < domain[a]}
    measured = [_merged(m, maps[m.query[0]], small[m.query[0]]) for m in measured]
    known = {q: _recoded(known[q].reshape(domain.project(q).shape), [maps[a] for a in q], small.project(q).shape) for q in pairs}
    model = estimate(small, measured, iterations=iterations)
    seen = model.many(pairs)
    gaps = {q: float(np.abs(known[q] - seen[q].flat()).sum()) for q in pairs}
    root = {a: a for a in domain.attrs}

    def find(a: str) -> str:
        while root[a] != a:
            a = root[a]
        return a

    tree: list[Query] = []
    if pairs:
        choice = accounting.exponential_epsilon(third, len(domain) - 1)
        for _ in range(len(domain) - 1):
            open_pairs = {q: g for q, g in gaps.items() if find(q[0]) != find(q[1])}
            q = _choose(open_pairs, choice, 1.0, rng)
            ledger.exponential(choice)
            root[find(q[0])] = find(q[1])
            tree.append(q)
        sigma = accounting.gaussian_sigma(third, len(tree))
        for q in tree:
            ledger.gaussian(sigma)
            measured.append(Measurement(q, _noisy(known[q], sigma, rng), sigma))
        model = estimate(small, measured, iterations=iterations, warm=model)
    return Result(model, ledger, tree, decode)


def _values(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that have a code of their own, by code, and those that share the last one."""
    shared = codes == codes.max()
    return np.flatnonzero(~shared), np.flatnonzero(shared)


def _recoded(x: np.ndarray, codes: Sequence[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    np.add.at(out, np.ix_(*codes), x)
    return out.ravel()


def _merged(m: Measurement, codes: np.ndarray, size: int) -> Measurement:
    """A measurement of single values as one of codes: the shared code's sum has the noise of all its values, so
    it is scaled down to that of one."""
    weight = 1 / np.sqrt(np.maximum(1, np.bincount(codes, minlength=size)))
    return Measurement(m.query, _recoded(m.y, [codes], (size,)) * weight, m.sigma, np.diag(weight))


def compressed_domain(domain: Domain, noisy: dict[str, np.ndarray], sigma: float) -> tuple[Domain, dict[str, np.ndarray]]:
    """Values whose noisy count is below three deviations share one code: the smaller domain, and each
    attribute's old value to new code."""
    maps, sizes = {}, {}
    for a in domain.attrs:
        keep = noisy[a] >= 3 * sigma
        code = np.where(keep, np.cumsum(keep) - 1, keep.sum())
        maps[a], sizes[a] = code, int(keep.sum() + (not keep.all()))
    return Domain.of(sizes), maps


def one_way(df: DataFrame, domain: Domain, eps: float, delta: float, seed: int = 0) -> Result:
    """All budget on single attributes, taken as independent."""
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    ones = [(a,) for a in domain.attrs]
    known = answers(marginals.marginals(df, domain, ones), domain, ones)
    sigma = accounting.gaussian_sigma(ledger.rho, len(ones))
    measured = []
    for q in ones:
        ledger.gaussian(sigma)
        measured.append(Measurement(q, _noisy(known[q], sigma, rng), sigma))
    return Result(estimate(domain, measured), ledger, ones)


def distributed_aim(df: DataFrame, client: str, domain: Domain, work: Sequence[Query], eps: float, delta: float, q: float, seed: int = 0, accumulate: bool = False, max_rounds: int = 200, **options) -> Result:
    """AIM over clients' rows: each round works from the summed answers of a Poisson cohort, scaled to
    all; with ``accumulate`` from those of every client seen so far. Clients' answers are taken once and
    kept; a round is a semi-join and a sum, and only the sums reach the driver. A round whose cohort is
    empty measures zeros, with the noise of a cohort of less than one client."""
    from marginalia.operators.ordered import numbered as in_order

    closed = workload.closure(work)
    spark = df.sparkSession
    ids = df.select(F.col(client).alias("client_id")).distinct()
    numbered = in_order(ids, ["client_id"], "_c").persist()
    count = numbered.count()
    coded = df.join(numbered, df[client] == numbered["client_id"]).select("_c", *domain.attrs)
    held = marginals.marginals(coded, domain, closed, "_c", count).persist()
    cohorts = shard.poisson(numbered.select("_c"), q, spark.range(max_rounds + 1).withColumnRenamed("id", "round"), seed, "_c").persist()

    def truth(t: int) -> tuple[Answers, float]:
        own = cohorts.where(F.col("round") <= t if accumulate else F.col("round") == t).select("_c").distinct()
        n = own.count()
        if not n:
            nobody = held.limit(0)
            return answers(marginals.summed_over(nobody), domain, closed), 2.0 * count
        some = answers(marginals.summed_over(held.join(own, "_c", "left_semi")), domain, closed)
        return {k: v * (count / n) for k, v in some.items()}, count / n

    try:
        return aim_loop(truth, domain, work, eps, delta, seed, **options)
    finally:
        for frame in (numbered, held, cohorts):
            frame.unpersist()


GENERATORS: dict[str, Callable] = {"aim": aim, "random_aim": random_aim, "mwem_pgm": mwem_pgm, "mst": mst, "one_way": one_way, "distributed_aim": distributed_aim}

#: Names that cannot be offered, and why.
ABSENT = {"ctgan": "needs a deep-learning library", "dp_ctgan": "needs a deep-learning library", "fed_ctgan": "needs a deep-learning library", "rap": "needs a differentiable array library"}


def generator(name: str) -> Callable:
    """A mechanism by name."""
    if name in ABSENT:
        raise NotImplementedError(f"{name} {ABSENT[name]}")
    if name not in GENERATORS:
        raise ValueError(f"unknown generator: {name}")
    return GENERATORS[name]
