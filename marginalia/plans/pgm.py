"""Graphical models over categorical tables: factors, junction trees, belief propagation, estimation.

The model is small by design (a limit of some tens of MB is set where cliques are chosen), so it lives in
numpy on the driver; what it is fitted to comes from Spark, and rows go back there (see synth).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from marginalia.domain import Domain

Clique = tuple[str, ...]


@dataclass
class Factor:
    """Values over a domain, an axis per attribute."""

    domain: Domain
    values: np.ndarray

    @classmethod
    def zeros(cls, domain: Domain) -> Factor:
        return cls(domain, np.zeros(domain.shape))

    def expand(self, domain: Domain) -> np.ndarray:
        """The values with axes of the given larger domain, of length 1 where it has no say."""
        order = [a for a in domain.attrs if a in self.domain]
        moved = np.transpose(self.values, self.domain.axes(order))
        return moved.reshape([self.domain[a] if a in self.domain else 1 for a in domain.attrs])

    def _with(self, other: Factor, op: Callable) -> Factor:
        domain = self.domain.merge(other.domain)
        return Factor(domain, np.broadcast_to(op(self.expand(domain), other.expand(domain)), domain.shape).copy())

    def __add__(self, other) -> Factor:
        return self._with(other, np.add) if isinstance(other, Factor) else Factor(self.domain, self.values + other)

    def __sub__(self, other) -> Factor:
        if not isinstance(other, Factor):
            return Factor(self.domain, self.values - other)
        return self._with(Factor(other.domain, np.where(np.isneginf(other.values), 0.0, other.values)), np.subtract)

    def __mul__(self, other) -> Factor:
        return self._with(other, np.multiply) if isinstance(other, Factor) else Factor(self.domain, self.values * other)

    def __truediv__(self, other: Factor) -> Factor:
        return self._with(other, lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0))

    def exp(self) -> Factor:
        return Factor(self.domain, np.exp(self.values))

    def log(self) -> Factor:
        with np.errstate(divide="ignore"):
            return Factor(self.domain, np.log(self.values))

    def _reduce(self, keep: Sequence[str], f: Callable) -> Factor:
        rest = tuple(i for i, a in enumerate(self.domain.attrs) if a not in keep)
        kept = self.domain.project([a for a in self.domain.attrs if a in keep])
        return Factor(kept, np.asarray(f(self.values, rest)) if rest else self.values)

    def sum(self, keep: Sequence[str]) -> Factor:
        return self._reduce(keep, lambda v, axes: v.sum(axis=axes))

    def max(self, keep: Sequence[str]) -> Factor:
        return self._reduce(keep, lambda v, axes: v.max(axis=axes))

    def logsumexp(self, keep: Sequence[str]) -> Factor:
        def f(v, axes):
            top = v.max(axis=axes, keepdims=True)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(v - top).sum(axis=axes)) + np.squeeze(top, axis=axes)

        return self._reduce(keep, f)

    def project(self, attrs: Sequence[str]) -> Factor:
        """The sum over all else, with axes in the given order."""
        small = self.sum(attrs)
        return Factor(small.domain.project(attrs), np.transpose(small.values, small.domain.axes(attrs)))

    def condition(self, evidence: dict[str, int]) -> Factor:
        index = tuple(evidence.get(a, slice(None)) for a in self.domain.attrs)
        return Factor(self.domain.marginalize(evidence), self.values[index])

    def flat(self) -> np.ndarray:
        return self.values.ravel()


class JunctionTree:
    """Maximal cliques of a triangulation, joined so that cliques that share attributes are connected
    through cliques that have them too."""

    def __init__(self, domain: Domain, cliques: Sequence[Clique], order: Sequence[str] | None = None):
        self.domain = domain
        near: dict[str, set[str]] = {a: set() for a in domain.attrs}
        for q in cliques:
            for a, b in combinations(q, 2):
                near[a].add(b)
                near[b].add(a)
        self.order: list[str] = []
        found: list[set[str]] = []
        left = {a: set(n) for a, n in near.items()}
        todo = list(order) if order else None
        while left:
            # next to go: the attribute that makes the smallest clique
            a = todo[len(self.order)] if todo else min(left, key=lambda a: (domain.size([a, *left[a]]), domain.attrs.index(a)))
            group = {a, *left[a]}
            if not any(group <= g for g in found):
                found.append(group)
            for b in left[a]:
                left[b] |= left[a] - {b}
                left[b].discard(a)
            del left[a]
            self.order.append(a)
        self.cliques: list[Clique] = [domain.canonical(g) for g in found if not any(g < h for h in found)]
        self.edges = self._spanning()
        self.neighbours: dict[int, list[int]] = {k: [] for k in range(len(self.cliques))}
        for a, b in self.edges:
            self.neighbours[a].append(b)
            self.neighbours[b].append(a)

    def _spanning(self) -> list[tuple[int, int]]:
        """A tree with the largest separators."""
        shared = sorted(combinations(range(len(self.cliques)), 2), key=lambda e: -len(set(self.cliques[e[0]]) & set(self.cliques[e[1]])))
        root = list(range(len(self.cliques)))

        def find(k: int) -> int:
            while root[k] != k:
                k = root[k]
            return k

        edges = []
        for a, b in shared:
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                edges.append((a, b))
        return edges

    def separator(self, a: int, b: int) -> Clique:
        return tuple(x for x in self.cliques[a] if x in self.cliques[b])

    def schedule(self) -> list[tuple[int, int]]:
        """Messages (from, to) in an order in which each has what it needs."""
        down, seen, stack = [], {0}, [0]
        while stack:
            k = stack.pop()
            for j in self.neighbours[k]:
                if j not in seen:
                    seen.add(j)
                    down.append((k, j))
                    stack.append(j)
        return [(j, k) for k, j in reversed(down)] + down

    def megabytes(self) -> float:
        return sum(self.domain.size(q) for q in self.cliques) * 8 / 2**20


class GraphicalModel:
    """Clique potentials and marginals of a distribution with a total."""

    def __init__(self, domain: Domain, cliques: Sequence[Clique], total: float = 1.0, order: Sequence[str] | None = None):
        self.tree = JunctionTree(domain, cliques, order)
        self.domain, self.total = domain, total
        self.potentials = {q: Factor.zeros(domain.project(q)) for q in self.tree.cliques}
        self.marginals = self.belief_propagation(self.potentials)

    @property
    def cliques(self) -> list[Clique]:
        return self.tree.cliques

    def belief_propagation(self, potentials: dict[Clique, Factor]) -> dict[Clique, Factor]:
        """Marginals of the cliques, by messages in log space over the tree."""
        cliques = self.tree.cliques
        beliefs = [potentials[q] for q in cliques]
        messages: dict[tuple[int, int], Factor] = {}
        for a, b in self.tree.schedule():
            own = beliefs[a]
            if (b, a) in messages:
                own = own - messages[b, a]
            sent = own.logsumexp(self.tree.separator(a, b))
            messages[a, b] = sent
            beliefs[b] = beliefs[b] + sent
        logz = beliefs[0].logsumexp(()).values
        self.log_z = float(logz)
        scale = np.log(self.total) - logz
        return {q: (b + scale).exp() for q, b in zip(cliques, beliefs)}

    def project(self, attrs: Sequence[str]) -> Factor:
        """The model's marginal, from a clique that covers it or by eliminating the other attributes."""
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        for q in self.cliques:
            if set(attrs) <= set(q):
                return self.marginals[q].project(attrs)
        logs = [self.potentials[q] for q in self.cliques]
        for a in sorted((a for a in self.tree.order if a not in attrs), key=self.tree.order.index):
            mine = [f for f in logs if a in f.domain]
            if mine:
                joined = mine[0]
                for f in mine[1:]:
                    joined = joined + f
                logs = [f for f in logs if a not in f.domain] + [joined.logsumexp([b for b in joined.domain.attrs if b != a])]
        joined = logs[0]
        for f in logs[1:]:
            joined = joined + f
        missing = self.domain.project([a for a in attrs if a not in joined.domain])
        full = joined + Factor.zeros(missing) if len(missing) else joined
        values = full.values - full.values.max()
        p = Factor(full.domain, np.exp(values))
        return Factor(p.domain, p.values * self.total / p.values.sum()).project(attrs)

    def _rooted(self) -> tuple[list[int], dict[int, int]]:
        """The cliques from the first one outwards, and the one before each."""
        order, above = [0], {0: -1}
        for k in order:
            for j in self.tree.neighbours[k]:
                if j not in above:
                    above[j] = k
                    order.append(j)
        return order, above

    def many(self, queries: Sequence[Sequence[str]]) -> dict[Clique, Factor]:
        """The model's marginals on many sets of attributes, from one calibrated tree.

        A query is answered in the part of the tree that has its attributes: each clique there passes on, to
        the one before it, what its share of the query is given the separator. Queries that ask the same
        of a branch share its message; cliques without a share pass nothing, since calibrated marginals have it
        already. An answer needs tables over a clique and the query's attributes beyond it, never over all cells."""
        order, above = self._rooted()
        below: dict[int, list[int]] = {k: [] for k in order}
        reach = {k: set(self.cliques[k]) for k in order}
        for k in reversed(order[1:]):
            below[above[k]].append(k)
            reach[above[k]] |= reach[k]
        messages: dict[tuple[int, frozenset], Factor] = {}

        def joined(k: int, wanted: frozenset, table: Factor) -> Factor:
            """``table`` times the messages of the branches that have wanted attributes which clique k lacks."""
            for j in below[k]:
                if asked := frozenset((wanted & reach[j]) - set(self.cliques[k])):
                    table = table * message(j, asked)
                    table = table.sum([a for a in table.domain.attrs if a in wanted or a in self.cliques[k]])
            return table

        def message(k: int, wanted: frozenset) -> Factor:
            """P(wanted | separator) of the branch from clique k on."""
            if (k, wanted) not in messages:
                shared = self.tree.separator(k, above[k])
                own = self.marginals[self.cliques[k]]
                table = joined(k, wanted, own / own.sum(shared))
                messages[k, wanted] = table.sum([a for a in table.domain.attrs if a in wanted or a in shared])
            return messages[k, wanted]

        out = {}
        for query in map(tuple, queries):
            wanted, top = frozenset(query), 0
            while deeper := [j for j in below[top] if wanted <= reach[j]]:
                top = deeper[0]
            out[query] = joined(top, wanted, self.marginals[self.cliques[top]]).project(query)
        return out

    def kronecker(self, matrices: dict[str, np.ndarray]) -> np.ndarray:
        """Answers to the Kronecker product of query matrices, an axis for each attribute of ``matrices`` in its
        order; other attributes are summed over. Each matrix is folded in as soon as no other clique has its
        attribute, so what is held grows with the numbers of rows, not with the domain."""
        order, above = self._rooted()
        held = {k: self.marginals[self.cliques[k]] for k in order}
        for k in reversed(order):
            shared = self.tree.separator(k, above[k]) if k else ()
            table = held[k] / self.marginals[self.cliques[k]].sum(shared) if k else held[k]
            for a in [a for a in self.cliques[k] if a not in shared]:
                if a in matrices:
                    at = table.domain.axes([a])[0]
                    values = np.moveaxis(np.tensordot(matrices[a], table.values, (1, at)), 0, at)
                    names = [f"{x} answers" if x == a else x for x in table.domain.attrs]
                    table = Factor(Domain.of(dict(zip(names, values.shape))), values)
                else:
                    table = table.sum([x for x in table.domain.attrs if x != a])
            if k:
                held[above[k]] = held[above[k]] * table
        return table.project([f"{a} answers" for a in matrices]).values

    def fit(self, marginals: dict[Clique, np.ndarray]) -> GraphicalModel:
        """Sets the model to that of the highest likelihood for given marginals of its cliques, in closed form: the
        product of the cliques' tables over those of the separators. Cells without rows get none."""
        order, above = self._rooted()
        tables = {k: Factor(self.domain.project(self.cliques[k]), np.asarray(marginals[self.cliques[k]], dtype=float).reshape(self.domain.project(self.cliques[k]).shape)) for k in order}
        self.total = float(tables[0].values.sum())
        for k in order:
            own = tables[k] / tables[k].sum(self.tree.separator(k, above[k])) if k else tables[k]
            self.potentials[self.cliques[k]] = Factor(tables[k].domain, own.project(self.cliques[k]).values).log()
        self.marginals = self.belief_propagation(self.potentials)
        return self

    def datavector(self) -> np.ndarray:
        return self.project(self.domain.attrs).flat()

    def conditionals(self) -> list[tuple[str, Clique, np.ndarray]]:
        """(attribute, parents, shares) in the order in which attributes are sampled: each has its
        attribute's axis last, and its parents are sampled before."""
        out: list[tuple[str, Clique, np.ndarray]] = []
        done: list[str] = []
        near: dict[str, set[str]] = {a: set() for a in self.domain.attrs}
        for q in self.cliques:
            for a in q:
                near[a] |= set(q) - {a}
        for a in reversed(self.tree.order):
            parents = tuple(b for b in done if b in near[a])
            table = self.project((*parents, a)).values
            sums = table.sum(axis=-1, keepdims=True)
            out.append((a, parents, np.where(sums > 0, table / np.where(sums > 0, sums, 1), 1 / table.shape[-1])))
            done.append(a)
        return out

    def log_likelihood(self, cells: dict[Clique, np.ndarray]) -> float:
        """Sum over rows of the log-probability, from the rows' counts on the cliques."""
        n = next(iter(cells.values())).sum()
        return float(sum((cells[q] * self.potentials[q].flat())[cells[q] > 0].sum() for q in self.cliques) - n * self.log_z)


def most_likely(factors: Sequence[Factor], domain: Domain) -> tuple[dict[str, int], float]:
    """The cell with the largest sum of values, and that sum: each attribute in turn is eliminated by maxima
    over what it touches, and then read off backwards. Work and tables are those of the tree of the
    factors' attributes, not of all cells; ties go to the smallest values in the order of elimination."""
    tree = JunctionTree(domain, [f.domain.attrs for f in factors])
    left, buckets = list(factors), {}
    for a in tree.order:
        joined = Factor.zeros(domain.project([a]))
        for f in [f for f in left if a in f.domain]:
            joined = joined + f
        left = [f for f in left if a not in f.domain]
        buckets[a] = joined
        left.append(joined.max([b for b in joined.domain.attrs if b != a]))
    found: dict[str, int] = {}
    for a in reversed(tree.order):
        found[a] = int(np.argmax(buckets[a].condition({b: v for b, v in found.items() if b in buckets[a].domain}).values))
    return found, float(sum(f.values for f in left))


@dataclass
class Measurement:
    """Noisy answers y = Q x + noise on a marginal; Q is None for all cells."""

    query: Clique
    y: np.ndarray
    sigma: float
    q: np.ndarray | None = None


def estimate_total(measurements: Sequence[Measurement]) -> float:
    """The total that all measurements agree on best: each that can see the whole gives an estimate, and
    they are averaged by precision."""
    top = bottom = 0.0
    for m in measurements:
        q = np.eye(m.y.size) if m.q is None else m.q
        v = np.linalg.lstsq(q.T, np.ones(q.shape[1]), rcond=None)[0] if m.q is not None else np.ones(m.y.size)
        if np.allclose(q.T @ v, 1):
            variance = m.sigma**2 * float(v @ v)
            top += float(v @ m.y) / variance
            bottom += 1 / variance
    return max(1.0, top / bottom) if bottom else 1.0


def loss_and_gradient(model: GraphicalModel, marginals: dict[Clique, Factor], measurements: Sequence[Measurement], metric: str = "L2") -> tuple[float, dict[Clique, Factor]]:
    """The misfit of the measurements, each on the first clique that covers it, and its gradient."""
    loss, grads = 0.0, {q: Factor.zeros(f.domain) for q, f in marginals.items()}
    for m in measurements:
        clique = min((q for q in marginals if set(m.query) <= set(q)), key=lambda q: model.domain.size(q))
        x = marginals[clique].project(m.query).flat()
        d = ((x if m.q is None else m.q @ x) - m.y) / m.sigma
        if metric == "L1":
            loss += float(np.abs(d).sum())
            g = np.sign(d) / m.sigma
        else:
            loss += 0.5 * float(d @ d)
            g = d / m.sigma
        g = g if m.q is None else m.q.T @ g
        grads[clique] = grads[clique] + Factor(model.domain.project(m.query), g.reshape(model.domain.project(m.query).shape))
    return loss, {q: Factor(marginals[q].domain, g.project(marginals[q].domain.attrs).values) for q, g in grads.items()}


def _smoothness(model: GraphicalModel, measurements: Sequence[Measurement]) -> float:
    """How fast the gradient of the misfit can change, in shares of the total: for each clique the sum of its
    measurements' squared norms, each over the cells that a measured cell sums up."""
    sums = dict.fromkeys(model.cliques, 0.0)
    for m in measurements:
        clique = min((q for q in model.cliques if set(m.query) <= set(q)), key=lambda q: model.domain.size(q))
        norm = 1.0 if m.q is None else float(np.linalg.norm(m.q, 2))
        sums[clique] += (norm / m.sigma) ** 2 * model.domain.size(clique) / model.domain.size(m.query)
    return max(sums.values()) * model.total**2


def _mixed(a: dict[Clique, Factor], b: dict[Clique, Factor], share: float) -> dict[Clique, Factor]:
    return {q: Factor(f.domain, (1 - share) * f.values + share * b[q].values) for q, f in a.items()}


def _dual_averaging(model: GraphicalModel, measurements, iterations: int, callback) -> dict[Clique, Factor]:
    """Marginals by accelerated dual averaging: gradients are averaged with growing weights, the potentials are
    the start's less that average, times a step that grows with the square of the round."""
    start = dict(model.potentials)
    smooth = _smoothness(model, measurements)
    x = z = model.belief_propagation(start)
    mean = {q: Factor.zeros(f.domain) for q, f in start.items()}
    for t in range(1, iterations + 1):
        share = 2 / (t + 1)
        loss, grad = loss_and_gradient(model, _mixed(x, z, share), measurements)
        if callback:
            callback(t - 1, loss)
        mean = _mixed(mean, grad, share)
        z = model.belief_propagation({q: start[q] - mean[q] * (model.total * t * (t + 1) / (4 * smooth)) for q in start})
        x = _mixed(x, z, share)
    return x


def _interior_gradient(model: GraphicalModel, measurements, iterations: int, callback) -> dict[Clique, Factor]:
    """Marginals by the interior gradient method of Auslender and Teboulle with the entropy as its distance."""
    theta, c = dict(model.potentials), 1.0
    smooth = _smoothness(model, measurements)
    x = z = model.belief_propagation(theta)
    for t in range(iterations):
        share = (math.sqrt(c * c + 4 * c) - c) / 2  # c is in units of the smoothness
        loss, grad = loss_and_gradient(model, _mixed(x, z, share), measurements)
        if callback:
            callback(t, loss)
        c *= 1 - share
        theta = {q: theta[q] - grad[q] * (model.total * share / (c * smooth)) for q in theta}
        z = model.belief_propagation(theta)
        x = _mixed(x, z, share)
    return x


def estimate(domain: Domain, measurements: Sequence[Measurement], total: float | None = None, iterations: int = 500, warm: GraphicalModel | None = None, metric: str = "L2", callback: Callable[[int, float], None] | None = None, method: str = "mirror", zeros: dict[Clique, Sequence[tuple[int, ...]]] | None = None) -> GraphicalModel:
    """The model of the measured cliques whose marginals fit the measurements best. ``method`` is ``mirror`` (entropic
    mirror descent on the potentials with a backtracking step), ``dual`` (dual averaging) or ``interior`` (interior
    gradients); the last two take the metric L2. ``zeros`` lists, by sets of attributes, cells that cannot have
    rows: their potentials are minus infinity throughout, so they get no mass."""
    total = estimate_total(measurements) if total is None else total
    cliques = [*(m.query for m in measurements), *(zeros or {})] or [(a,) for a in domain.attrs]
    model = GraphicalModel(domain, cliques, total)
    if warm is not None:
        for q, f in warm.potentials.items():
            home = next((c for c in model.cliques if set(q) <= set(c)), None)
            if home is not None:
                wide = model.potentials[home] + f
                model.potentials[home] = Factor(model.potentials[home].domain, wide.project(home).values if wide.domain.attrs != home else wide.values)
    for q, cells in (zeros or {}).items():
        forbidden = Factor.zeros(domain.project(q))
        if len(cells):
            forbidden.values[tuple(np.array(cells).T)] = -np.inf
        home = next(c for c in model.cliques if set(q) <= set(c))
        model.potentials[home] = Factor(model.potentials[home].domain, (model.potentials[home] + forbidden).values)
    if method != "mirror":
        if metric != "L2":
            raise ValueError(f"{method} takes the metric L2")
        found = {"dual": _dual_averaging, "interior": _interior_gradient}[method](model, measurements, iterations, callback)
        return model.fit({q: f.flat() for q, f in found.items()})
    theta = model.potentials
    marginals = model.belief_propagation(theta)
    loss, grad = loss_and_gradient(model, marginals, measurements, metric)
    step = 2.0 / total**2
    for t in range(iterations):
        if callback:
            callback(t, loss)
        if loss < 1e-12:
            break
        for _ in range(25):
            trial = {q: theta[q] - grad[q] * step for q in theta}
            moved = model.belief_propagation(trial)
            after, further = loss_and_gradient(model, moved, measurements, metric)
            drop = sum(float((grad[q].values * (marginals[q].values - moved[q].values)).sum()) for q in theta)
            if loss - after >= 0.5 * drop or metric != "L2":
                break
            step *= 0.5
        if after > loss and metric == "L2":
            break
        theta, marginals, loss, grad = trial, moved, after, further
        step *= 1.1
    model.potentials, model.marginals = theta, model.belief_propagation(theta)
    return model
