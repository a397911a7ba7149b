"""Marginals without a junction tree: loopy propagation, dual queries and mixtures of products."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from marginalia.domain import Domain
from marginalia.plans.pgm import Clique, Factor, Measurement, estimate_total, most_likely


def loopy(domain: Domain, potentials: dict[Clique, Factor], total: float, rounds: int = 50, damping: float = 0.5) -> dict[Clique, Factor]:
    """Pseudo-marginals by sum-product on the factor graph, in log space with damping."""
    to_var = {(q, a): np.zeros(domain[a]) for q in potentials for a in q}
    to_factor = {k: v.copy() for k, v in to_var.items()}
    for _ in range(rounds):
        for q, f in potentials.items():
            full = f
            for a in q:
                full = full + Factor(domain.project([a]), to_factor[q, a])
            for a in q:
                new = full.logsumexp([a]).values - to_factor[q, a]
                new = new - new.max()
                to_var[q, a] = damping * to_var[q, a] + (1 - damping) * new
        for q in potentials:
            for a in q:
                new = sum((to_var[p, a] for p in potentials if a in p and p != q), np.zeros(domain[a]))
                to_factor[q, a] = new - new.max()
    out = {}
    for q, f in potentials.items():
        for a in q:
            f = f + Factor(domain.project([a]), to_factor[q, a])
        p = np.exp(f.values - f.values.max())
        out[q] = Factor(domain.project(q), np.transpose(p, f.domain.axes(q)) * total / p.sum())
    return out


def local_inference(domain: Domain, measurements: Sequence[Measurement], iterations: int = 300, rate: float | None = None) -> dict[Clique, Factor]:
    """Pseudo-marginals on the measured cliques that fit the measurements, by mirror descent with loopy
    propagation instead of exact; for workloads whose junction tree would be too large."""
    total = estimate_total(measurements)
    cliques = list(dict.fromkeys(m.query for m in measurements))
    theta = {q: Factor.zeros(domain.project(q)) for q in cliques}
    step = rate or 1.0 / total**2
    mu = loopy(domain, theta, total)
    best = math.inf
    for _ in range(iterations):
        loss, grads = 0.0, {}
        for m in measurements:
            x = mu[m.query].flat()
            d = ((x if m.q is None else m.q @ x) - m.y) / m.sigma
            loss += 0.5 * float(d @ d)
            g = d / m.sigma if m.q is None else m.q.T @ d / m.sigma
            grads[m.query] = grads.get(m.query, 0) + g.reshape(mu[m.query].values.shape)
        if loss > best:
            theta, step = kept, step * 0.5
        else:
            best, kept, kept_grads, step = loss, dict(theta), grads, step * 1.1
        theta = {q: kept[q] - Factor(kept[q].domain, kept_grads[q] * step) for q in cliques}
        mu = loopy(domain, theta, total)
    return loopy(domain, kept, total)


def mixture(domain: Domain, measurements: Sequence[Measurement], components: int = 20, iterations: int = 400, rate: float = 0.1, seed: int = 0) -> tuple[dict[str, np.ndarray], float]:
    """A mixture of products of softmaxes that fits the measurements, by Adam on hand-made gradients:
    (attribute -> components x values, total)."""
    rng = np.random.default_rng(seed)
    total = estimate_total(measurements)
    logits = {a: rng.normal(0, 0.3, (components, domain[a])) for a in domain.attrs}
    mean, square = ({a: np.zeros_like(v) for a, v in logits.items()} for _ in range(2))

    def shares():
        out = {}
        for a, v in logits.items():
            e = np.exp(v - v.max(axis=1, keepdims=True))
            out[a] = e / e.sum(axis=1, keepdims=True)
        return out

    for t in range(1, iterations + 1):
        p = shares()
        grad = {a: np.zeros_like(v) for a, v in logits.items()}
        for m in measurements:
            letters = "abcdefgh"[: len(m.query)]
            spec = ",".join("z" + c for c in letters)
            x = np.einsum(spec + "->" + letters, *(p[a] for a in m.query)).ravel() * total / components
            d = ((x if m.q is None else m.q @ x) - m.y) / m.sigma
            g = (d / m.sigma if m.q is None else m.q.T @ d / m.sigma).reshape(domain.project(m.query).shape) / total
            for k, a in enumerate(m.query):
                others = [p[b] for j, b in enumerate(m.query) if j != k]
                terms = ",".join([letters, *("z" + c for j, c in enumerate(letters) if j != k)])
                grad[a] += np.einsum(terms + "->z" + letters[k], g, *others) if others else np.repeat(g[None, :], components, axis=0)
        for a in logits:
            g = p[a] * (grad[a] - (p[a] * grad[a]).sum(axis=1, keepdims=True))
            mean[a] = 0.9 * mean[a] + 0.1 * g
            square[a] = 0.999 * square[a] + 0.001 * g * g
            logits[a] -= rate * (mean[a] / (1 - 0.9**t)) / (np.sqrt(square[a] / (1 - 0.999**t)) + 1e-12)
    return shares(), total


def mixture_answers(p: dict[str, np.ndarray], total: float, query: Clique) -> np.ndarray:
    letters = "abcdefgh"[: len(query)]
    components = next(iter(p.values())).shape[0]
    return np.einsum(",".join("z" + c for c in letters) + "->" + letters, *(p[a] for a in query)).ravel() * total / components


def dual_query(answers: dict[Clique, np.ndarray], domain: Domain, eps: float, rounds: int = 50, samples: int = 20, rate: float = 1.0, seed: int = 0) -> np.ndarray:
    """Rows by a game: queries (cells of marginals and their complements) get weights, a few are drawn,
    and the row that answers most of those is added, the best of all rows of the domain, by elimination;
    then the weights fall on queries that the rows so far over-answer. eps = rounds (rounds - 1) rate
    samples / n, so ``rounds`` is cut to what eps pays."""
    rng = np.random.default_rng(seed)
    names = [(q, c) for q, y in answers.items() for c in range(y.size)]
    truth = np.concatenate([y / max(y.sum(), 1e-12) for y in answers.values()])
    n = float(next(iter(answers.values())).sum())
    while rounds > 1 and rounds * (rounds - 1) * rate * samples / n > eps:
        rounds -= 1
    signed = np.concatenate([truth, -truth])
    log, out = np.zeros(signed.size), []
    for _ in range(rounds):
        w = np.exp(log - log.max())
        row, _ = best_response(rng.choice(signed.size, samples, p=w / w.sum()), names, domain)
        out.append(row)
        own = np.concatenate([np.eye(y.size)[np.ravel_multi_index([row[domain.attrs.index(a)] for a in q], domain.project(q).shape)] for q, y in answers.items()])
        log += rate * (signed - np.concatenate([own, -own]))
    return np.array(out)


def best_response(picked: np.ndarray, names: list[tuple[Clique, int]], domain: Domain) -> tuple[list[int], float]:
    """The row that answers most of the picked queries, and how many: those below len(names) ask for a cell of a
    marginal, the others take one off for it."""
    sums: dict[Clique, np.ndarray] = {}
    for k in picked:
        q, c = names[k % len(names)]
        sums.setdefault(q, np.zeros(domain.size(q)))[c] += 1.0 if k < len(names) else -1.0
    found, value = most_likely([Factor(domain.project(q), v.reshape(domain.project(q).shape)) for q, v in sums.items()], domain)
    return [found[a] for a in domain.attrs], value
