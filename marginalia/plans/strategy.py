"""Which marginals to measure for a workload of marginals, and how precisely.

A strategy gives every marginal of a set a weight u, its share of the budget. All its matrices have the same
eigenspaces, one for each set S of attributes: what varies along all of S and nothing else. There a marginal k that
contains S has the eigenvalue of the product of the sizes outside k, any other has 0. So the expected squared error of a
workload is a sum over sets of attributes, whatever the number of cells, and the best weights follow from it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from marginalia.domain import Domain
from marginalia.operators import marginals, workload
from marginalia.operators.workload import Query
from marginalia.plans import accounting
from marginalia.plans.mechanisms import Result, _noisy, answers
from marginalia.plans.pgm import JunctionTree, Measurement, estimate


class Error:
    """Expected squared errors of strategies over the marginals ``measured`` for a workload (a weight a query)."""

    def __init__(self, domain: Domain, work: dict[Query, float], measured: Sequence[Query]):
        self.measured = [domain.canonical(q) for q in measured]
        outside = lambda q: float(math.prod(domain[a] for a in domain.attrs if a not in q))
        spaces = sorted({s for q in work for k in range(len(q) + 1) for s in combinations(domain.canonical(q), k)}, key=lambda s: (len(s), s))
        within = [set(s) for s in spaces]
        self.cost = np.array([math.prod(domain[a] - 1 for a in s) * sum(w * w * outside(q) for q, w in work.items() if own <= set(q)) for s, own in zip(spaces, within)], dtype=float)
        self.eigen = np.array([[outside(q) if own <= set(q) else 0.0 for q in self.measured] for own in within])
        if (self.eigen.sum(axis=1) == 0)[self.cost > 0].any():
            raise ValueError("the measured marginals don't say all that the workload asks")

    def __call__(self, u: np.ndarray, sigma: float = 1.0) -> float:
        """The error where a row changes all answers together by 1 at most, with normal noise of ``sigma``."""
        return float(sigma**2 * u.sum() * (self.cost / np.maximum(self.eigen @ u, 1e-300))[self.cost > 0].sum())

    def best(self, rounds: int = 5000, tolerance: float = 1e-9) -> np.ndarray:
        """The weights, of sum 1, of the least error: each is multiplied by the root of how much more error it would
        save than the average, which never raises the error; at the end all that count save the same."""
        u = np.full(len(self.measured), 1 / len(self.measured))
        for _ in range(rounds):
            seen = self.eigen @ u
            saves = self.eigen.T @ (self.cost / seen**2)
            gain = saves / (self.cost / seen).sum()
            u = u * np.sqrt(gain)
            u /= u.sum()
            if gain.max() <= 1 + tolerance:
                break
        return u


def optimised(df: DataFrame, domain: Domain, work: Sequence[Query], eps: float, delta: float, seed: int = 0, least: float = 1e-6, megabytes: float = 80.0, iterations: int = 500) -> Result:
    """A model from the best weighted marginals below the workload's queries, each measured once; those that would get
    under ``least`` of the budget are left out, and their share goes to the others."""
    closed = workload.closure([domain.canonical(q) for q in work])
    u = Error(domain, dict.fromkeys(work, 1.0), closed).best()
    kept = {q: w for q, w in zip(closed, u) if w >= least}
    if JunctionTree(domain, list(kept)).megabytes() > megabytes:
        raise ValueError(f"a model of these marginals takes over {megabytes} MB")
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    rho, whole = ledger.rho, sum(kept.values())
    known = answers(marginals.marginals(df, domain, list(kept)), domain, list(kept))
    measured = []
    for q, w in kept.items():
        sigma = accounting.gaussian_sigma(rho * w / whole)
        ledger.gaussian(sigma)
        measured.append(Measurement(q, _noisy(known[q], sigma, rng), sigma))
    return Result(estimate(domain, measured, iterations=iterations), ledger, list(kept))
