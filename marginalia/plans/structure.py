"""Bayes networks chosen privately, and tables drawn from them."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from marginalia.domain import Domain
from marginalia.operators import marginals
from marginalia.plans.mechanisms import answers
from marginalia.plans.pgm import Measurement, estimate


def mutual_information(joint: np.ndarray) -> float:
    """Of a table with the child on the last axis, in bits."""
    p = joint.reshape(-1, joint.shape[-1]) / max(joint.sum(), 1e-12)
    rows, columns = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.nansum(np.where(p > 0, p * np.log2(p / (rows * columns)), 0.0)))


def bayes_network(df: DataFrame, domain: Domain, eps: float, degree: int = 2, seed: int = 0, cells: int = 100_000) -> list[tuple[str, tuple[str, ...]]]:
    """(attribute, parents) in order: one attribute at a time, with the parents among those before it
    that tell most about it, by the exponential mechanism with mutual information as the quality.

    The tables of all candidate families of up to ``degree`` parents and ``cells`` cells are one
    workload that Spark answers at once."""
    rng = np.random.default_rng(seed)
    families = [f for k in range(1, degree + 2) for f in combinations(domain.attrs, k) if domain.size(f) <= cells]
    known = answers(marginals.marginals(df, domain, families), domain, families)
    n = float(known[families[0]].sum())
    change = 2 / n * math.log2((n + 1) / 2) + (n - 1) / n * math.log2((n + 1) / (n - 1)) if n > 1 else 1.0

    def information(child: str, parents: tuple[str, ...]) -> float:
        family = domain.canonical((child, *parents))
        table = known[family].reshape(domain.project(family).shape)
        return mutual_information(np.moveaxis(table, family.index(child), -1))

    first = str(rng.choice(domain.attrs))
    network: list[tuple[str, tuple[str, ...]]] = [(first, ())]
    share = eps / max(1, len(domain) - 1)
    while len(network) < len(domain):
        done = [a for a, _ in network]
        options = [
            (a, tuple(p))
            for a in domain.attrs
            if a not in done
            for k in range(0, min(degree, len(done)) + 1)
            for p in combinations(done, k)
            if domain.canonical((a, *p)) in known
        ]
        largest = max(len(p) for _, p in options)
        options = [o for o in options if len(o[1]) == largest] if largest else options
        score = np.array([information(a, p) for a, p in options]) * share / (2 * change)
        network.append(options[int(np.argmax(score + rng.gumbel(size=len(options))))])
    return network


def private_bayes(df: DataFrame, domain: Domain, eps: float, degree: int = 2, seed: int = 0):
    """A model of a private network: half the budget chooses it, half measures its families."""
    rng = np.random.default_rng(seed + 1)
    network = bayes_network(df, domain, eps / 2, degree, seed)
    families = [domain.canonical((a, *p)) for a, p in network]
    known = answers(marginals.marginals(df, domain, sorted(set(families))), domain, sorted(set(families)))
    scale = 2 * len(families) / eps
    measured = [Measurement(f, known[f] + rng.laplace(0, scale, known[f].size), math.sqrt(2) * scale) for f in families]
    return estimate(domain, measured, iterations=300), network
