"""Privacy accounting: zCDP, RDP of the subsampled Gaussian, a ledger, and budgets over derived tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count as counter

from pyspark.sql import DataFrame, SparkSession


class BudgetExceeded(Exception):
    """A request would cost more than is left."""


def _bisect(low: float, high: float, too_high: Callable[[float], bool], steps: int = 200) -> tuple[float, float]:
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if too_high(mid) else (mid, high)
    return low, high


def cdp_delta(rho: float, eps: float) -> float:
    """Smallest delta for which rho-zCDP is known to imply (eps, delta)-DP: the least over orders a of
    exp((a - 1)(a rho - eps)) (1 - 1/a)^a / (a - 1)."""
    if rho == 0:
        return 0.0
    # the derivative of the exponent in a rises with a, so the least lies where it changes sign
    slope = lambda a: (2 * a - 1) * rho - eps + math.log1p(-1 / a)
    a = sum(_bisect(1.0 + 1e-8, (eps + 1) / (2 * rho) + 2, lambda a: slope(a) > 0)) / 2
    return min(1.0, math.exp((a - 1) * (a * rho - eps) + a * math.log1p(-1 / a)) / (a - 1))


def cdp_eps(rho: float, delta: float) -> float:
    """Smallest eps for which rho-zCDP implies (eps, delta)-DP."""
    if rho == 0 or delta >= 1:
        return 0.0
    return _bisect(0.0, rho + 2 * math.sqrt(rho * math.log(1 / delta)), lambda e: cdp_delta(rho, e) <= delta)[1]


def cdp_rho(eps: float, delta: float) -> float:
    """Largest rho for which rho-zCDP implies (eps, delta)-DP."""
    if delta >= 1:
        return math.inf
    return _bisect(0.0, eps + 1, lambda r: cdp_delta(r, eps) > delta)[0]


def gaussian_sigma(rho: float, rounds: int = 1) -> float:
    return math.sqrt(rounds / (2 * rho))


def exponential_epsilon(rho: float, rounds: int = 1) -> float:
    return math.sqrt(8 * rho / rounds)


def laplace_scale(rho: float, rounds: int = 1) -> float:
    return 1 / math.sqrt(2 * rho / rounds)


def best_noise(l1: float, l2: float, eps: float, delta: float) -> tuple[str, float]:
    """("laplace" or "gaussian", its scale): whichever has the smaller deviation for these sensitivities.
    The Gaussian one, also taken at a tie, is calibrated by the zCDP that (eps, delta) allows."""
    b = l1 / eps
    if delta <= 0:
        return "laplace", b
    sigma = l2 * gaussian_sigma(cdp_rho(eps, delta))
    return ("laplace", b) if math.sqrt(2) * b < sigma else ("gaussian", sigma)


def gaussian_cost(sigma: float) -> float:
    return 1 / (2 * sigma**2)


def exponential_cost(eps: float) -> float:
    return eps**2 / 8


def laplace_cost(scale: float) -> float:
    return 1 / (2 * scale**2)


ORDERS = (*range(2, 65), 80, 96, 128, 192, 256, 512)


def subsampled_gaussian_rdp(q: float, sigma: float, order: int) -> float:
    """RDP of a whole order of the Gaussian mechanism on a Poisson sample with rate q."""
    if q == 0:
        return 0.0
    if q == 1:
        return order / (2 * sigma**2)
    terms = [
        math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + k * math.log(q) + (order - k) * math.log1p(-q) + k * (k - 1) / (2 * sigma**2)
        for k in range(order + 1)
    ]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)


def rdp_eps(rdp: dict[int, float], delta: float) -> float:
    """Smallest eps over the orders."""
    return max(0.0, min(r + math.log1p(-1 / a) - (math.log(delta) + math.log(a)) / (a - 1) for a, r in rdp.items()))


def sampled_gaussian_eps(q: float, sigma: float, rounds: int, delta: float) -> float:
    return rdp_eps({a: rounds * subsampled_gaussian_rdp(q, sigma, a) for a in ORDERS}, delta)


def sampled_gaussian_sigma(q: float, rounds: int, eps: float, delta: float) -> float:
    """Smallest noise that keeps ``rounds`` rounds within (eps, delta)."""
    return _bisect(1e-2, 1e4, lambda s: sampled_gaussian_eps(q, s, rounds, delta) <= eps, 80)[1]


@dataclass
class Ledger:
    """What has been spent of a zCDP budget, item by item."""

    eps: float
    delta: float
    items: list[tuple[str, float]] = field(default_factory=list)

    @property
    def rho(self) -> float:
        return cdp_rho(self.eps, self.delta)

    @property
    def spent(self) -> float:
        return sum(cost for _, cost in self.items)

    def halt(self, cost: float) -> bool:
        """Whether ``cost`` more would be too much."""
        return self.spent + cost > self.rho * (1 + 1e-9)

    def charge(self, what: str, cost: float) -> None:
        if self.halt(cost):
            raise BudgetExceeded(f"{what} costs {cost:.4g}, {self.rho - self.spent:.4g} is left")
        self.items.append((what, cost))

    def gaussian(self, sigma: float) -> None:
        self.charge("gaussian", gaussian_cost(sigma))

    def exponential(self, eps: float) -> None:
        self.charge("exponential", exponential_cost(eps))

    def laplace(self, scale: float) -> None:
        self.charge("laplace", laplace_cost(scale))

    @property
    def eps_spent(self) -> float:
        return cdp_eps(self.spent, self.delta)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.items, "mechanism string, rho double")


class BudgetNode:
    """A table derived from a protected one. A measurement on a node costs its ancestors: each step of
    stability s multiplies the cost by s; parts of a split that share no rows cost their parent only
    as much as the most expensive of them."""

    def __init__(self, budget: float | None = None, parent: BudgetNode | None = None, stability: float = 1.0, split: bool = False):
        self.budget, self.parent, self.stability, self.split = budget, parent, stability, split
        self.spent = 0.0
        self.parts: dict[int, float] = {}

    def derive(self, stability: float = 1.0) -> BudgetNode:
        return BudgetNode(None, self, stability)

    def partition(self, parts: int) -> list[BudgetNode]:
        """Nodes of disjoint parts."""
        meeting = BudgetNode(None, self, 1.0, split=True)
        return [BudgetNode(None, meeting) for _ in range(parts)]

    def request(self, eps: float) -> None:
        """Charges ``eps`` here and above, or raises BudgetExceeded and charges nothing."""
        todo, node, cost, child = [], self, eps, None
        while node is not None:
            if node.split:
                before = max(node.parts.values(), default=0.0)
                mine = node.parts.get(id(child), 0.0) + cost
                todo.append((node, cost, child))
                cost = max(0.0, mine - before)
            else:
                if node.budget is not None and node.spent + cost > node.budget * (1 + 1e-12):
                    raise BudgetExceeded(f"{cost:.4g} more than {node.budget - node.spent:.4g}")
                todo.append((node, cost, child))
            cost *= node.stability
            child, node = node, node.parent
        for node, cost, child in todo:
            if node.split:
                node.parts[id(child)] = node.parts.get(id(child), 0.0) + cost
            node.spent += 0 if node.split else cost


class Protected:
    """A DataFrame with its budget: transformations keep track of stability, measurements of cost. All
    tables derived from one share its count of measurements, so no two measurements share a draw of noise."""

    def __init__(self, df: DataFrame, node: BudgetNode, seed: str, draws: Iterator[int] | None = None):
        self.df, self.node, self.seed = df, node, seed
        self._draws = counter(1) if draws is None else draws

    @classmethod
    def of(cls, df: DataFrame, budget: float, seed: str) -> Protected:
        return cls(df, BudgetNode(budget), seed)

    def where(self, predicate: str) -> Protected:
        return Protected(self.df.where(predicate), self.node.derive(), self.seed, self._draws)

    def project(self, cols: list[str]) -> Protected:
        return Protected(self.df.select(*cols), self.node.derive(), self.seed, self._draws)

    def split_by(self, col: str, values: list) -> list[Protected]:
        """Disjoint parts, one per value."""
        nodes = self.node.partition(len(values))
        return [Protected(self.df.where(self.df[col] == v), n, self.seed, self._draws) for v, n in zip(values, nodes)]

    def laplace(self, domain, query, eps: float) -> DataFrame:
        """Noisy counts of every cell of a query; a row changes one cell by one."""
        from marginalia.operators import marginals, privacy

        self.node.request(eps)
        full = marginals.zero_filled(marginals.marginals(self.df, domain, [query]), domain, [query])
        return privacy.laplace(full, "cnt", 1.0 / eps, 1.0, f"{self.seed}#{next(self._draws)}", ["query_id", "cell"]).select("cell", "noisy")
