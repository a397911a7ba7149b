"""Accounting of noise from binary trees over the steps of a training run."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from marginalia.plans.accounting import ORDERS, rdp_eps


def node_counts(steps: int, chosen: tuple[int, ...]) -> float:
    """Sum over the nodes of a full binary tree of the squared number of chosen steps below each."""
    total, width = 0.0, 1
    while True:
        counts: dict[int, int] = {}
        for s in chosen:
            counts[s // width] = counts.get(s // width, 0) + 1
        total += sum(c * c for c in counts.values())
        if width >= steps:
            return total
        width *= 2


@lru_cache(maxsize=4096)
def worst_case(steps: int, times: int, apart: int) -> float:
    """The largest node_counts over all choices of at most ``times`` steps that lie at least ``apart``
    steps from each other: by halves of the tree, with how many are chosen in each and how close they
    come to the middle."""
    size = 1
    while size < steps:
        size *= 2

    @lru_cache(maxsize=None)
    def best(width: int, k: int, lead: int, tail: int, inside: int) -> float:
        """k steps in a block of ``width`` of which ``inside`` exist, the first not before ``lead``, the
        last not in the final ``tail``."""
        if k == 0:
            return 0.0
        room = inside - lead - max(0, tail - (width - inside))
        if room <= 0 or (k - 1) * apart >= room:
            return float("-inf")
        if width == 1:
            return 1.0 if k == 1 else float("-inf")
        half, found = width // 2, float("-inf")
        left_in, right_in = min(inside, half), max(0, inside - half)
        for a in range(k + 1):
            if a == 0:
                found = max(found, best(half, k, max(0, lead - half), tail, right_in))
            elif a == k:
                found = max(found, best(half, k, lead, max(0, tail - half), left_in))
            else:
                for gap in range(min(apart, half + 1)):  # the left half's last step has `gap` places after it
                    need = max(0, apart - 1 - gap)
                    if need < half:
                        found = max(found, best(half, a, lead, gap, left_in) + best(half, k - a, need, tail, right_in))
        return found + k * k

    return max(best(size, k, 0, 0, steps) for k in range(1, times + 1))


def brute_force(steps: int, times: int, apart: int) -> float:
    """The same by trying all choices; for tests."""
    out = 0.0
    for k in range(1, times + 1):
        for c in combinations(range(steps), k):
            if all(b - a >= apart for a, b in zip(c, c[1:])):
                out = max(out, node_counts(steps, c))
    return out


def tree_eps(noise: float, steps: int, times: int, apart: int, delta: float, restarts: int = 1) -> float:
    """eps of prefix sums with noise of the given multiple of the clipping bound on every node."""
    cost = worst_case(steps, times, apart) * restarts
    return rdp_eps({a: a * cost / (2 * noise**2) for a in ORDERS}, delta)
