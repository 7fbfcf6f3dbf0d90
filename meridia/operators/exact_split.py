"""The best split of components, by dynamic programming on the driver. It needs a row for each component, never points.

Objectives, each among the best of those before: the fewest points left out, the smallest largest component left out, the
least sum of squares of left-out sizes, the least worst deviation from the ratios. Among equal splits the one that puts
larger components, by (size, name), into earlier splits wins. Nothing is left out where all components fit.

A state is the number of points in train, in val and left out so far; test has the rest. States beyond what the tolerance
allows are cut, which loses no split. Where more than `limit` states would be needed, solve() gives None, and the caller
falls back to the greedy one, which proves nothing.
"""

from __future__ import annotations

import math

import numpy as np

from meridia.operators.assign import EXCLUDED, RATIOS, SPLITS, Outcome
from meridia.operators.assign import solve as greedy

NEVER = np.int64(1) << 60


def _best(sizes: list[int], removed: int, largest: int, ratios: tuple[float, ...], tolerance: float) -> tuple[float, float, list[int]] | None:
    """(squares, deviation, split of each size) with exactly `removed` points left out, none in a larger component."""
    total = sum(sizes)
    kept = total - removed
    most = [math.floor((r + tolerance) * kept + 1e-9) for r in ratios]
    cost = np.full((most[0] + 1, most[1] + 1, removed + 1), NEVER)
    cost[0, 0, 0] = 0
    how = []
    for n in sizes:
        new, by = np.full_like(cost, NEVER), np.zeros(cost.shape, np.uint8)
        options = [(0, (n, 0, 0), 0), (1, (0, n, 0), 0), (2, (0, 0, 0), 0)] + ([(3, (0, 0, n), n * n)] if n <= largest else [])
        for split, step, price in options:
            if any(s >= d for s, d in zip(step, cost.shape, strict=True)):
                continue
            to = tuple(slice(s, None) for s in step)
            old = cost[tuple(slice(None, d - s) for s, d in zip(step, cost.shape, strict=True))] + price
            better = old < new[to]
            new[to] = np.where(better, old, new[to])
            by[to][better] = split
        cost = new
        how.append(by)
    train, val = np.indices(cost.shape[:2])
    parts = [train, val, kept - train - val]
    worst = np.max([np.abs(p / kept - r) for p, r in zip(parts, ratios, strict=True)], axis=0)
    ok = (cost[:, :, removed] < NEVER) & (worst <= tolerance + 1e-12) & (np.min(parts, axis=0) >= 1)
    if not ok.any():
        return None
    squares = cost[:, :, removed][ok].min()
    worst = np.where(ok & (cost[:, :, removed] == squares), worst, np.inf)
    at = [*np.unravel_index(np.argmin(worst), worst.shape), removed]
    out = []
    for n, by in zip(reversed(sizes), reversed(how), strict=True):
        split = int(by[tuple(at)])
        out.append(split)
        if split != 2:
            at[2 if split == 3 else split] -= n
    return float(squares), float(worst.min()), out[::-1]


def solve(components: list[tuple[int, int, object]], ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05, limit: int = 60_000_000) -> Outcome | None:
    """components: (id, size, name). None: more states than `limit`."""
    if len(components) < len(ratios):
        return Outcome("infeasible", message=f"{len(components)} components can't fill {len(ratios)} splits", proven=True)
    order = sorted(components, key=lambda c: (-c[1], c[2]))
    sizes = [n for _, n, _ in order]
    total = sum(sizes)
    sums = np.zeros(total + 1, bool)
    sums[0] = True
    for n in sizes:
        sums[n:] |= sums[: total + 1 - n].copy()
    for removed in np.flatnonzero(sums[: max(0, total - len(ratios)) + 1]).tolist():
        kept = total - removed
        if len(sizes) * ((ratios[0] + tolerance) * kept + 1) * ((ratios[1] + tolerance) * kept + 1) * (removed + 1) > limit:
            return None
        if _best(sizes, removed, removed, ratios, tolerance) is None:
            continue
        choices = sorted({n for n in sizes if n <= removed}) or [0]
        low, high = 0, len(choices) - 1
        while low < high:  # the smallest bound on what is left out that still allows a split
            middle = (low + high) // 2
            if _best(sizes, removed, choices[middle], ratios, tolerance) is None:
                low = middle + 1
            else:
                high = middle
        _, _, splits = _best(sizes, removed, choices[low], ratios, tolerance)
        names = (*SPLITS, EXCLUDED)
        return Outcome("ok", {c: names[s] for (c, _, _), s in zip(order, splits, strict=True)}, removed > 0, True)
    return Outcome("infeasible", proven=True, message="no split is within the tolerance, even without some components")


def best_or_greedy(components: list[tuple[int, int, object]], ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05, limit: int = 60_000_000) -> Outcome:
    """The best split, or where it takes too many states the greedy one, of which `proven` is false."""
    found = solve(components, ratios, tolerance, limit)
    return greedy(components, ratios, tolerance) if found is None else found
