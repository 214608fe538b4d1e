"""Least-squares segmentation of one daily series (numpy only; runs inside a task)."""

from __future__ import annotations

import numpy as np

PRUNE_EVERY = 8


def best_breaks(
    values: np.ndarray, min_size: int, penalty: float | str, jump: int = 5
) -> list[int]:
    """Start positions of the segments with the least squared error plus penalties.

    Pruned dynamic programming (Killick, Fearnhead, Eckley 2012) with prefix sums. Breaks
    lie on multiples of ``jump`` and segments have ``min_size`` values or more. A start
    point is dropped only once no later end point can prefer it, so the optimum is exact.
    ``penalty="bic"`` takes 2 * variance * log(n).
    """
    n = len(values)
    if n < 2 * min_size:
        return []
    y = values - values.mean()
    per_break = 2 * y.var() * np.log(n) if penalty == "bic" else float(penalty)
    s1 = np.concatenate(([0.0], np.cumsum(y)))
    s2 = np.concatenate(([0.0], np.cumsum(y * y)))
    grid = [e for e in range(jump, n, jump) if e >= min_size]
    # Columns of the open starts: position, least cost up to it, prefix sums at it, and the
    # first end point at which it was beaten.
    room = len(grid) + 1
    at, cost, c1, c2 = np.zeros(room), np.zeros(room), np.zeros(room), np.zeros(room)
    beaten = np.full(room, n + 1)
    best = np.zeros(n + 1)
    came_from = np.zeros(n + 1, dtype=int)
    used, opened = 1, 0
    for step, end in enumerate([*grid, n]):
        # A grid point can start a segment once that segment would be long enough.
        while opened < len(grid) and grid[opened] <= end - min_size:
            start = grid[opened]
            at[used], cost[used], c1[used], c2[used] = start, best[start], s1[start], s2[start]
            beaten[used] = n + 1
            used, opened = used + 1, opened + 1
        # A start beaten at a point can go once segments may begin at that point.
        if step % PRUNE_EVERY == 0:
            keep = np.flatnonzero(beaten[:used] > end - min_size)
            if len(keep) < used:
                for column in (at, cost, c1, c2, beaten):
                    column[: len(keep)] = column[keep]
                used = len(keep)
        gap = s1[end] - c1[:used]
        error = s2[end] - c2[:used] - gap * gap / (end - at[:used])
        reached = cost[:used] + np.maximum(error, 0.0)
        pick = int(reached.argmin())
        best[end] = reached[pick] + per_break
        came_from[end] = at[pick]
        lost = reached > best[end]
        beaten[:used][lost & (beaten[:used] > end)] = end
    breaks = []
    at = int(came_from[n])
    while at > 0:
        breaks.append(at)
        at = int(came_from[at])
    return breaks[::-1]
