"""Change points of one bounded stretch of a series: PELT (Killick et al. 2012) with a Gaussian-kernel cost."""

from __future__ import annotations

import numpy as np

# Shortest segment, spacing of candidate changes, clip range of scaled distances.
MIN_SIZE = 2
JUMP = 5
CLIP = (1e-2, 1e2)


def median_square_gap(x: np.ndarray) -> float:
    """Median of squared differences over all pairs, without forming the pairs when there are many."""
    n = len(x)
    if n <= 2000:
        i, j = np.triu_indices(n, 1)
        return float(np.median((x[i] - x[j]) ** 2))
    s = np.sort(x)
    pairs = n * (n - 1) // 2
    ranks = [pairs // 2] if pairs % 2 else [pairs // 2 - 1, pairs // 2]
    return float(np.mean([_kth_gap(s, k) ** 2 for k in ranks]))


def _kth_gap(s: np.ndarray, k: int) -> float:
    """The k-th smallest (from 0) difference of a sorted array, by bisection on its value."""
    at = np.arange(len(s))
    lo, hi = 0.0, float(s[-1] - s[0])
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if int((np.searchsorted(s, s + mid, side="right") - at - 1).sum()) > k:
            hi = mid
        else:
            lo = mid
    return hi


def weighted_median_square_gap(values: np.ndarray, counts: np.ndarray) -> float:
    """The same from values with counts, as a histogram gives them: every pair of different rows counts."""
    gaps = ((values[:, None] - values[None, :]) ** 2).ravel()
    pairs = np.outer(counts, counts).astype(float) - np.diag(counts)
    order = np.argsort(gaps)
    below = np.cumsum(pairs.ravel()[order])
    return float(gaps[order][np.searchsorted(below, below[-1] / 2)]) if len(values) and below[-1] else 0.0


def scale_of(spread: float) -> float:
    return 1.0 / spread if spread > 0 else 1.0


def best_intervals(histograms: np.ndarray, centres: np.ndarray, gamma: float, penalty: float) -> list[int]:
    """Which of the given consecutive intervals start a segment, the first left out.

    Interval i has ``histograms[i, b]`` points near ``centres[b]``. Kernel sums of a run of intervals follow from
    prefix sums of the histograms, so every partition is weighed without the points.
    """
    kernel = np.exp(-np.clip(gamma * (centres[:, None] - centres[None, :]) ** 2, *CLIP))
    prefix = np.vstack([np.zeros(histograms.shape[1]), np.cumsum(histograms, axis=0)])
    gram = prefix @ kernel @ prefix.T
    size = prefix.sum(1)
    own = 1.0 - np.exp(-CLIP[0])  # a point with itself counts 1, not the clipped kernel
    best, came_from = np.zeros(len(size)), np.zeros(len(size), int)
    for end in range(1, len(size)):
        n = size[end] - size[:end]
        sums = gram[end, end] - 2 * gram[:end, end] + np.diag(gram)[:end] + own * n
        total = best[:end] + n - sums / np.maximum(n, 1) + penalty
        came_from[end] = int(total.argmin())
        best[end] = total[came_from[end]]
    starts, at = [], len(size) - 1
    while at > 0:
        at = came_from[at]
        if at > 0:
            starts.append(int(at))
    return starts[::-1]


def best_split(histograms: np.ndarray, centres: np.ndarray, gamma: float, allowed: list[int]) -> int | None:
    """The first interval of the right side where the two sides of consecutive intervals cost least together."""
    if not allowed:
        return None
    kernel = np.exp(-np.clip(gamma * (centres[:, None] - centres[None, :]) ** 2, *CLIP))
    upto = np.cumsum(histograms, axis=0)[np.array(allowed) - 1]
    rest = histograms.sum(0) - upto
    own = 1.0 - np.exp(-CLIP[0])
    cost = 0.0
    for side in (upto, rest):
        n = side.sum(1)
        cost = cost + n - (np.einsum("ij,ij->i", side @ kernel, side) + own * n) / np.maximum(n, 1)
    return int(allowed[int(np.argmin(cost))])


def change_points(x: np.ndarray, penalty: float, gamma: float | None = None) -> list[int]:
    """Positions where a new segment starts (the end of the series is left out).

    Kernel sums of every open segment grow by one point at a time, so memory stays linear.
    """
    x = np.asarray(x, dtype=float)
    n = len(x)
    if gamma is None:
        gamma = scale_of(median_square_gap(x))
    starts = np.arange(0, n, JUMP)
    kernel = np.zeros(len(starts))  # sum of the kernel over the segment from each start
    best = {0: 0.0}
    came_from: dict[int, int] = {}
    open_starts: list[int] = []
    added = 0
    for end in [*range(JUMP * -(-MIN_SIZE // JUMP), n, JUMP), n]:
        open_starts.append((end - MIN_SIZE) // JUMP * JUMP)
        oldest = min(open_starts)
        for i in range(added, end):
            upto = i // JUMP + 1
            base = min(oldest, i)
            row = np.exp(-np.clip(gamma * (x[base:i] - x[i]) ** 2, *CLIP))
            tail = np.concatenate([np.cumsum(row[::-1])[::-1], [0.0]])
            live = starts[base // JUMP : upto]
            kernel[base // JUMP : upto] += 2 * tail[live - base] + 1
        added = end
        totals = {}
        for s in dict.fromkeys(open_starts):
            size = end - s
            totals[s] = best[s] + size - kernel[s // JUMP] / size + penalty
        winner = min(totals, key=totals.__getitem__)
        best[end], came_from[end] = totals[winner], winner
        open_starts = [s for s in totals if totals[s] <= best[end] + penalty]
    cuts, at = [], n
    while at > 0:
        at = came_from[at]
        if at > 0:
            cuts.append(at)
    return cuts[::-1]
