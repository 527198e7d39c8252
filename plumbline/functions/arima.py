"""Exact Gaussian likelihood of ARIMA(1,1,1), evaluated block by block.

With w the first difference of the series, the one-step errors of an ARMA(1,1) obey
``e[t] = w[t] - φ w[t-1] - (θ / r[t-2]) e[t-1]`` where the scale ``r`` has a closed form
(Brockwell & Davis, *Time Series*, innovations algorithm). Errors are therefore an affine
function of the last error of the previous block: each block is summed up by five numbers
per candidate (φ, θ), and blocks fold together exactly, in order.
"""

from __future__ import annotations

import numpy as np

_LIMIT = 0.9999
COARSE = 19
FINE = 9
ROUNDS = 4


def first_grid() -> np.ndarray:
    axis = np.linspace(-0.9, 0.9, COARSE)
    return np.array([(p, q) for p in axis for q in axis])


def zoom(center: np.ndarray, width: float) -> np.ndarray:
    axis = np.linspace(-width, width, FINE)
    grid = np.array([(center[0] + p, center[1] + q) for p in axis for q in axis])
    return np.clip(grid, -_LIMIT, _LIMIT)


def widths() -> list[float]:
    """Half-width of the search square in each round after the first."""
    step, out = 1.8 / (COARSE - 1), []
    for _ in range(ROUNDS):
        out.append(step)
        step = 2 * step / (FINE - 1)
    return out


def scale(t: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """``r[t]``, the variance of the t-th one-step error over σ² (t from 0; rows t, columns candidates)."""
    start = (theta + phi) ** 2 / (1 - phi**2)
    fade = np.power(theta[None, :] ** 2, np.minimum(t, 1_000_000)[:, None].astype(float))
    return 1 + fade * start / (1 + start * (1 - fade) / (1 - theta**2))


def summarize(w: np.ndarray, before: float, first: int, grid: np.ndarray) -> np.ndarray:
    """Columns ``(a, b, s0, s1, s2, logs)`` of differences ``w`` whose first has index ``first`` (0-based).

    ``before`` is the difference just ahead of the block. The block's last error is
    ``a + b·e`` and its sum of squares ``s0 + 2·s1·e + s2·e²`` for an incoming error e.
    """
    phi, theta = grid[:, 0], grid[:, 1]
    g = len(grid)
    a, b = np.zeros(g), np.ones(g)
    s0, s1, s2, logs = (np.zeros(g) for _ in range(4))
    prev = before
    chunk = 4096
    for lo in range(0, len(w), chunk):
        part = w[lo : lo + chunk]
        r = scale(np.arange(first + lo, first + lo + len(part)), phi, theta)
        if first + lo > 0:
            r_before = scale(np.array([first + lo - 1]), phi, theta)[0]
        else:
            r_before = None
        logs += np.log(r).sum(axis=0)
        for i, x in enumerate(part):
            if r_before is None:  # the very first difference is predicted by zero
                a, b = np.full(g, x), np.zeros(g)
            else:
                gain = theta / r_before
                a = x - phi * prev - gain * a
                b = -gain * b
            inv = 1 / r[i]
            s0 += a * a * inv
            s1 += a * b * inv
            s2 += b * b * inv
            prev, r_before = x, r[i]
    return np.column_stack([a, b, s0, s1, s2, logs])


def compose(blocks: list[np.ndarray]) -> np.ndarray:
    """Consecutive blocks as one: affine maps and their squares chain exactly."""
    a, b, s0, s1, s2, logs = blocks[0].T
    for a2, b2, t0, t1, t2, more in (block.T for block in blocks[1:]):
        s0, s1, s2 = (
            s0 + t0 + 2 * t1 * a + t2 * a * a,
            s1 + t1 * b + t2 * a * b,
            s2 + t2 * b * b,
        )
        a, b, logs = a2 + b2 * a, b2 * b, logs + more
    return np.column_stack([a, b, s0, s1, s2, logs])


def fold(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order → ``(sum of squares, sum of logs, last error)`` per candidate."""
    e = np.zeros(len(blocks[0]))
    total, logs = np.zeros_like(e), np.zeros_like(e)
    for a, b, s0, s1, s2, lg in (block.T for block in blocks):
        total = total + s0 + 2 * s1 * e + s2 * e * e
        logs = logs + lg
        e = a + b * e
    return total, logs, e


def pick(total: np.ndarray, logs: np.ndarray, m: int) -> int:
    """Candidate with the highest likelihood (σ² profiled out)."""
    return int(np.argmin(m * np.log(np.maximum(total, 1e-300) / m) + logs))


def project(last: float, last_w: float, last_e: float, phi: float, theta: float, sigma2: float, m: int, horizon: int):
    """``(mean, standard error)`` of the next ``horizon`` values of the series."""
    r_last = scale(np.array([m - 1]), np.array([phi]), np.array([theta]))[0, 0]
    r_next = scale(np.array([m]), np.array([phi]), np.array([theta]))[0, 0]
    step = phi * last_w + theta / r_last * last_e
    mean, level = [], last
    for _ in range(horizon):
        level += step
        mean.append(level)
        step *= phi
    psi = np.array([1.0, *[(phi + theta) * phi**j for j in range(horizon - 1)]])[:horizon]
    summed = np.cumsum(psi)
    carried = np.cumsum(phi ** np.arange(horizon)) ** 2 * (r_next - 1)
    variance = sigma2 * (np.cumsum(summed**2) + carried)
    return np.array(mean), np.sqrt(np.maximum(variance, 0.0))


def fit_one_block(w: np.ndarray) -> tuple[float, float, float, float]:
    """``(φ, θ, σ², last error)`` of a series short enough for one task."""
    grid = first_grid()
    m = len(w)
    for width in [*widths(), None]:
        summary = summarize(w, 0.0, 0, grid)
        total, logs, e = fold([summary])
        best = pick(total, logs, m)
        if width is None:
            break
        grid = zoom(grid[best], width)
    return float(grid[best, 0]), float(grid[best, 1]), float(total[best] / m), float(e[best])
