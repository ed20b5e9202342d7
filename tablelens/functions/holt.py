"""Holt's linear trend (Holt 1957) in a form that can be computed piecewise.

For fixed smoothing weights the state after any stretch of a series is an affine function of the state
before it, and the squared error of the stretch is a quadratic form of that state. Both are 3x3
matrices over (level, trend, 1), for a whole grid of weights at once. Stretches are combined by matrix
products, so the points of one long series need not meet in one task, and the best initial state
follows from two linear equations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

COARSE, FINE, ROUNDS = 21, 11, 7


@dataclass
class Stretch:
    """Effect of consecutive points: ``move`` maps the state, ``cost`` is the squared error."""

    move: np.ndarray   # (grid, 3, 3)
    cost: np.ndarray   # (grid, 3, 3)
    n: int

    @classmethod
    def empty(cls, grid: int) -> Stretch:
        return cls(np.tile(np.eye(3), (grid, 1, 1)), np.zeros((grid, 3, 3)), 0)

    def then(self, later: Stretch) -> Stretch:
        carried = np.swapaxes(self.move, 1, 2) @ later.cost @ self.move
        return Stretch(later.move @ self.move, self.cost + carried, self.n + later.n)


def grid(alpha: tuple[float, float], share: tuple[float, float], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Level weights and trend weights; the trend weight is a share of the level weight, so never larger."""
    a, s = np.meshgrid(np.linspace(*alpha, steps), np.linspace(*share, steps), indexing="ij")
    return a.ravel(), (a * s).ravel()


def stretch(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> Stretch:
    """The points are cut into equal runs that advance side by side; their matrices are multiplied at the end."""
    runs = max(1, int(np.sqrt(len(y) / 4)))
    length = len(y) // runs
    done = _runs(y[:runs * length].reshape(runs, length), alpha, beta)
    if runs * length < len(y):
        done.append(_runs(y[runs * length:][None], alpha, beta)[0])
    total = done[0]
    for part in done[1:]:
        total = total.then(part)
    return total


def _runs(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> list[Stretch]:
    """One stretch per row of ``y``, all of one length.

    How a state is carried on depends on the weights and the length alone; only its constant part depends on the
    values. So the first two columns of all matrices are advanced once for all rows, and the cost is kept as its six
    different entries.
    """
    rows, grid_size = len(y), len(alpha)
    a, ab = alpha, alpha * beta
    level, trend = np.array([[1.0], [0.0]]) * np.ones(grid_size), np.array([[0.0], [1.0]]) * np.ones(grid_size)
    own_level, own_trend = np.zeros((rows, grid_size)), np.zeros((rows, grid_size))
    square, mixed, own = np.zeros((3, grid_size)), np.zeros((2, rows, grid_size)), np.zeros((rows, grid_size))
    step, error = np.empty((rows, grid_size)), np.empty((rows, grid_size))
    for values in y.T:
        level += trend
        square[0] += level[0] * level[0]
        square[1] += level[0] * level[1]
        square[2] += level[1] * level[1]
        own_level += own_trend
        np.subtract(values[:, None], own_level, out=error)
        for k in (0, 1):
            mixed[k] -= np.multiply(level[k], error, out=step)
        own += np.multiply(error, error, out=step)
        own_level += np.multiply(a, error, out=step)
        own_trend += np.multiply(ab, error, out=step)
        trend -= ab * level
        level -= a * level
    move = np.zeros((rows, grid_size, 3, 3))
    move[:, :, 0, :2], move[:, :, 1, :2], move[:, :, 2, 2] = level.T, trend.T, 1.0
    move[:, :, 0, 2], move[:, :, 1, 2] = own_level, own_trend
    cost = np.empty((rows, grid_size, 3, 3))
    cost[:, :, 0, 0], cost[:, :, 1, 1], cost[:, :, 2, 2] = square[0], square[2], own
    cost[:, :, 0, 1] = cost[:, :, 1, 0] = square[1]
    for k in (0, 1):
        cost[:, :, k, 2] = cost[:, :, 2, k] = mixed[k]
    return [Stretch(m, c, y.shape[1]) for m, c in zip(move, cost)]


def best_start(s: Stretch) -> tuple[int, np.ndarray, float]:
    """Index of the best weights, the initial (level, trend) and the squared error."""
    a, b = s.cost[:, :2, :2], s.cost[:, :2, 2]
    scale = 1.0 / np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
    scaled = a * scale[:, :, None] * scale[:, None, :]
    start = -np.einsum("gij,gj->gi", np.linalg.pinv(scaled, rcond=1e-12, hermitian=True), b * scale) * scale
    full = np.concatenate([start, np.ones((len(start), 1))], axis=1)
    sse = np.maximum(np.einsum("gi,gij,gj->g", full, s.cost, full), 0.0)
    low = sse.min()
    i = int(np.flatnonzero(sse <= low * (1 + 1e-9))[0])
    return i, start[i], float(sse[i])


def around(best: float, width: float) -> tuple[float, float]:
    return max(best - width, 0.0), min(best + width, 1.0)


def refine(alpha: float, beta: float, width: float) -> tuple[tuple[float, float], tuple[float, float]]:
    return around(alpha, width), around(beta / alpha if alpha > 0 else 0.0, width)


@dataclass
class Fit:
    alpha: float
    beta: float
    level: float
    trend: float
    sse: float

    def ahead(self, periods: int) -> np.ndarray:
        return self.level + self.trend * np.arange(1, periods + 1)


def final_state(s: Stretch, i: int, start: np.ndarray) -> tuple[float, float]:
    level, trend, _ = s.move[i] @ np.array([start[0], start[1], 1.0])
    return float(level), float(trend)


def slope_between(first: float, last: float, n: int) -> float:
    """Slope of the line through the first and the last point, which is taken out before the search."""
    return (last - first) / (n - 1) if n > 1 else 0.0


def moved(grid: int, by: float) -> Stretch:
    """The state as seen from another line: the level changes by a constant."""
    move = np.eye(3)
    move[0, 2] = by
    return Stretch(np.tile(move, (grid, 1, 1)), np.zeros((grid, 3, 3)), 0)


def steps_of(round_: int) -> int:
    return COARSE if round_ == 0 else FINE


def width_of(round_: int) -> float:
    """How far the search goes on from the best weights after a round."""
    return (2.0 / (FINE - 1)) ** round_ / (COARSE - 1)


def fit(y: np.ndarray) -> Fit:
    """Least squares over both weights and the initial state: grid search, narrowed around the best.

    A straight line passes through the model unchanged; the one through both ends is taken out first and
    added back at the end, which keeps the sums small.
    """
    t = np.arange(len(y), dtype=float)
    slope, base = slope_between(y[0], y[-1], len(y)), y[0]
    rest = y - (base + slope * t)
    bounds, best = ((0.0, 1.0), (0.0, 1.0)), None
    for r in range(ROUNDS):
        alpha, beta = grid(*bounds, steps_of(r))
        s = stretch(rest, alpha, beta)
        i, start, sse = best_start(s)
        if best is None or sse < best.sse:
            level, trend = final_state(s, i, start)
            best = Fit(float(alpha[i]), float(beta[i]), level, trend, sse)
        bounds = refine(best.alpha, best.beta, width_of(r))
    best.level += base + slope * (len(y) - 1)
    best.trend += slope
    return best
