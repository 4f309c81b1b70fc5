"""Least-squares search for the knots of one short series (numpy helper).

Model: y = a + b t + sum_j d_j max(t - c_j, 0), continuous at the knots c_j.
Knots are tried at observed times, as in the grid search of Kim et al. (2000);
the number of knots is chosen by BIC(k) = ln(SSE/n) + 2 (k + 1) ln(n) / n.
"""

from __future__ import annotations

from itertools import combinations, islice
from typing import NamedTuple

import numpy as np

BATCH = 256


class Fit(NamedTuple):
    knots: tuple[float, ...]
    coef: np.ndarray  # a, b, d_1, ..., d_k
    cov: np.ndarray
    sse: float
    bic: float

    def at(self, t: np.ndarray) -> np.ndarray:
        """Fitted values."""
        hinges = [d * np.maximum(t - c, 0.0) for d, c in zip(self.coef[2:], self.knots)]
        return self.coef[0] + self.coef[1] * t + sum(hinges, np.zeros(len(t)))


def candidate_knots(t: np.ndarray, min_gap: int) -> np.ndarray:
    """Positions of the inner times that leave ``min_gap`` points before and after."""
    return np.arange(min_gap, len(t) - min_gap)


def best_fit(t: np.ndarray, y: np.ndarray, k: int, min_gap: int = 2) -> Fit | None:
    """Best placement of exactly k knots at least ``min_gap`` points apart, or None."""
    n = len(t)
    if n < k + 3 and not (k == 0 and n >= 2):
        return None
    if k == 0:
        return fit_at(t, y, ())
    places = candidate_knots(t, min_gap)
    if len(places) < k:
        return None
    # Work on a unit time axis; the hinge Gram matrix is built once and sliced.
    span = t[-1] - t[0]
    u, yc = (t - t[0]) / span, y - y.mean()
    hinge = np.maximum(u[:, None] - u[places][None, :], 0.0)
    design = np.column_stack([np.ones(n), u, hinge])
    gram, target = design.T @ design, design.T @ yc
    own, index = np.diag(gram)[2:], np.arange(len(places))
    best, best_sse = None, np.inf
    # All knots but the last are enumerated; the last is found for all its places at once: what a hinge
    # takes off the sum of squares is its residual product with y, squared, over its residual length.
    sets = (c for c in combinations(range(len(places)), k - 1) if all(q - p >= min_gap for p, q in zip(c, c[1:])))
    while batch := list(islice(sets, BATCH)):
        pick = np.array(batch, dtype=int).reshape(len(batch), k - 1)
        cols = np.hstack([np.tile([0, 1], (len(pick), 1)), pick + 2])
        a, b = gram[cols[:, :, None], cols[:, None, :]], target[cols]
        across = gram[cols][:, :, 2:]
        solved = np.linalg.solve(a, np.concatenate([across, b[:, :, None]], axis=2))
        coef = solved[:, :, -1]
        length = own - np.einsum("ijk,ijk->ik", across, solved[:, :, :-1])
        product = target[2:] - np.einsum("ijk,ij->ik", across, coef)
        later = pick[:, -1:] + min_gap if k > 1 else np.zeros((1, 1), int)
        gain = np.where((index >= later) & (length > 0), product**2 / np.where(length > 0, length, 1.0), -np.inf)
        sse = (yc @ yc - np.einsum("ij,ij->i", coef, b))[:, None] - gain
        i, last = np.unravel_index(int(np.argmin(sse)), sse.shape)
        if sse[i, last] < best_sse:
            best, best_sse = [*pick[i], last], sse[i, last]
    return None if best is None else fit_at(t, y, tuple(t[places[best]]))


def fit_at(t: np.ndarray, y: np.ndarray, knots: tuple[float, ...]) -> Fit:
    """Least squares with the given knots."""
    n, k = len(t), len(knots)
    origin = t.mean()
    x = np.column_stack([np.ones(n), t - origin, *[np.maximum(t - c, 0.0) for c in knots]])
    inverse = np.linalg.pinv(x.T @ x)
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ coef
    sse = float(residual @ residual)
    spread = sse / (n - k - 2) if n > k + 2 else 0.0
    coef[0] -= coef[1] * origin  # intercept back on the original time axis
    floor = max(float(((y - y.mean()) ** 2).sum()) * 1e-20, 1e-300)
    bic = float(np.log(max(sse, floor) / n) + 2 * (k + 1) * np.log(n) / n)
    return Fit(tuple(float(c) for c in knots), coef, inverse * spread, sse, bic)


def choose_fit(t: np.ndarray, y: np.ndarray, max_knots: int, min_gap: int = 2) -> list[Fit]:
    """Best fit per number of knots, the BIC choice first."""
    fits = [f for k in range(max_knots + 1) if (f := best_fit(t, y, k, min_gap)) is not None]
    return sorted(fits, key=lambda f: (f.bic, len(f.knots)))


def slopes(fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Slope of each segment and the covariance of the slopes."""
    k = len(fit.knots)
    combine = np.zeros((k + 1, k + 2))
    combine[:, 1] = 1.0
    for j in range(k):
        combine[j + 1 :, j + 2] = 1.0
    return combine @ fit.coef, combine @ fit.cov @ combine.T
