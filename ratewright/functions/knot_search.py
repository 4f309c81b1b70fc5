"""Exact knot search of a long series in parts, and of many responses at once (numpy helpers).

The model is the one of ``joinpoint``: y = a + b t + sum_j d_j max(t - c_j, 0). Products of hinges come from running sums over the points
behind a knot, so a part needs a few arrays as long as the series and no matrix of it. Placements are searched with the last two knots
at once: freed of the line and the knots before, they take a closed form off the sum of squares.

A placement is skipped when a bound shows that it cannot win: between its knots the model is a line, so its sum of squares is no less
than that of separate lines, and the best separate lines for the points behind a knot are found once for all placements.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from ratewright.functions.joinpoint import candidate_knots

#: Cells of one step of the search (placements times responses).
CELLS = 1_000_000
#: A hinge that keeps less than this share of its length once freed of the others is none of its own.
LEAST_OWN = 1e-11


def sums_behind(x: np.ndarray) -> np.ndarray:
    """Sum over the points after each one, added from the end."""
    out = np.zeros_like(x)
    out[:-1] = np.cumsum(x[:0:-1], axis=0)[::-1]
    return out


class Series(NamedTuple):
    """Times on [0, 1], centred responses (points by responses) and the running sums behind each point."""

    u: np.ndarray
    y: np.ndarray
    n: np.ndarray
    su: np.ndarray
    suu: np.ndarray
    sy: np.ndarray
    suy: np.ndarray

    def hinge(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of the hinges at ``p`` with 1, u and the responses."""
        c = self.u[p]
        return self.su[p] - c * self.n[p], self.suu[p] - c * self.su[p], self.suy[p] - c[:, None] * self.sy[p]

    def between(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Products of the hinges at ``p`` and ``q``, which are broadcast against each other."""
        late, a, b = np.maximum(p, q), self.u[p], self.u[q]
        return self.suu[late] - (a + b) * self.su[late] + a * b * self.n[late]


def series_of(t: np.ndarray, y: np.ndarray) -> Series:
    """Series of sorted times and one response, or one per column."""
    y = (y if y.ndim == 2 else y[:, None]).astype(float)
    u = (t - t[0]) / (t[-1] - t[0])
    y = y - y.mean(axis=0)
    return Series(u, y, sums_behind(np.ones(len(u))), sums_behind(u), sums_behind(u * u), sums_behind(y), sums_behind(u[:, None] * y))


class Freed(NamedTuple):
    """Hinges at ``places`` once the line and the knots of a prefix are taken out of them."""

    sse: np.ndarray  # of the line and the prefix alone, per response
    own: np.ndarray
    rest: np.ndarray  # products with the responses
    cross: np.ndarray
    solved: np.ndarray


def freed(s: Series, prefix: tuple[int, ...], places: np.ndarray) -> Freed:
    held = np.array(prefix, int)
    ones, line, target = s.hinge(held)
    base = np.zeros((2 + len(held),) * 2)
    base[0, 0], base[1, 1] = len(s.u), s.u @ s.u
    base[0, 1] = base[1, 0] = s.u.sum()
    base[0, 2:] = base[2:, 0] = ones
    base[1, 2:] = base[2:, 1] = line
    base[2:, 2:] = s.between(held[:, None], held[None, :])
    wanted = np.vstack([s.y.sum(axis=0), s.u @ s.y, target])
    ones, line, target = s.hinge(places)
    cross = np.vstack([ones, line, s.between(held[:, None], places[None, :])])
    solved = np.linalg.solve(base, np.hstack([cross, wanted]))
    coef, solved = solved[:, len(places) :], solved[:, : len(places)]
    own = s.between(places, places)
    left = own - (cross * solved).sum(axis=0)
    left[left <= LEAST_OWN * own] = 0.0
    sse = (s.y * s.y).sum(axis=0) - (wanted * coef).sum(axis=0)
    return Freed(sse, left, target - cross.T @ coef, cross, solved)


def single_gains(f: Freed) -> np.ndarray:
    """What one more knot takes off the sum of squares, places by responses."""
    own = f.own[:, None]
    return np.where(own > 0, f.rest**2 / np.where(own > 0, own, 1.0), -np.inf)


def pair_gains(s: Series, f: Freed, places: np.ndarray, rows: np.ndarray, min_gap: int) -> np.ndarray:
    """What two more knots take off: the first at the places numbered ``rows``, the second at any, by responses."""
    between = s.between(places[rows][:, None], places[None, :]) - f.cross[:, rows].T @ f.solved
    det = f.own[rows][:, None] * f.own[None, :] - between**2
    fine = (places[None, :] >= places[rows][:, None] + min_gap) & (det > LEAST_OWN * f.own[rows][:, None] * f.own[None, :])
    a, b = f.rest[rows][:, None, :], f.rest[None, :, :]
    gain = a * a * f.own[None, :, None] - 2 * a * b * between[:, :, None] + b * b * f.own[rows][:, None, None]
    return np.where(fine[:, :, None], gain / np.where(fine, det, 1.0)[:, :, None], -np.inf)


# many responses


def least_squares_sums(s: Series, knots: int, min_gap: int = 2) -> np.ndarray:
    """Least sum of squares of each response over all placements of ``knots`` knots (infinite where none fits)."""
    places = candidate_knots(s.u, min_gap)
    if knots == 0:
        return freed(s, (), places[:0]).sse
    best = np.full(s.y.shape[1], np.inf)

    def descend(prefix: tuple[int, ...], left: int) -> None:
        after = places[places >= (prefix[-1] + min_gap if prefix else 0)]
        if len(after) < left:
            return
        if left > 2:
            for p in after:
                descend((*prefix, int(p)), left - 1)
            return
        f = freed(s, prefix, after)
        if left == 1:
            np.minimum(best, f.sse - single_gains(f).max(axis=0), out=best)
            return
        step = max(1, CELLS // (len(after) * s.y.shape[1]))
        for at in range(0, len(after), step):
            gains = pair_gains(s, f, after, np.arange(at, min(at + step, len(after))), min_gap)
            np.minimum(best, f.sse - gains.max(axis=(0, 1)), out=best)

    descend((), knots)
    return best


def sse_ratio(smaller: np.ndarray, larger: np.ndarray) -> np.ndarray:
    """Sum of squares of the smaller model over that of the larger one; equal ones, such as two exact fits, give 1."""
    least = max(float(smaller.max()), 1e-300) * 1e-13
    return np.maximum(smaller, least) / np.maximum(larger, least)


# one long response, in parts


def line_costs(s: Series) -> "Costs":
    y = s.y[:, 0]
    return Costs(*[np.concatenate([[0.0], np.cumsum(x)]) for x in (np.ones(len(y)), s.u, s.u * s.u, y, s.u * y, y * y)])


class Costs(NamedTuple):
    """Running sums from the start, for the sum of squares of a line over any run of points."""

    n: np.ndarray
    u: np.ndarray
    uu: np.ndarray
    y: np.ndarray
    uy: np.ndarray
    yy: np.ndarray

    def line(self, i, j) -> np.ndarray:
        """Least sum of squares of one line over the points i to j, both included."""
        n, u, uu, y, uy, yy = (x[np.asarray(j) + 1] - x[i] for x in self)
        suu, suy = uu - u * u / n, uy - u * y / n
        out = yy - y * y / n - np.where(suu > 1e-14, suy**2 / np.where(suu > 1e-14, suu, 1.0), 0.0)
        return np.maximum(out, 0.0)


def separate_lines(costs: Costs, most: int, min_gap: int) -> np.ndarray:
    """Row r, column i: least sum of squares of r + 1 separate lines, each over ``min_gap`` points or more, from point i to the end."""
    n = len(costs.n) - 1
    out = np.full((most, n + 1), np.inf)
    out[0, :n] = costs.line(np.arange(n), n - 1)
    for r in range(1, most):
        for i in range(n - min_gap):
            ends = np.arange(i + min_gap - 1, n - 1)
            if len(ends):
                out[r, i] = np.min(costs.line(i, ends) + out[r - 1, ends + 1])
    return out


class Search(NamedTuple):
    """The search for one number of knots: what is needed to judge placements, and the best one known."""

    series: Series
    costs: Costs
    behind: np.ndarray
    knots: int
    min_gap: int

    def worth(self, prefix: tuple[int, ...], nexts: np.ndarray, upper: float) -> np.ndarray:
        """Which places may follow the prefix in a placement with a sum of squares below ``upper``."""
        starts = (0, *(p + 1 for p in prefix))
        known = sum(float(self.costs.line(a, p)) for a, p in zip(starts, prefix))
        left = self.knots - len(prefix) - 1
        bound = known + self.costs.line(starts[-1], nexts) + self.behind[left, nexts + 1]
        return bound <= upper * (1 + 1e-9) + 1e-12

    def best(self, prefixes: list[tuple[int, ...]], upper: float, known: tuple[int, ...], places: np.ndarray | None = None) -> tuple[float, tuple[int, ...]]:
        """The best placement that begins with one of the prefixes, or the known one; ties go to the earlier places."""
        places = candidate_knots(self.series.u, self.min_gap) if places is None else places
        found = [upper, known]

        def note(sse: float, placement: tuple[int, ...]) -> None:
            if (sse, placement) < (found[0], found[1]):
                found[:] = [sse, placement]

        def descend(prefix: tuple[int, ...]) -> None:
            left = self.knots - len(prefix)
            after = places[places >= (prefix[-1] + self.min_gap if prefix else 0)]
            if len(after) < left:
                return
            if left == 0:
                note(float(freed(self.series, prefix, after[:0]).sse[0]), prefix)
                return
            if left > 2:
                for p in after[self.worth(prefix, after, found[0])]:
                    descend((*prefix, int(p)))
                return
            f = freed(self.series, prefix, after)
            if left == 1:
                gain = single_gains(f)[:, 0]
                note(float(f.sse[0] - gain.max()), (*prefix, int(after[gain.argmax()])))
                return
            rows = np.flatnonzero(self.worth(prefix, after, found[0]))
            step = max(1, CELLS // len(after))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                gain = pair_gains(self.series, f, after, part, self.min_gap)[:, :, 0]
                i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                if np.isfinite(gain[i, j]):
                    note(float(f.sse[0] - gain[i, j]), (*prefix, int(after[part[i]]), int(after[j])))

        for prefix in prefixes:
            descend(prefix)
        return found[0], found[1]


def search_of(t: np.ndarray, y: np.ndarray, knots: int, min_gap: int, behind: np.ndarray | None = None) -> Search:
    s = series_of(t, y)
    costs = line_costs(s)
    return Search(s, costs, separate_lines(costs, knots + 1, min_gap) if behind is None else behind, knots, min_gap)


def first_guess(search: Search, grid: int = 24) -> tuple[float, tuple[int, ...]]:
    """A good placement: the best on a coarse grid, its knots then moved one at a time while that helps."""
    places = candidate_knots(search.series.u, search.min_gap)
    coarse = places[:: max(1, len(places) // grid)]
    sse, knots = search.best([()], np.inf, (), coarse)
    if not knots:
        sse, knots = search.best([()], np.inf, ())
    while knots:
        before = sse
        for i in range(len(knots)):
            others = knots[:i] + knots[i + 1 :]
            apart = np.array([all(abs(p - q) >= search.min_gap for q in others) for p in places])
            f = freed(search.series, others, places[apart])
            gain = single_gains(f)[:, 0]
            trial = float(f.sse[0] - gain.max())
            if trial < sse * (1 - 1e-12):
                sse, knots = trial, tuple(sorted((*others, int(places[apart][gain.argmax()]))))
        if not sse < before:
            break
    return sse, knots
