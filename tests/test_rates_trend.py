"""Rates, joinpoints, quantiles, density against closed forms and brute force."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.functions import knot_search
from ratewright.functions.joinpoint import best_fit, candidate_knots, choose_fit
from ratewright.operators.rates import rate_cells, standardised_rate
from ratewright.operators import trend
from ratewright.operators.trend import (
    average_change,
    density_feed,
    group_quantiles,
    joinpoint_trend,
    loglinear_trend,
    one_joinpoint,
    permutation_joinpoints,
    trend_points,
    trend_summary,
)
from ratewright.sources.losses import Losses
from ratewright.sources.tables import written


def cells(spark, rows):
    return spark.createDataFrame(rows, "k string, age string, n long, pop double, weight double")


def test_rate_equals_crude_rate_when_population_is_the_standard(spark):
    df = cells(spark, [("k", "a", 30, 1000.0, 1000.0), ("k", "b", 20, 3000.0, 3000.0)])
    row = standardised_rate(df, ["k"]).first()
    assert row["value"] == pytest.approx(1e5 * 50 / 4000)
    # Limits of the crude rate are Byar's limits of the count.
    low = 50 * (1 - 1 / 450 - 1.959964 / (3 * math.sqrt(50))) ** 3
    high = 51 * (1 - 1 / 459 + 1.959964 / (3 * math.sqrt(51))) ** 3
    assert row["lowercl"] == pytest.approx(1e5 * low / 4000, rel=1e-6)
    assert row["uppercl"] == pytest.approx(1e5 * high / 4000, rel=1e-6)


def test_small_counts_and_gaps_give_no_rate(spark):
    df = cells(spark, [("few", "a", 9, 100.0, 1.0), ("gap", "a", 50, None, 1.0), ("gap", "b", 50, 10.0, 1.0), ("none", "a", 0, 10.0, 1.0)])
    got = {r["k"]: (r["value"], r["lowercl"]) for r in standardised_rate(df, ["k"]).collect()}
    assert got == {"few": (None, None), "gap": (None, None), "none": (None, None)}
    got = {r["k"]: (r["value"], r["lowercl"]) for r in standardised_rate(df, ["k"], min_events=0).collect()}
    assert got["few"][0] == pytest.approx(9000) and got["none"] == (0.0, None) and got["gap"] == (None, None)


def test_zero_fill_completes_the_weights(spark):
    counts = spark.createDataFrame([("k", "a", 30)], "k string, age string, n long")
    population = spark.createDataFrame([("a", 1000.0), ("b", 500.0)], "age string, pop double")
    standard = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "age string, weight double")
    observed = standardised_rate(rate_cells(counts, population, standard, ["age"], ["age"]), ["k"]).first()
    full = standardised_rate(rate_cells(counts, population, standard, ["age"], ["age"], {"age": ["a", "b"]}), ["k"]).first()
    assert observed["value"] == pytest.approx(3000)
    assert full["value"] == pytest.approx(750)


def test_zero_fill_keeps_every_event(spark):
    counts = spark.createDataFrame([("k", "a", 5), ("k", "unlisted", 3), ("k", None, 7)], "k string, age string, n long")
    population = spark.createDataFrame([("a", 10.0), (None, 20.0)], "age string, pop double")
    standard = spark.createDataFrame([("a", 1.0)], "age string, weight double")
    got = {r["age"]: (r["n"], r["pop"]) for r in rate_cells(counts, population, standard, ["age"], ["age"], {"age": ["a", "b"]}).collect()}
    assert got == {"a": (5, 10.0), "b": (0, None), "unlisted": (3, None), None: (7, 20.0)}


def line(t, knots, slopes, start=1.0):
    y, level, last = [], start, t[0]
    bends = [*knots, float("inf")]
    j = 0
    for x in t:
        while x > bends[j]:
            level += slopes[j] * (bends[j] - last)
            last = bends[j]
            j += 1
        y.append(level + slopes[j] * (x - last))
    return np.array(y)


def brute_force(t, y, k, gap=2):
    best = (np.inf, None)
    for pick in combinations(candidate_knots(t, gap), k):
        if any(b - a < gap for a, b in zip(pick, pick[1:])):
            continue
        x = np.column_stack([np.ones(len(t)), t, *[np.maximum(t - t[i], 0) for i in pick]])
        coef = np.linalg.lstsq(x, y, rcond=None)[0]
        sse = float(((y - x @ coef) ** 2).sum())
        if sse < best[0]:
            best = (sse, tuple(t[list(pick)]))
    return best


@pytest.mark.parametrize("k", [1, 2, 3])
def test_search_equals_brute_force(k):
    rng = np.random.default_rng(k)
    t = np.sort(rng.choice(np.arange(1990, 2030), 18, replace=False)).astype(float)
    y = rng.normal(size=len(t)).cumsum()
    fit = best_fit(t, y, k)
    sse, knots = brute_force(t, y, k)
    assert fit.sse == pytest.approx(sse, rel=1e-8)
    assert fit.knots == knots


@pytest.mark.parametrize("knots, slopes", [((), (0.03,)), ((2015.0,), (0.05, -0.02)), ((2013.0, 2018.0), (0.05, -0.02, 0.1))])
def test_noiseless_joinpoints_are_found(spark, knots, slopes):
    t = np.arange(2010, 2024)
    rng = np.random.default_rng(0)
    y = line(t.astype(float), knots, slopes) + rng.normal(scale=1e-5, size=len(t))
    df = spark.createDataFrame([("g", int(a), float(math.exp(b))) for a, b in zip(t, y)], "g string, year int, value double")
    fit = joinpoint_trend(df, ["g"], "year", "value").orderBy("segment").collect()
    assert [r["knot"] for r in fit] == [None, *knots]
    assert [r["slope"] for r in fit] == pytest.approx(slopes, abs=1e-4)
    assert [r["apc"] for r in fit] == pytest.approx([100 * math.expm1(s) for s in slopes], abs=1e-2)
    assert all(r["apc_low"] < r["apc"] < r["apc_high"] for r in fit)
    ends = [2010, *knots, 2023]
    mean = sum(s * (b - a) for s, a, b in zip(slopes, ends, ends[1:])) / 13
    average = average_change(joinpoint_trend(df, ["g"], "year", "value"), ["g"]).first()
    assert average["aapc"] == pytest.approx(100 * math.expm1(mean), abs=1e-2)
    assert average["aapc_low"] < average["aapc"] < average["aapc_high"]
    points = trend_points(df, joinpoint_trend(df, ["g"], "year", "value"), ["g"], "year", "value").collect()
    assert len(points) == 14
    assert all(r["fit"] == pytest.approx(r["obs"], abs=1e-4) for r in points)
    assert {r["joinpoint"] for r in points if r["joinpoint"]} == set(knots)
    table = trend_summary(joinpoint_trend(df, ["g"], "year", "value"), {"Level": F.col("g")}).orderBy("segment").collect()
    assert table[0]["period"].startswith("2010-") and table[-1]["period"].endswith("-2023")


def test_one_joinpoint_agrees_with_the_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b", "c"):
        t = np.arange(2000, 2020)
        rows += [(g, int(x), float(math.exp(v))) for x, v in zip(t, rng.normal(size=20).cumsum() / 10)]
    df = spark.createDataFrame(rows, "g string, year int, value double")
    for r in one_joinpoint(df, ["g"], "year", "value").collect():
        t = np.array([x for g, x, _ in rows if g == r["g"]], float)
        y = np.log([v for g, _, v in rows if g == r["g"]])
        fit = best_fit(t, y, 1)
        assert r["knot"] == fit.knots[0]
        assert r["sse"] == pytest.approx(fit.sse, rel=1e-8)
        assert r["slope_2"] == pytest.approx(fit.coef[1] + fit.coef[2], rel=1e-8)


def test_straight_line_agrees_with_aggregates(spark):
    df = spark.createDataFrame([("g", y, 3.0 * 1.05 ** (y - 2000)) for y in range(2000, 2010)] + [("z", 2000, 0.0)], "g string, year int, value double")
    row = loglinear_trend(df, ["g"], "year", "value").collect()
    assert len(row) == 1 and row[0]["apc"] == pytest.approx(5) and row[0]["points"] == 10
    assert choose_fit(np.array([1.0, 2.0]), np.array([1.0, 2.0]), 3)[0].knots == ()


def test_quantiles_with_narrow_brackets(spark):
    """The sketch brackets are used (more rows than the accuracy) and the result is exact."""
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.lognormal(size=3000)] + [("b", float(v)) for v in rng.integers(0, 5, 2000)] + [("c", 7.0), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    for r in group_quantiles(df, ["g"], "v", probs, accuracy=100).collect():
        values = [v for g, v in data if g == r["g"]]
        assert [r[f"q_{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
        assert r["points"] == len(values)


def test_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(50, 10, 400), "b": rng.normal(90, 5, 300)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    feed = density_feed(df, ["g"], "v", limits=(0, 150)).toPandas()
    assert (feed.groupby("g").size() == 512).all()
    width = np.mean([0.9 * min(v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34) * len(v) ** -0.2 for v in data.values()])
    for g, part in feed.sort_values("x").groupby("g"):
        x = part["x"].to_numpy()
        direct = np.exp(-0.5 * ((x[:, None] - data[g][None, :]) / width) ** 2).mean(axis=1) / width / math.sqrt(2 * math.pi)
        assert np.abs(part["density"].to_numpy() - direct).max() < 2e-3 * direct.max()
        assert np.trapezoid(part["density"], x) == pytest.approx(1, abs=5e-3)


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """The functions that run in Python workers travel with the job."""
    import subprocess
    import sys
    from pathlib import Path

    script = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from ratewright.session import local_session
from ratewright.operators.frequency import chi_square
from ratewright.operators.trend import joinpoint_trend
spark = local_session("far", 2)
df = spark.createDataFrame([("g", y, 1.0 + y % 3) for y in range(2000, 2012)], "g string, y int, v double")
assert joinpoint_trend(df, ["g"], "y", "v", 1).count() >= 1
assert chi_square(df, "y", "v").first()["p_value"] is not None
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


# knots of long series, permutation tests, counted points


def bent(rng, n, noise, knots=(0.3, 0.7)):
    t = np.arange(n) * 1.0
    line = 0.01 * t - 0.02 * np.maximum(t - knots[0] * n, 0) + 0.03 * np.maximum(t - knots[1] * n, 0)
    return t, line + rng.normal(size=n) * noise


@pytest.mark.parametrize("n, k", [(12, 3), (25, 1), (25, 2), (40, 3), (18, 4)])
def test_split_search_finds_what_the_whole_search_finds(n, k):
    rng = np.random.default_rng(n + k)
    for trial in range(12):
        t = np.sort(rng.choice(1000, n, replace=False)).astype(float)
        y = rng.normal(size=n) * 0.3 + 0.01 * t * (trial % 3) - 0.02 * np.maximum(t - 500, 0)
        want = best_fit(t, y, k)
        search = knot_search.search_of(t, y, k, 2)
        upper, known = knot_search.first_guess(search)
        places = candidate_knots(t, 2)
        first = places[search.worth((), places, upper)]
        parts = [search.best([(int(p),) for p in first[i::3]], upper, known) for i in range(3)]
        sse, knots = min(parts)
        assert tuple(t[list(knots)]) == want.knots and sse == pytest.approx(want.sse, rel=1e-8)
        responses = np.column_stack([y, rng.permutation(y), 3 * y + 1])
        sums = knot_search.least_squares_sums(knot_search.series_of(t, responses), k)
        assert sums == pytest.approx([best_fit(t, c, k).sse for c in responses.T], rel=1e-8)


def test_the_bound_of_separate_lines_never_exceeds_a_continuous_fit():
    rng = np.random.default_rng(8)
    t, y = bent(rng, 30, 1.0)
    search = knot_search.search_of(t, y, 2, 2)
    for p, q in combinations(candidate_knots(t, 2), 2):
        if q - p >= 2:
            sse = float(knot_search.freed(search.series, (int(p), int(q)), np.zeros(0, int)).sse[0])
            assert search.worth((), np.array([p]), sse)[0] and search.worth((int(p),), np.array([q]), sse)[0]


def test_a_thousand_points_and_three_knots_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t, y = bent(rng, 1000, 1.0)
    rows = [("a", int(x), float(np.exp(v / 4))) for x, v in zip(t, y)] + [("short", i, 1.0 + i) for i in range(4)] + [(None, i, 2.0) for i in range(9)] + [("one", 1, 1.0)]
    series = spark.createDataFrame(rows, "g string, t int, v double")
    seen = []
    monkeypatch.setattr(trend, "written", lambda df: seen.append(out := written(df)) or out)
    got = joinpoint_trend(series, ["g"], "t", "v", 3, split=True).collect()
    knots = [r["knot"] for r in sorted(got, key=lambda r: r["segment"]) if r["g"] == "a" and r["knot"] is not None]
    search = knot_search.search_of(t, y / 4, 3, 2)
    upper, known = knot_search.first_guess(search)
    fits = [best_fit(t, y / 4, k) for k in (0, 1, 2)] + [trend.fit_at(t, y / 4, tuple(t[list(search.best([()], upper, known)[1])]))]
    assert knots == list(min(fits, key=lambda f: f.bic).knots) and len(knots) >= 2
    parts = next(df for df in seen if "_part" in df.columns)
    assert parts.filter("g = 'a' and _k = 3").count() > 1  # the search of one series is several rows, dealt over the tasks
    whole = joinpoint_trend(series.filter("g is null or g <> 'a'"), ["g"], "t", "v", 3).collect()
    numbers = lambda found: sorted((str(r["g"]), r["segment"], round(r["slope"], 9), round(r["bic"], 6)) for r in found if r["g"] != "a")
    assert numbers(got) == numbers(whole) and {r[0] for r in numbers(got)} == {"short", "None"}
    assert joinpoint_trend(series.limit(0), ["g"], "t", "v", 3, split=True).count() == 0


def sequential_tests(t, y, most, permutations, level, seed=1):
    """The sequential rule one permutation after the other, with the whole search."""
    smaller, larger, out = 0, most, []
    while smaller < larger:
        null = best_fit(t, y, smaller)
        fitted = null.at(t)
        ratio = lambda v: best_fit(t, v, smaller).sse / best_fit(t, v, larger).sse
        seen = ratio(y)
        more = sum(ratio(fitted + (y - fitted)[trend.hash_order(len(t), f"{seed}:{i}")]) >= seen * (1 - 1e-9) for i in range(1, permutations + 1))
        p = (more + 1) / (permutations + 1)
        out.append((smaller, larger, p))
        if p <= level / most:
            smaller += 1
        else:
            larger -= 1
    return smaller, out


def test_permutation_tests_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, (n, noise, knots) in {"none": (18, 1.0, (2, 3)), "one": (20, 0.05, (0.5, 2)), "two": (24, 0.02, (0.3, 0.7))}.items():
        t = np.arange(n) * 1.0
        y = 0.1 * t - 0.3 * np.maximum(t - knots[0] * n, 0) + 0.4 * np.maximum(t - knots[1] * n, 0) + rng.normal(size=n) * noise
        rows += [(g, float(a), float(np.exp(b))) for a, b in zip(t, y)]
        want[g] = sequential_tests(t, np.log([np.exp(b) for b in y]), 2, 39, 0.1)
    series = spark.createDataFrame(rows, "g string, t double, v double").repartition(5)
    found = permutation_joinpoints(series, ["g"], "t", "v", 2, permutations=39, level=0.1, part=7)
    got = {r["g"]: (r["joinpoints"], r["p_value"]) for r in found.collect()}
    assert {g: k for g, (k, _) in got.items()} == {g: k for g, (k, _) in want.items()} == {"none": 0, "one": 1, "two": 2}
    assert all(p == pytest.approx(want[g][1][-1][2]) for g, (_, p) in got.items())
    steps = permutation_joinpoints(series, ["g"], "t", "v", 2, permutations=39, level=0.1, part=50, trace=True).collect()
    for g, (_, tests) in want.items():
        mine = [(r["smaller"], r["larger"], pytest.approx(r["p_value"])) for r in sorted(steps, key=lambda r: r["step"]) if r["g"] == g]
        assert tests == mine
    # The chosen number of joinpoints can be fitted instead of the one the BIC chooses.
    lines = joinpoint_trend(series, ["g"], "t", "v", joinpoints=found)
    assert {r["g"]: r["n"] for r in lines.groupBy("g").agg(F.max("joinpoints").alias("n")).collect()} == {"none": 0, "one": 1, "two": 2}


def test_short_series_are_tested_as_far_as_they_go(spark):
    rows = [("two", 1, 1.0), ("two", 2, 3.0), ("five", 1, 1.0), ("five", 2, 2.0), ("five", 3, 1.0), ("five", 4, 2.0), ("five", 5, 4.0), ("one", 1, 1.0)]
    series = spark.createDataFrame(rows, "g string, t int, v double")
    got = {r["g"]: (r["joinpoints"], r["p_value"] is None) for r in permutation_joinpoints(series, ["g"], "t", "v", 3, permutations=19).collect()}
    assert got == {"two": (0, True), "five": (0, False)}


def test_points_without_a_logarithm_are_counted(spark):
    rows = [("a", i, float(i)) for i in range(1, 9)] + [("a", 20, 0.0), ("a", 21, -1.0), ("b", 1, None), ("b", 2, float("nan")), ("b", 3, float("inf"))]
    series = spark.createDataFrame(rows, "g string, t int, v double")
    for fit in (loglinear_trend, one_joinpoint, joinpoint_trend):
        losses = Losses()
        found = fit(series, ["g"], "t", "v", losses=losses).collect()
        assert {r["g"] for r in found} == {"a"}
        assert losses.counts() == [("trend", "points", 13), ("trend", "no_logarithm", 5)]
    losses = Losses()
    assert trend_points(series, joinpoint_trend(series, ["g"], "t", "v", 0), ["g"], "t", "v", losses=losses).count() == 8
    assert losses.counts() == [("trend points", "points", 13), ("trend points", "no_logarithm", 5)]


def test_density_is_one_plan_without_driver_steps(spark, plan):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    feed = density_feed(df, ["g"], "v", points=64)
    assert "Subquery" in plan(feed)
    step = feed.orderBy("g", "point").collect()
    for g in "ab":
        mine = [r for r in step if r["g"] == g]
        assert len(mine) == 64 and sum(r["density"] for r in mine) * (mine[1]["x"] - mine[0]["x"]) == pytest.approx(1, abs=0.02)
    assert density_feed(df, ["g"], "v", limits=(100, 200)).count() == 0
    assert density_feed(df.limit(0), ["g"], "v").count() == 0
    assert density_feed(df, ["g"], "v", points=16, bandwidth=0.5).count() == 32
