"""Log-linear trends with joinpoints, percent changes and plot feeds.

Records never get here: the input is one aggregated series per group (group,
time, rate), so a group has as many rows as there are periods.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.functions.joinpoint import Fit, best_fit, candidate_knots, choose_fit, fit_at, slopes
from ratewright.functions.knot_search import first_guess, least_squares_sums, search_of, series_of, sse_ratio
from ratewright.operators.joins import keyed_join
from ratewright.sources.losses import Losses
from ratewright.sources.tables import union_by_name, written

#: Pairs of places one row of a split knot search tries at most.
SEARCH_PART = 20_000_000


def percent_change(slope: Column) -> Column:
    """Annual percent change of a log-linear slope."""
    return 100 * (F.exp(slope) - 1)


def loglinear_trend(
    series: DataFrame, group: Sequence[str], time: str, value: str, losses: Losses | None = None
) -> DataFrame:
    """Straight-line fit of log(value) on time per group, as plain aggregates; ``losses`` counts points that are not positive."""
    fit = log_points(series, group, time, value, losses).groupBy(*group).agg(
        F.count("*").alias("points"),
        F.regr_slope("_y", "_t").alias("slope"),
        F.regr_intercept("_y", "_t").alias("intercept"),
    )
    return fit.withColumn("apc", percent_change(F.col("slope")))


def one_joinpoint(
    series: DataFrame, group: Sequence[str], time: str, value: str, min_gap: int = 2, losses: Losses | None = None
) -> DataFrame:
    """Best single joinpoint per group, without leaving the JVM.

    Every observed time is a candidate knot. Its sum of squares needs only the
    sums over the points behind it, which are totals minus running sums: one
    sorted window per series, no candidate x point expansion. ``losses`` counts
    points that are not positive.
    """
    whole = Window.partitionBy(*group)
    run = whole.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    t0 = log_points(series, group, time, value, losses).withColumnsRenamed({"_t": "_raw", "_y": "_log"})
    # Centre both axes per series; sums of squares stay small and exact enough.
    pts = t0.withColumns(
        {"_t": F.col("_raw") - F.avg("_raw").over(whole), "_y": F.col("_log") - F.avg("_log").over(whole)}
    )
    terms = {"_n": F.lit(1.0), "_st": F.col("_t"), "_stt": F.col("_t") ** 2, "_sy": F.col("_y"), "_sty": F.col("_t") * F.col("_y")}
    behind = {k: F.sum(v).over(whole) - F.sum(v).over(run) for k, v in terms.items()}
    pts = pts.withColumns(
        {
            **behind,
            "_place": F.sum(F.lit(1)).over(run),
            "_points": F.sum(F.lit(1)).over(whole),
            "_tt": F.sum(terms["_stt"]).over(whole),
            "_ty": F.sum(terms["_sty"]).over(whole),
            "_yy": F.sum(F.col("_y") ** 2).over(whole),
        }
    )
    c, n = F.col("_t"), F.col("_points")
    # Hinge h = max(t - c, 0): its sums from the sums behind the knot.
    h = F.col("_st") - F.col("_n") * c
    hh = F.col("_stt") - 2 * c * F.col("_st") + F.col("_n") * c * c
    th = F.col("_stt") - c * F.col("_st")
    yh = F.col("_sty") - c * F.col("_sy")
    pts = pts.withColumns({"_hh": hh - h * h / n, "_th": th, "_yh": yh, "_h": h})
    det = F.col("_tt") * F.col("_hh") - F.col("_th") ** 2
    pts = pts.filter((F.col("_place") > min_gap) & (F.col("_place") <= n - min_gap) & (det > 0))
    pts = pts.withColumns(
        {
            "_b": (F.col("_ty") * F.col("_hh") - F.col("_yh") * F.col("_th")) / det,
            "_d": (F.col("_yh") * F.col("_tt") - F.col("_ty") * F.col("_th")) / det,
        }
    )
    pts = pts.withColumn("_sse", F.col("_yy") - F.col("_b") * F.col("_ty") - F.col("_d") * F.col("_yh"))
    picked = F.struct("_sse", "_raw", "_b", "_d", "_points")
    best = pts.groupBy(*group).agg(F.min(picked).alias("_best"))
    return best.select(
        *group,
        F.col("_best._points").cast("long").alias("points"),
        F.col("_best._raw").alias("knot"),
        F.col("_best._b").alias("slope_1"),
        (F.col("_best._b") + F.col("_best._d")).alias("slope_2"),
        percent_change(F.col("_best._b")).alias("apc_1"),
        percent_change(F.col("_best._b") + F.col("_best._d")).alias("apc_2"),
        F.col("_best._sse").alias("sse"),
    )


_SEGMENT_FIELDS = [
    T.StructField("points", T.LongType()),
    T.StructField("joinpoints", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("first", T.DoubleType()),
    T.StructField("last", T.DoubleType()),
    T.StructField("knot", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("slope", T.DoubleType()),
    T.StructField("slope_se", T.DoubleType()),
    T.StructField("apc", T.DoubleType()),
    T.StructField("apc_low", T.DoubleType()),
    T.StructField("apc_high", T.DoubleType()),
    T.StructField("aapc", T.DoubleType()),
    T.StructField("aapc_low", T.DoubleType()),
    T.StructField("aapc_high", T.DoubleType()),
    T.StructField("sse", T.DoubleType()),
    T.StructField("bic", T.DoubleType()),
]


def joinpoint_trend(
    series: DataFrame,
    group: Sequence[str],
    time: str,
    value: str,
    max_joinpoints: int = 3,
    min_gap: int = 2,
    confidence: float = 0.95,
    split: bool = False,
    joinpoints: DataFrame | None = None,
    losses: Losses | None = None,
) -> DataFrame:
    """Segments of the BIC-best log-linear trend with up to ``max_joinpoints`` knots per group.

    One row per group and segment: its span, line, annual percent change (APC)
    and the average over all segments (AAPC, slopes weighted by segment length),
    both with normal-theory limits from the covariance of the slopes. Groups are
    fitted in parallel; each task sees only the periods of its group. With
    ``split`` the placements of one group's knots are searched in many tasks,
    for series of hundreds of points or more; the result is the same.
    ``joinpoints`` (the group columns and ``joinpoints``, as
    ``permutation_joinpoints`` gives them) sets the number of knots instead of
    the BIC. Points that are not positive have no logarithm and are left out;
    ``losses`` counts them.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    keys = [series.schema[g] for g in group]
    schema = T.StructType([*keys, *_SEGMENT_FIELDS])
    names = schema.names
    points = log_points(series, group, time, value, losses)
    # Series are small in bytes and heavy in work: a set number of partitions keeps adaptive
    # execution from fitting them all in one task.
    tasks = _tasks(series)

    if not split and joinpoints is None:

        def fit_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_t")
            t, y = rows["_t"].to_numpy(float), rows["_y"].to_numpy(float)
            fits = choose_fit(t, y, max_joinpoints, min_gap) if len(t) > 1 else []
            return pd.DataFrame(_segment_rows(key, t, fits[0], z) if fits else [], columns=names)

        return points.repartition(tasks, *group).groupBy(*group).applyInPandas(fit_group, schema)

    packed = written(packed_series(points, group))
    if joinpoints is not None:
        wanted = joinpoints.select(*group, F.array(F.col("joinpoints").cast("int")).alias("_numbers"))
    else:
        wanted = packed.select(*group, F.sequence(F.lit(0), F.lit(max_joinpoints)).alias("_numbers"))
    placed = keyed_join(packed, best_placements(keyed_join(packed, wanted, group, how="inner"), group, min_gap, tasks), group, how="inner")

    def fit_placements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, t, y, placements in zip(*[batch[g] for g in group], batch["_t"], batch["_y"], batch["_placements"]):
                fits = [fit_at(t, y, tuple(t[np.asarray(p, int)])) for p in placements]
                out += _segment_rows(key, t, min(fits, key=lambda f: (f.bic, len(f.knots))), z)
            yield pd.DataFrame(out, columns=names)

    return placed.repartition(tasks, *group).mapInPandas(fit_placements, schema)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def log_points(series: DataFrame, group: Sequence[str], time: str, value: str, losses: Losses | None = None) -> DataFrame:
    """Group, ``_t`` and ``_y`` (log of the value) of the positive points; ``losses`` counts the others."""
    if losses is not None:
        series = losses.watch(series, "trend", _points_lost(value))
    return series.filter(has_log(value)).select(*group, F.col(time).cast("double").alias("_t"), F.log(F.col(value).cast("double")).alias("_y"))


def has_log(value: str) -> Column:
    """True for positive, finite values."""
    v = F.col(value).cast("double")
    return F.coalesce((v > 0) & (v < float("inf")), F.lit(False))


def _points_lost(value: str) -> dict[str, Column]:
    return {"points": F.count("*"), "no_logarithm": F.count_if(~has_log(value))}


def packed_series(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per series of two points or more: its times and logs as arrays in time order."""
    together = F.sort_array(F.collect_list(F.struct("_t", "_y")))
    packed = points.groupBy(*group).agg(together.alias("_points")).filter(F.size("_points") > 1)
    return packed.select(*group, F.col("_points._t").alias("_t"), F.col("_points._y").alias("_y"))


def _segment_rows(key: Sequence, t: np.ndarray, best: Fit, z: float) -> list[tuple]:
    """One row per segment of a fitted series."""
    ends = [t[0], *best.knots, t[-1]]
    slope, cov = slopes(best)
    weight = np.diff(ends) / (t[-1] - t[0])
    mean, spread = float(weight @ slope), math.sqrt(max(float(weight @ cov @ weight), 0.0))
    aapc = [100 * math.expm1(mean + s * z * spread) for s in (0, -1, 1)]
    out, level = [], float(best.coef[0])
    for j, b in enumerate(slope):
        if j:
            level -= float(best.coef[j + 1]) * best.knots[j - 1]
        se = math.sqrt(max(float(cov[j, j]), 0.0))
        apc = [100 * math.expm1(float(b) + s * z * se) for s in (0, -1, 1)]
        knot = best.knots[j - 1] if j else None
        out.append(
            (*key, len(t), len(best.knots), j + 1, ends[j], ends[j + 1], knot, level, float(b), se, *apc, *aapc, best.sse, best.bic)
        )
    return out


def best_placements(series: DataFrame, group: Sequence[str], min_gap: int, tasks: int, part: int = SEARCH_PART) -> DataFrame:
    """Group and ``_placements``: the best places of each number of knots in ``_numbers``, searched in many tasks.

    A first pass per series finds a good placement and the least sums of
    squares of separate lines behind each point, and sends them along with the
    places worth trying as first knot, ``part`` pairs of places to a row. Numbers
    of knots for which the series is too short are left out.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*group).schema)
    carried = f"{keys}, _k int, _part int, _t array<double>, _y array<double>, _behind array<double>, _first array<int>, _upper double, _known array<int>"

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, t, y, numbers in zip(*[batch[g] for g in group], batch["_t"], batch["_y"], batch["_numbers"]):
                rows = []
                for k in numbers:
                    if k == 0:
                        rows.append((*key, 0, 0, t, y, [], [], 0.0, []))
                        continue
                    places = candidate_knots(t, min_gap)
                    if len(t) < k + 3 or len(places) < k:
                        continue
                    search = search_of(t, y, k, min_gap)
                    upper, known = first_guess(search)
                    if not known:
                        continue
                    first = places[search.worth((), places, upper)]
                    each = max(1, part // max(1, len(places) ** min(2, k - 1)))
                    n_parts = max(1, -(-len(first) // each))
                    behind = search.behind.ravel()
                    rows += [(*key, k, i, t, y, behind, first[i::n_parts], upper, list(known)) for i in range(n_parts)]
                yield pd.DataFrame(rows, columns=[*group, "_k", "_part", "_t", "_y", "_behind", "_first", "_upper", "_known"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, k, t, y, behind, first, upper, known in zip(
                *[batch[g] for g in group], *[batch[c] for c in ("_k", "_t", "_y", "_behind", "_first", "_upper", "_known")]
            ):
                if k:
                    search = search_of(t, y, k, min_gap, np.asarray(behind).reshape(k + 1, -1))
                    upper, known = search.best([(int(p),) for p in first], upper, tuple(int(p) for p in known))
                rows.append((*key, k, upper, list(known)))
            yield pd.DataFrame(rows, columns=[*group, "_k", "_sse", "_knots"])

    parts = written(series.repartition(tasks, *group).mapInPandas(prepare, carried))
    found = parts.repartition(tasks, *group, "_k", "_part").mapInPandas(look, f"{keys}, _k int, _sse double, _knots array<int>")
    best = found.groupBy(*group, "_k").agg(F.min(F.struct("_sse", "_knots")).alias("_best"))
    return best.groupBy(*group).agg(F.collect_list("_best._knots").alias("_placements"))


def hash_order(n: int, seed: str) -> np.ndarray:
    """Places 1 to n in the order of the md5 of ``seed:place``, counted from 0."""
    return np.argsort([hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(1, n + 1)])


def permutation_joinpoints(
    series: DataFrame,
    group: Sequence[str],
    time: str,
    value: str,
    max_joinpoints: int = 3,
    min_gap: int = 2,
    permutations: int = 999,
    level: float = 0.05,
    seed: int = 1,
    part: int = 100,
    trace: bool = False,
) -> DataFrame:
    """Number of joinpoints per group by sequential permutation tests (Kim et al. 2000), beside the choice by BIC.

    Starting from none against ``max_joinpoints``, the smaller number is tested
    against the larger one: the residuals of the smaller model are permuted and
    both models fitted again, and the p-value is the share of permutations
    (the observed order among them) whose ratio of sums of squares is as large
    as the observed one. A rejection (p at most ``level / max_joinpoints``)
    raises the smaller number by one, else the larger falls by one, until they
    meet. Permutations are rows, ``part`` to a row, and each is drawn from a
    seed of its own, so the result does not depend on the partitioning. A group
    too short for a number of knots starts below it.

    Columns: the group, ``joinpoints``, and ``p_value`` of the last test (NULL
    without any). With ``trace`` all tests: group, ``step``, ``smaller``,
    ``larger``, ``p_value``, ``rejected``.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*group).schema)
    packed = written(packed_series(log_points(series, group, time, value), group))
    tasks = _tasks(series)

    def count_larger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, t, y, smaller, larger, part_no in zip(
                *[batch[g] for g in group], *[batch[c] for c in ("_t", "_y", "_smaller", "_larger", "_part")]
            ):
                t, y = np.asarray(t, float), np.asarray(y, float)
                null = best_fit(t, y, smaller, min_gap)
                fitted = null.at(t)
                numbers = range(1 + part_no * part, 1 + min(permutations, (part_no + 1) * part))
                drawn = [hash_order(len(t), f"{seed}:{i}") for i in numbers]
                responses = series_of(t, np.column_stack([y, *[fitted + (y - fitted)[p] for p in drawn]]))
                ratio = sse_ratio(*[least_squares_sums(responses, k, min_gap) for k in (smaller, larger)])
                rows.append((*key, smaller, larger, int((ratio[1:] >= ratio[0] * (1 - 1e-9)).sum())))
            yield pd.DataFrame(rows, columns=[*group, "_smaller", "_larger", "_more"])

    size = F.size("_t")
    # k knots need k + 3 points, and k places ``min_gap`` apart that leave as many points before and after.
    longest = F.least(F.lit(max_joinpoints), size - 3, F.floor((size - 2 * min_gap - 1) / min_gap).cast("int") + 1)
    state = packed.select(*group, F.lit(0).alias("_smaller"), F.greatest(longest, F.lit(0)).alias("_larger"), F.lit(None).cast("double").alias("p_value"))
    tests = []
    for step in range(1, max_joinpoints + 1):
        state = written(state)
        asked = keyed_join(packed, state.filter(F.col("_smaller") < F.col("_larger")), group, how="inner")
        parts = F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // part)))
        dealt = asked.withColumn("_part", parts).repartition(tasks, *group, "_part")
        counts = dealt.mapInPandas(count_larger, f"{keys}, _smaller int, _larger int, _more long")
        p_value = (F.sum("_more") + 1) / (permutations + 1)
        found = written(counts.groupBy(*group, "_smaller", "_larger").agg(p_value.alias("_p")).withColumn("_rejected", F.col("_p") <= level / max_joinpoints))
        tests.append(found.select(*group, F.lit(step).alias("step"), F.col("_smaller").alias("smaller"), F.col("_larger").alias("larger"), F.col("_p").alias("p_value"), F.col("_rejected").alias("rejected")))
        moved = keyed_join(state, found.select(*group, "_p", "_rejected"), group)
        state = moved.select(
            *group,
            F.when(F.col("_rejected"), F.col("_smaller") + 1).otherwise(F.col("_smaller")).alias("_smaller"),
            F.when(~F.col("_rejected"), F.col("_larger") - 1).otherwise(F.col("_larger")).alias("_larger"),
            F.coalesce("_p", "p_value").alias("p_value"),
        )
    if trace:
        return union_by_name(tests)
    return state.select(*group, F.col("_smaller").alias("joinpoints"), "p_value")


def average_change(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    """AAPC with limits, one row per group."""
    return segments.filter(F.col("segment") == 1).select(
        *group, "joinpoints", "first", F.col("aapc"), "aapc_low", "aapc_high"
    )


def trend_summary(segments: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Trend table: one row per segment with its period, APC and AAPC, label columns first."""
    period = F.format_string("%d-%d", F.round("first").cast("int"), F.round("last").cast("int"))
    return segments.select(
        *[c.alias(n) for n, c in labels.items()],
        "segment",
        period.alias("period"),
        *[F.round(c, 2).alias(c) for c in ("apc", "apc_low", "apc_high", "aapc", "aapc_low", "aapc_high")],
    )


def trend_points(
    series: DataFrame, segments: DataFrame, group: Sequence[str], time: str, value: str, losses: Losses | None = None
) -> DataFrame:
    """Observed and fitted log values per point, with the knot that opens its segment; ``losses`` counts points that are not positive.

    Points join the segment that holds their time, so each point meets the few
    segments of its own group; a point on a knot belongs to the later segment.
    """
    lines = segments.select(*group, "segment", "joinpoints", "first", "last", "knot", "intercept", "slope")
    kept = series.withColumn("_time", F.col(time))
    if losses is not None:
        kept = losses.watch(kept, "trend points", _points_lost(value))
    points = kept.filter(has_log(value)).select(*group, F.col("_time").alias("time"), F.log(F.col(value)).alias("obs"))
    t = F.col("time").cast("double")
    closed = F.col("segment") == F.col("joinpoints") + 1
    inside = (t >= F.col("first")) & ((t < F.col("last")) | (closed & (t <= F.col("last"))))
    return keyed_join(points, lines, group, residual=inside).select(
        *group,
        "time",
        "obs",
        (F.col("intercept") + F.col("slope") * t).alias("fit"),
        F.round("knot").alias("joinpoint"),
    )


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 100_000,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact interpolated quantiles per group (columns ``q_0``, ``q_1``, ...).

    A sketch brackets each order statistic; the rows under the bracket are only
    counted and the few inside it ranked, so no group is sorted or held whole.
    Up to ``accuracy`` values per group the bracket is open at both ends. A
    quantile outside its bracket is an error.
    ``also`` are further aggregates of ``_v`` (the value) from the same pass.
    """
    slack = 4.0 / accuracy
    v = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    around = [edge for p in probs for edge in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", around, accuracy).alias("_around"), *also
    )
    extra = [c for c in sketch.columns if c not in (*by, "_n", "_around")]
    narrow = F.col("_n") > accuracy
    brackets = written(
        sketch.select(
            *by,
            *extra,
            *[F.when(narrow, F.col("_around")[2 * i]).alias(f"_lo{i}") for i in range(len(probs))],
            *[F.when(narrow, F.col("_around")[2 * i + 1]).alias(f"_hi{i}") for i in range(len(probs))],
        )
    )
    marked = keyed_join(rows, brackets.drop(*extra), by, how="inner")
    inside = F.lit(False)
    for i in range(len(probs)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        inside = inside | F.coalesce((F.col("_v") >= lo) & (F.col("_v") <= hi), F.lit(True))
    # Rows outside every bracket collapse to one marker per gap between brackets.
    gap = sum((F.when(F.col("_v") > F.col(f"_hi{i}"), 1).otherwise(0) for i in range(len(probs))), F.lit(0))
    keyed = marked.withColumn("_kept", F.when(inside, F.col("_v"))).withColumn("_gap", F.when(~inside, gap))
    counts = keyed.groupBy(*by, "_kept", "_gap").agg(F.count("*").alias("_c"), F.max("_v").alias("_v"))
    run = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_c").over(run)).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    row = F.struct("_v", F.col("_gap").isNotNull().alias("missed"))
    picks, values = [], []
    missed = F.raise_error(F.lit("the sketch missed a quantile; ask for more accuracy")).cast("double")
    for i, p in enumerate(probs):
        place = (F.col("_all") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_upto") >= F.floor(place) + 1, row)).alias(f"_lower{i}"),
            F.min(F.when(F.col("_upto") >= F.ceil(place) + 1, row)).alias(f"_upper{i}"),
            F.max(place - F.floor(place)).alias(f"_rest{i}"),
        ]
        low, high = F.col(f"_lower{i}"), F.col(f"_upper{i}")
        line = low["_v"] + (high["_v"] - low["_v"]) * F.col(f"_rest{i}")
        values.append(F.when(low["missed"] | high["missed"], missed).otherwise(line).alias(f"q_{i}"))
    found = ranked.groupBy(*by).agg(*picks, F.max("_all").alias("points"))
    quantiles = found.select(*by, *values, "points")
    return keyed_join(quantiles, brackets.select(*by, *extra), by) if extra else quantiles


def joint_bandwidth(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row: mean over groups of Silverman's rule of thumb, with the range of the values."""
    shape = (F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    quartiles = group_quantiles(df, by, value, (0.25, 0.75), also=shape)
    iqr = (F.col("q_1") - F.col("q_0")) / 1.34
    scale = F.when((F.col("_sd") > 0) & (iqr > 0), F.least("_sd", iqr)).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    rule = 0.9 * scale * F.pow(F.col("points").cast("double"), F.lit(-0.2))
    return quartiles.agg(
        F.avg(rule).alias("bandwidth"), F.min("_min").alias("low"), F.max("_max").alias("high")
    )


def density_feed(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: int = 512,
    limits: tuple[float, float] | None = None,
    bandwidth: float | None = None,
    cut: float = 3.0,
) -> DataFrame:
    """Gaussian kernel density of a value per group on a common grid, for ridge plots.

    Values are binned linearly onto the grid (the weight of a value is shared by
    its two neighbours), which reduces any number of rows to ``points`` per
    group in one map-side combined aggregation; only the bins are smoothed. The
    grid runs ``cut`` bandwidths past the range of the values; without any value
    inside the limits the feed is empty. No number passes the driver.
    """
    if limits is not None:
        df = df.filter(F.col(value).between(*limits))
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if bandwidth is None:
        scale = joint_bandwidth(df, by, value)
    else:
        scale = df.agg(F.lit(float(bandwidth)).alias("bandwidth"), F.min(value).alias("low"), F.max(value).alias("high"))
    # The grid is one small row that every part of the plan asks for as a scalar subquery.
    low, high = F.col("low").cast("double") - cut * F.col("bandwidth"), F.col("high").cast("double") + cut * F.col("bandwidth")
    grid = written(scale.select("bandwidth", low.alias("low"), ((high - low) / (points - 1)).alias("step")))
    bandwidth, low, step = (grid.select(c).scalar() for c in ("bandwidth", "low", "step"))
    place = (F.col(value) - low) / step
    bins = df.groupBy(*by, F.floor(place).cast("int").alias("_bin")).agg(
        F.sum(F.floor(place) + 1 - place).alias("_left"), F.sum(place - F.floor(place)).alias("_right")
    )
    pair = F.array(
        F.struct(F.col("_bin").alias("bin"), F.col("_left").alias("w")),
        F.struct((F.col("_bin") + 1).alias("bin"), F.col("_right").alias("w")),
    )
    spread = bins.select(*by, F.explode(pair).alias("_p")).select(*by, F.col("_p.bin").alias("_bin"), F.col("_p.w").alias("_w"))
    whole = Window.partitionBy(*by)
    weights = spread.groupBy(*by, "_bin").agg(F.sum("_w").alias("_w"))
    weights = weights.withColumn("_share", F.col("_w") / F.sum("_w").over(whole))
    reach = F.least(F.lit(points), F.ceil(8 * bandwidth / step).cast("int"))
    offsets = F.explode(F.sequence(-reach, reach))
    z = F.col("_offset") * (step / bandwidth)
    kernel = F.exp(-0.5 * z * z) / (bandwidth * math.sqrt(2 * math.pi))
    smooth = weights.select(*by, "_bin", "_share", offsets.alias("_offset"))
    smooth = smooth.select(
        *by, (F.col("_bin") + F.col("_offset")).alias("point"), (F.col("_share") * kernel).alias("_part")
    ).filter(F.col("point").between(0, points - 1))
    # Points out of reach of every bin are part of the feed, with zero.
    empty = weights.select(*by).distinct().select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("_part")
    )
    feed = smooth.unionByName(empty).groupBy(*by, "point").agg(F.sum("_part").alias("density"))
    return feed.select(*by, "point", (low + F.col("point") * step).alias("x"), "density")
