"""Standardised rates, trends, density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import r6, rounded, table
from ratewright.operators.columns import unite
from ratewright.operators.frequency import count_by, weighted_count
from ratewright.operators.rates import rate_cells, standardised_rate
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

RATE_COLUMNS = ("value", "lowercl", "uppercl")


def orders_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """All orders with their year."""
    return table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))


def orders_by_customer_group(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Orders per year, priority and the customer's ``keys``.

    Orders are counted per customer before the join, so a customer that holds
    much of the table is a few rows in the shuffle.
    """
    per_customer = count_by(orders_by_year(spark, sf), "o_custkey", "year", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", *keys)
    return (
        per_customer.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("year", "o_orderpriority", *keys)
        .agg(F.sum("n").alias("n"))
    )


def standard(population: DataFrame) -> DataFrame:
    """Standard weight per segment."""
    return population.select("c_mktsegment").distinct().withColumn("weight", F.length("c_mktsegment") * 100)


def customers(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Customers per key, written: the denominators and the list of segments."""
    return written(count_by(table(spark, sf, "customer"), *keys, name="pop"))


def dsr_by_year(spark: SparkSession, sf: str) -> DataFrame:
    cells = orders_by_customer_group(spark, sf, "c_mktsegment")
    population = customers(spark, sf, "c_mktsegment")
    joined = rate_cells(cells, population, standard(population), ["c_mktsegment"], ["c_mktsegment"])
    return rounded(standardised_rate(joined, ["year", "o_orderpriority"]), *RATE_COLUMNS)


# z is the normal quantile of 0.975.
DSR_SQL = """
SELECT {keys}, CAST(o AS BIGINT) AS total_count, CAST(p AS BIGINT) AS total_pop,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * wr / w, 6) END AS value,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * (wr / w + sqrt(wv / (w * w) / o) * (o * pow(1 - 1 / (9 * o) - 1.959963984540054 / (3 * sqrt(o)), 3) - o)), 6) END AS lowercl,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * (wr / w + sqrt(wv / (w * w) / o) * ((o + 1) * pow(1 - 1 / (9 * (o + 1)) + 1.959963984540054 / (3 * sqrt(o + 1)), 3) - o)), 6) END AS uppercl
FROM (SELECT {keys}, CAST(sum(n) AS DOUBLE) AS o, sum(pop) AS p, CAST(sum(weight) AS DOUBLE) AS w, sum(weight * n / CAST(pop AS DOUBLE)) AS wr,
  sum(CAST(weight AS DOUBLE) * weight * n / pop / pop) AS wv, bool_or(pop IS NULL) AS gap FROM joined GROUP BY {keys})
"""
DSR_BY_YEAR = """
WITH pop AS (SELECT c_mktsegment, count(*) AS pop, length(c_mktsegment) * 100 AS weight FROM customer GROUP BY 1),
joined AS (SELECT year(o_orderdate) AS year, o_orderpriority, c_mktsegment, count(*) AS n, any_value(pop) AS pop, any_value(weight) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN pop USING (c_mktsegment) GROUP BY 1, 2, 3)
""" + DSR_SQL.format(keys="year, o_orderpriority", least=10)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    )


def dsr_by_region_year(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by region, with region and priority united into one series key beside them."""
    nations = regions(spark, sf)
    keys = ["year", "o_orderpriority", "r_name", "c_mktsegment"]
    cells = weighted_count(
        orders_by_customer_group(spark, sf, "c_nationkey", "c_mktsegment").join(nations, "c_nationkey"), keys, "n"
    )
    per_nation = customers(spark, sf, "c_nationkey", "c_mktsegment")
    population = weighted_count(per_nation.join(nations, "c_nationkey"), ["r_name", "c_mktsegment"], "pop", "pop")
    joined = rate_cells(cells, population, standard(per_nation), ["r_name", "c_mktsegment"], ["c_mktsegment"])
    rates = standardised_rate(joined, ["year", "r_name", "o_orderpriority"])
    return rounded(unite(rates, ["r_name", "o_orderpriority"], "series"), *RATE_COLUMNS)


DSR_BY_REGION_YEAR = """
WITH c AS (SELECT c_custkey, c_mktsegment, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pop AS (SELECT r_name, c_mktsegment, count(*) AS pop, length(c_mktsegment) * 100 AS weight FROM c GROUP BY ALL),
joined AS (SELECT year(o_orderdate) AS year, r_name, o_orderpriority, c_mktsegment, r_name || '_' || o_orderpriority AS series, count(*) AS n, any_value(pop) AS pop, any_value(weight) AS weight
  FROM orders JOIN c ON o_custkey = c_custkey JOIN pop USING (r_name, c_mktsegment) GROUP BY 1, 2, 3, 4)
""" + DSR_SQL.format(keys="year, r_name, o_orderpriority, series", least=10)


def dsr_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by nation, cells without orders counted as zero, no suppression of small counts."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cells = orders_by_customer_group(spark, sf, "c_nationkey", "c_mktsegment")
    population = customers(spark, sf, "c_nationkey", "c_mktsegment")
    joined = rate_cells(
        cells, population, standard(population), ["c_nationkey", "c_mktsegment"], ["c_mktsegment"], {"c_mktsegment": segments}
    )
    return rounded(standardised_rate(joined, ["year", "c_nationkey", "o_orderpriority"], min_events=1), *RATE_COLUMNS)


DSR_ZERO_FILLED = """
WITH pop AS (SELECT c_nationkey, c_mktsegment, count(*) AS pop, length(c_mktsegment) * 100 AS weight FROM customer GROUP BY ALL),
cells AS (SELECT year(o_orderdate) AS year, c_nationkey, o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
joined AS (SELECT g.*, coalesce(n, 0) AS n, pop, weight FROM (SELECT * FROM (SELECT DISTINCT year, c_nationkey, o_orderpriority FROM cells), (SELECT DISTINCT c_mktsegment FROM customer)) g
  LEFT JOIN cells USING (year, c_nationkey, o_orderpriority, c_mktsegment) LEFT JOIN pop USING (c_nationkey, c_mktsegment))
""" + DSR_SQL.format(keys="year, c_nationkey, o_orderpriority", least=1)


def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per priority and quarter."""
    o = orders_by_year(spark, sf)
    t = F.year("o_orderdate") + (F.quarter("o_orderdate") - 1) / 4
    return count_by(o, "o_orderpriority", t.alias("t"))


QUARTERLY = """s AS (SELECT o_orderpriority AS g, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4 AS t, ln(count(*)) AS y
  FROM orders GROUP BY 1, 2)"""


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly orders under an index whose growth changes twice, by an amount that differs per priority."""
    t, level = F.col("t"), F.substring("o_orderpriority", 1, 1).cast("double") - 1
    growth = 0.1 * level * F.greatest(t - 1996.5, F.lit(0.0)) - 0.25 * F.greatest(t - 1998.75, F.lit(0.0))
    return quarterly(spark, sf).withColumn("n", F.col("n") * F.exp(growth))


INDEXED = """s AS (SELECT g, t, y + 0.1 * (CAST(left(g, 1) AS DOUBLE) - 1) * greatest(t - 1996.5, 0) - 0.25 * greatest(t - 1998.75, 0) AS y
  FROM (SELECT o_orderpriority AS g, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4 AS t, ln(count(*)) AS y
    FROM orders GROUP BY 1, 2))"""


def trend_loglinear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(loglinear_trend(quarterly(spark, sf), ["o_orderpriority"], "t", "n"), "slope", "intercept", "apc")


TREND_LOGLINEAR = f"""
WITH {QUARTERLY}
SELECT g AS o_orderpriority, count(*) AS points, round(regr_slope(y, t), 6) AS slope, round(regr_intercept(y, t), 6) AS intercept,
  round(100 * (exp(regr_slope(y, t)) - 1), 6) AS apc FROM s GROUP BY g
"""


def trend_joinpoint_k1(spark: SparkSession, sf: str) -> DataFrame:
    best = one_joinpoint(indexed(spark, sf), ["o_orderpriority"], "t", "n")
    return rounded(best, "knot", "slope_1", "slope_2", "apc_1", "apc_2", "sse")


TREND_JOINPOINT_K1 = f"""
WITH {INDEXED},
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS i, count(*) OVER (PARTITION BY g) AS m FROM s),
x AS (SELECT a.g, a.t AS c, b.t, b.y, greatest(b.t - a.t, 0) AS h, a.m FROM n a JOIN n b USING (g) WHERE a.i > 2 AND a.i <= a.m - 2),
q AS (SELECT g, c, any_value(m) AS m, var_pop(t) AS s11, var_pop(h) AS s22, covar_pop(t, h) AS s12, covar_pop(t, y) AS s1y, covar_pop(h, y) AS s2y, var_pop(y) AS yy FROM x GROUP BY g, c),
f AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS d FROM q),
e AS (SELECT *, m * (yy - b * s1y - d * s2y) AS sse FROM f)
SELECT g AS o_orderpriority, arg_min(m, sse) AS points, round(arg_min(c, sse), 6) AS knot, round(arg_min(b, sse), 6) AS slope_1, round(arg_min(b + d, sse), 6) AS slope_2,
  round(100 * (exp(arg_min(b, sse)) - 1), 6) AS apc_1, round(100 * (exp(arg_min(b + d, sse)) - 1), 6) AS apc_2, round(min(sse), 6) AS sse FROM e GROUP BY g
"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return joinpoint_trend(indexed(spark, sf), ["o_orderpriority"], "t", "n", 3)


def trend_joinpoint_k3(spark: SparkSession, sf: str) -> DataFrame:
    fitted = segments(spark, sf).select(
        "o_orderpriority", "points", "joinpoints", "segment", "first", "last", "knot", "slope", "apc", "sse", "bic"
    )
    return rounded(fitted, "first", "last", "knot", "slope", "apc", "sse", "bic")


# Brute force: every placement of 0 to 3 knots, the regressors taken out of y one
# after the other (each first freed of the earlier ones), sums of squares compared.
_PLACEMENTS = """
WITH {series},
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS i, count(*) OVER (PARTITION BY g) AS m FROM s),
k AS (SELECT g, i, t FROM n WHERE i > 2 AND i <= m - 2),
place AS (SELECT DISTINCT g, 0 AS j, NULL AS c1, NULL AS c2, NULL AS c3 FROM n
  UNION ALL SELECT g, 1, t, NULL, NULL FROM k
  UNION ALL SELECT a.g, 2, a.t, b.t, NULL FROM k a JOIN k b ON a.g = b.g AND b.i >= a.i + 2
  UNION ALL SELECT a.g, 3, a.t, b.t, c.t FROM k a JOIN k b ON a.g = b.g AND b.i >= a.i + 2 JOIN k c ON c.g = b.g AND c.i >= b.i + 2),
x0 AS (SELECT p.*, n.t, n.m, n.y - avg(n.y) OVER w AS y, n.t - avg(n.t) OVER w AS a,
    coalesce(greatest(n.t - c1, 0), 0) AS b, coalesce(greatest(n.t - c2, 0), 0) AS c, coalesce(greatest(n.t - c3, 0), 0) AS d
  FROM place p JOIN n USING (g) WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
z0 AS (SELECT * REPLACE (b - avg(b) OVER w AS b, c - avg(c) OVER w AS c, d - avg(d) OVER w AS d) FROM x0 WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
x1 AS (SELECT * REPLACE (y - a * sum(a * y) OVER w / sum(a * a) OVER w AS y, b - a * sum(a * b) OVER w / sum(a * a) OVER w AS b,
    c - a * sum(a * c) OVER w / sum(a * a) OVER w AS c, d - a * sum(a * d) OVER w / sum(a * a) OVER w AS d) FROM z0 WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
x2 AS (SELECT * REPLACE (CASE WHEN j >= 1 THEN y - b * sum(b * y) OVER w / sum(b * b) OVER w ELSE y END AS y,
    CASE WHEN j >= 1 THEN c - b * sum(b * c) OVER w / sum(b * b) OVER w ELSE c END AS c, CASE WHEN j >= 1 THEN d - b * sum(b * d) OVER w / sum(b * b) OVER w ELSE d END AS d)
  FROM x1 WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
x3 AS (SELECT * REPLACE (CASE WHEN j >= 2 THEN y - c * sum(c * y) OVER w / sum(c * c) OVER w ELSE y END AS y,
    CASE WHEN j >= 2 THEN d - c * sum(c * d) OVER w / sum(c * c) OVER w ELSE d END AS d) FROM x2 WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
x4 AS (SELECT * REPLACE (CASE WHEN j >= 3 THEN y - d * sum(d * y) OVER w / sum(d * d) OVER w ELSE y END AS y) FROM x3 WINDOW w AS (PARTITION BY g, j, c1, c2, c3)),
fits AS (SELECT g, j, c1, c2, c3, any_value(m) AS m, sum(y * y) AS sse FROM x4 GROUP BY g, j, c1, c2, c3),
scored AS (SELECT *, ln(greatest(sse, 1e-300) / m) + 2 * (j + 1) * ln(m) / m AS bic FROM fits),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY g ORDER BY bic) = 1),
fitted AS (SELECT x.g, x.t, n.y - x.y AS fit FROM x4 x JOIN best b ON x.g = b.g AND x.j = b.j AND x.c1 IS NOT DISTINCT FROM b.c1
  AND x.c2 IS NOT DISTINCT FROM b.c2 AND x.c3 IS NOT DISTINCT FROM b.c3 JOIN n ON n.g = x.g AND n.t = x.t),
ends AS (SELECT g, min(t) AS t FROM n GROUP BY g UNION ALL SELECT g, max(t) FROM n GROUP BY g
  UNION ALL SELECT g, c1 FROM best WHERE j >= 1 UNION ALL SELECT g, c2 FROM best WHERE j >= 2 UNION ALL SELECT g, c3 FROM best WHERE j >= 3),
cut AS (SELECT e.g, e.t AS first, f.fit AS f0, lead(e.t) OVER w AS last, lead(f.fit) OVER w AS f1, row_number() OVER w AS segment
  FROM ends e JOIN fitted f ON e.g = f.g AND e.t = f.t WINDOW w AS (PARTITION BY e.g ORDER BY e.t)),
seg AS (SELECT cut.*, (f1 - f0) / (last - first) AS slope, b.j, b.m, b.sse, b.bic FROM cut JOIN best b USING (g) WHERE last IS NOT NULL)
"""


def placements_sql(series: str) -> str:
    """The CTEs above over a CTE ``s`` with g, t and y."""
    return _PLACEMENTS.format(series=series)


# The regressors that were freed of each other are orthogonal, so the variance of the difference of two fitted
# values is the residual variance times the sum of their squared differences over their squared lengths.
_LIMITS = """,
q AS (SELECT x.g, x.t, x.a AS q1, CASE WHEN k.j >= 1 THEN x.b ELSE 0 END AS q2, CASE WHEN k.j >= 2 THEN x.c ELSE 0 END AS q3, CASE WHEN k.j >= 3 THEN x.d ELSE 0 END AS q4
  FROM x4 x JOIN best k ON x.g = k.g AND x.j = k.j AND x.c1 IS NOT DISTINCT FROM k.c1 AND x.c2 IS NOT DISTINCT FROM k.c2 AND x.c3 IS NOT DISTINCT FROM k.c3),
size AS (SELECT g, sum(q1 * q1) AS n1, nullif(sum(q2 * q2), 0) AS n2, nullif(sum(q3 * q3), 0) AS n3, nullif(sum(q4 * q4), 0) AS n4 FROM q GROUP BY g),
span AS (SELECT g, first, last, j, m, sse, segment, slope FROM seg
  UNION ALL SELECT g, min(first), max(last), any_value(j), any_value(m), any_value(sse), 0, sum(slope * (last - first)) / sum(last - first) FROM seg GROUP BY g),
err AS (SELECT span.*, sqrt(sse / (m - j - 2) * (pow(e.q1 - s.q1, 2) / n1 + coalesce(pow(e.q2 - s.q2, 2) / n2, 0) + coalesce(pow(e.q3 - s.q3, 2) / n3, 0) + coalesce(pow(e.q4 - s.q4, 2) / n4, 0))) / (last - first) AS se
  FROM span JOIN size USING (g) JOIN q s ON s.g = span.g AND s.t = first JOIN q e ON e.g = span.g AND e.t = last),
pct AS (SELECT *, 100 * (exp(slope) - 1) AS change, 100 * (exp(slope - 1.959963984540054 * se) - 1) AS low, 100 * (exp(slope + 1.959963984540054 * se) - 1) AS high FROM err)
"""


def limits_sql(series: str) -> str:
    """``placements_sql`` and, in ``pct``, the change per segment (0: the average) with its limits."""
    return placements_sql(series) + _LIMITS


TREND_JOINPOINT_K3 = (
    placements_sql(INDEXED)
    + """
SELECT g AS o_orderpriority, m AS points, CAST(j AS INTEGER) AS joinpoints, CAST(segment AS INTEGER) AS segment, round(first, 6) AS first, round(last, 6) AS last,
  CASE WHEN segment > 1 THEN round(first, 6) END AS knot, round(slope, 6) AS slope, round(100 * (exp(slope) - 1), 6) AS apc, round(sse, 6) AS sse, round(bic, 6) AS bic FROM seg
"""
)


def trend_aapc(spark: SparkSession, sf: str) -> DataFrame:
    average = average_change(segments(spark, sf), ["o_orderpriority"])
    return rounded(average.select("o_orderpriority", "joinpoints", "aapc", "aapc_low", "aapc_high"), "aapc", "aapc_low", "aapc_high")


TREND_AAPC = (
    limits_sql(INDEXED)
    + """
SELECT g AS o_orderpriority, CAST(j AS INTEGER) AS joinpoints, round(change, 6) AS aapc, round(low, 6) AS aapc_low, round(high, 6) AS aapc_high FROM pct WHERE segment = 0
"""
)


def trend_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Trend table with APC and AAPC limits."""
    return trend_summary(segments(spark, sf), {"priority": F.col("o_orderpriority")})


TREND_SUMMARY = (
    limits_sql(INDEXED)
    + """
SELECT p.g AS priority, CAST(p.segment AS INTEGER) AS segment, printf('%d-%d', CAST(round(p.first) AS INTEGER), CAST(round(p.last) AS INTEGER)) AS period,
  round(p.change, 2) AS apc, round(p.low, 2) AS apc_low, round(p.high, 2) AS apc_high, round(a.change, 2) AS aapc, round(a.low, 2) AS aapc_low, round(a.high, 2) AS aapc_high
FROM pct p JOIN pct a ON a.g = p.g AND a.segment = 0 WHERE p.segment > 0
"""
)


def trend_fitted(spark: SparkSession, sf: str) -> DataFrame:
    q = indexed(spark, sf)
    points = trend_points(q, joinpoint_trend(q, ["o_orderpriority"], "t", "n", 3), ["o_orderpriority"], "t", "n")
    return rounded(points, "time", "obs", "fit")


TREND_FITTED = (
    placements_sql(INDEXED)
    + """
SELECT f.g AS o_orderpriority, round(f.t, 6) AS time, round(n.y, 6) AS obs, round(f.fit, 6) AS fit,
  (SELECT CASE WHEN max(segment) > 1 THEN round(max(first)) END FROM cut c WHERE c.g = f.g AND c.last IS NOT NULL AND c.first <= f.t) AS joinpoint
FROM fitted f JOIN n ON n.g = f.g AND n.t = f.t
"""
)


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per priority and week under an index whose growth changes twice; every 40th week is empty."""
    orders = table(spark, sf, "orders")
    week = F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 7).cast("long")
    t, level = F.col("week"), F.substring("o_orderpriority", 1, 1).cast("double")
    growth = 0.01 * level * F.greatest(t - 120, F.lit(0)) - 0.05 * F.greatest(t - 230, F.lit(0))
    n = F.when(t % 40 != 7, F.col("n") * F.exp(growth)).otherwise(0.0)
    return count_by(orders, "o_orderpriority", week.alias("week")).withColumn("n", n)


def trend_joinpoint_long(spark: SparkSession, sf: str) -> DataFrame:
    """Joinpoints of weekly series, their placements searched in parts."""
    fitted = joinpoint_trend(weekly(spark, sf), ["o_orderpriority"], "week", "n", 2, split=True)
    found = fitted.select("o_orderpriority", "points", "joinpoints", "segment", "first", "last", "sse", "bic")
    return rounded(found, "sse", "bic")


# All placements of up to two knots; the sums over the points behind a knot give each its sum of squares in closed form.
TREND_JOINPOINT_LONG = """
WITH w AS (SELECT o_orderpriority AS g, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7) AS BIGINT) AS t, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT g, t, ln(n * exp(0.01 * CAST(left(g, 1) AS DOUBLE) * greatest(t - 120, 0) - 0.05 * greatest(t - 230, 0))) AS y FROM w WHERE t % 40 <> 7),
c AS (SELECT g, t AS week, CAST(t AS DOUBLE) / 340 - 0.5 AS t, y - avg(y) OVER (PARTITION BY g) AS y, row_number() OVER (PARTITION BY g ORDER BY t) AS i, count(*) OVER (PARTITION BY g) AS m FROM p),
r AS (SELECT g, week, t, i, m, count(*) OVER b AS n0, sum(t) OVER b AS s1, sum(t * t) OVER b AS s2, sum(y) OVER b AS sy, sum(t * y) OVER b AS sty FROM c
  WINDOW b AS (PARTITION BY g ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
a AS (SELECT g, count(*) AS m, sum(t) AS t, sum(t * t) - sum(t) * sum(t) / count(*) AS tt, sum(t * y) AS ty, sum(y * y) AS yy FROM c GROUP BY g),
h AS (SELECT r.g, r.week, r.t AS c, i, n0, s1, s2, s1 - r.t * n0 AS h1, s2 - r.t * s1 - a.t * (s1 - r.t * n0) / a.m AS ht, sty - r.t * sy AS hy, s2 - 2 * r.t * s1 + r.t * r.t * n0 AS hh, a.m, a.tt, a.ty, a.yy
  FROM r JOIN a USING (g) WHERE i > 2 AND i <= r.m - 2),
f AS (SELECT *, hh - h1 * h1 / m - ht * ht / tt AS own, hy - ht * ty / tt AS rest FROM h),
one AS (SELECT g, week AS c1, NULL AS c2, 1 AS j, yy - ty * ty / tt - rest * rest / own AS sse, m FROM f),
x AS (SELECT a.g, a.week AS c1, b.week AS c2, a.yy - a.ty * a.ty / a.tt AS base, a.own AS o1, b.own AS o2, a.rest AS r1, b.rest AS r2, a.m,
  b.s2 - (a.c + b.c) * b.s1 + a.c * b.c * b.n0 - a.h1 * b.h1 / a.m - a.ht * b.ht / a.tt AS o12 FROM f a JOIN f b ON a.g = b.g AND b.i >= a.i + 2),
two AS (SELECT g, c1, c2, 2 AS j, base - (r1 * r1 * o2 - 2 * r1 * r2 * o12 + r2 * r2 * o1) / (o1 * o2 - o12 * o12) AS sse, m FROM x),
every AS (SELECT g, NULL AS c1, NULL AS c2, 0 AS j, yy - ty * ty / tt AS sse, m FROM a UNION ALL SELECT g, c1, c2, j, sse, m FROM one UNION ALL SELECT * FROM two),
scored AS (SELECT *, ln(sse / m) + 2 * (j + 1) * ln(m) / m AS bic FROM every),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY g ORDER BY bic) = 1),
ends AS (SELECT g, min(week) AS e FROM c GROUP BY g UNION ALL SELECT g, max(week) FROM c GROUP BY g UNION ALL SELECT g, c1 FROM best WHERE j >= 1 UNION ALL SELECT g, c2 FROM best WHERE j = 2),
cut AS (SELECT g, e AS first, lead(e) OVER o AS last, row_number() OVER o AS segment FROM ends WINDOW o AS (PARTITION BY g ORDER BY e))
SELECT g AS o_orderpriority, m AS points, CAST(j AS INTEGER) AS joinpoints, CAST(segment AS INTEGER) AS segment, CAST(first AS DOUBLE) AS first, CAST(last AS DOUBLE) AS last,
  round(sse, 6) AS sse, round(bic, 6) AS bic FROM cut JOIN best USING (g) WHERE last IS NOT NULL
"""


def trend_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the weekly series without a logarithm, counted while the trend is fitted."""
    losses = Losses()
    written(loglinear_trend(weekly(spark, sf), ["o_orderpriority"], "week", "n", losses=losses))
    return losses.table(spark)


TREND_LOSSES = """
WITH w AS (SELECT DISTINCT o_orderpriority, floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7) AS t FROM orders)
SELECT 'trend' AS step, 'points' AS metric, count(*) AS n FROM w UNION ALL SELECT 'trend', 'no_logarithm', count(*) FILTER (t % 40 = 7) FROM w
"""


def trend_joinpoint_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """No joinpoint against one, by permutation of the residuals."""
    tests = permutation_joinpoints(quarterly(spark, sf), ["o_orderpriority"], "t", "n", 1, permutations=199, trace=True)
    return rounded(tests, "p_value")


TREND_JOINPOINT_PERMUTATION = f"""
WITH {QUARTERLY},
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS i, count(*) OVER (PARTITION BY g) AS m, regr_slope(y, t) OVER (PARTITION BY g) AS b, regr_intercept(y, t) OVER (PARTITION BY g) AS a FROM s),
e AS (SELECT g, t, i, m, a + b * t AS fit, y - a - b * t AS residual FROM n),
q AS (SELECT g, i, k, row_number() OVER (PARTITION BY g, k ORDER BY CASE WHEN k > 0 THEN md5('1:' || k || ':' || i) ELSE lpad(CAST(i AS VARCHAR), 9, '0') END) AS j FROM e, (SELECT unnest(range(0, 200)) AS k)),
y AS (SELECT e.g, q.k, e.t, e.i, e.m, e.fit + r.residual AS y FROM q JOIN e ON e.g = q.g AND e.i = q.j JOIN e r ON r.g = q.g AND r.i = q.i),
h AS (SELECT a.g, a.k, c.t AS c, a.t, greatest(a.t - c.t, 0) AS h, a.y, a.m FROM y a JOIN e c ON c.g = a.g AND c.i > 2 AND c.i <= c.m - 2),
v AS (SELECT g, k, c, var_pop(t) AS s11, var_pop(h) AS s22, covar_pop(t, h) AS s12, covar_pop(t, y) AS s1y, covar_pop(h, y) AS s2y, var_pop(y) AS yy FROM h GROUP BY ALL),
f AS (SELECT g, k, yy - s1y * s1y / s11 AS line, yy - s1y * s1y / s11 - pow(s2y - s12 * s1y / s11, 2) / (s22 - s12 * s12 / s11) AS bent FROM v),
x AS (SELECT g, k, any_value(line) / min(bent) AS ratio FROM f GROUP BY g, k),
c AS (SELECT g, (1 + count(*) FILTER (k > 0 AND ratio >= o * (1 - 1e-9))) / 200 AS p FROM x JOIN (SELECT g, ratio AS o FROM x WHERE k = 0) USING (g) GROUP BY g)
SELECT g AS o_orderpriority, 1 AS step, 0 AS smaller, 1 AS larger, round(p, 6) AS p_value, p <= 0.05 AS rejected FROM c
"""


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = group_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice", (0.25, 0.5, 0.9), 1000)
    return rounded(q, "q_0", "q_1", "q_2")


QUANTILES = """
SELECT l_returnflag, l_linenumber, round(quantile_cont(l_extendedprice, 0.25), 6) AS q_0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q_1,
  round(quantile_cont(l_extendedprice, 0.9), 6) AS q_2, count(*) AS points FROM lineitem GROUP BY ALL
"""


def density(spark: SparkSession, sf: str) -> DataFrame:
    feed = density_feed(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", points=128)
    return feed.select("c_mktsegment", "point", r6("x").alias("x"), F.round(F.col("density") * 1e4, 6).alias("density"))


DENSITY = """
WITH g AS (SELECT c_mktsegment, count(*) AS n, stddev_samp(c_acctbal) AS sd, (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34 AS iqr FROM customer GROUP BY 1),
h AS (SELECT avg(0.9 * least(sd, iqr) * pow(n, -0.2)) AS h FROM g),
r AS (SELECT h, min(c_acctbal) - 3 * h AS lo, (max(c_acctbal) - min(c_acctbal) + 6 * h) / 127 AS step FROM customer, h GROUP BY h),
p AS (SELECT c_mktsegment, (c_acctbal - lo) / step AS pos FROM customer, r),
w AS (SELECT c_mktsegment, CAST(floor(pos) AS INTEGER) AS bin, floor(pos) + 1 - pos AS w FROM p UNION ALL SELECT c_mktsegment, CAST(floor(pos) AS INTEGER) + 1, pos - floor(pos) FROM p),
b AS (SELECT c_mktsegment, bin, sum(w) / sum(sum(w)) OVER (PARTITION BY c_mktsegment) AS share FROM w GROUP BY c_mktsegment, bin)
SELECT c_mktsegment, CAST(k AS INTEGER) AS point, round(any_value(lo) + k * any_value(step), 6) AS x,
  round(sum(share * exp(-0.5 * pow((k - bin) * step / h, 2))) / any_value(h) / sqrt(2 * pi()) * 1e4, 6) AS density
FROM b, r, (SELECT unnest(range(0, 128)) AS k) GROUP BY c_mktsegment, k
"""

QUERIES = {
    "dsr_by_year": (dsr_by_year, DSR_BY_YEAR),
    "dsr_by_region_year": (dsr_by_region_year, DSR_BY_REGION_YEAR),
    "dsr_zero_filled": (dsr_zero_filled, DSR_ZERO_FILLED),
    "trend_loglinear": (trend_loglinear, TREND_LOGLINEAR),
    "trend_joinpoint_k1": (trend_joinpoint_k1, TREND_JOINPOINT_K1),
    "trend_joinpoint_k3": (trend_joinpoint_k3, TREND_JOINPOINT_K3),
    "trend_joinpoint_long": (trend_joinpoint_long, TREND_JOINPOINT_LONG),
    "trend_joinpoint_permutation": (trend_joinpoint_permutation, TREND_JOINPOINT_PERMUTATION),
    "trend_losses": (trend_losses, TREND_LOSSES),
    "trend_aapc": (trend_aapc, TREND_AAPC),
    "trend_summary": (trend_limits, TREND_SUMMARY),
    "trend_points": (trend_fitted, TREND_FITTED),
    "group_quantiles": (quantiles, QUANTILES),
    "density_feed": (density, DENSITY),
}
