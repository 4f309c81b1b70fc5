"""Long and wide tables, grids, interpolation, column binding, coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import rounded, table
from ratewright.operators.checks import coverage_summary, join_coverage, null_report, source_overlap
from ratewright.operators.columns import crossed_names, rename_at
from ratewright.operators.reshape import (
    bind_keyed,
    bind_slices,
    complete_grid,
    interpolate,
    long_to_wide,
    split_name,
    wide_to_long,
)
from ratewright.sources.tables import union_with_source, written

YEARS = tuple(range(1995, 2002))


def yearly_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Three measures per year side by side, named by position."""
    li = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate"))
    cells = [
        F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0.0)).alias(f"c{i}")
        for i, (y, c) in enumerate((y, c) for y in YEARS for c in ("l_quantity", "l_extendedprice", "l_tax"))
    ]
    wide = li.groupBy("l_returnflag").agg(*cells)
    return rename_at(wide, 1, crossed_names(["quantity", "price", "tax"], YEARS))


def wide_to_long_query(spark: SparkSession, sf: str) -> DataFrame:
    wide = yearly_wide(spark, sf)
    long = split_name(wide_to_long(wide, wide.columns[1:]), "name", ["measure", "year"])
    return rounded(long.withColumn("year", F.col("year").cast("bigint")), "value").withColumn("value", F.round("value", 2))


WIDE_TO_LONG = """
WITH l AS (SELECT l_returnflag, year(l_shipdate) AS year, l_quantity, l_extendedprice, l_tax FROM lineitem)
SELECT l_returnflag, 'quantity' AS measure, year, round(round(sum(l_quantity), 6), 2) AS value FROM l GROUP BY ALL
UNION ALL SELECT l_returnflag, 'price', year, round(round(sum(l_extendedprice), 6), 2) FROM l GROUP BY ALL
UNION ALL SELECT l_returnflag, 'tax', year, round(round(sum(l_tax), 6), 2) FROM l GROUP BY ALL
"""


def long_to_wide_query(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return long_to_wide(counts, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


LONG_TO_WIDE = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1
"""


def keyed_column_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly customer totals bound by customer; customers differ between years. One scan, no slice is read by itself."""
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    yearly = orders.groupBy("o_custkey", "y").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return bind_slices(yearly, ["o_custkey"], "y", YEARS, ["orders", "total"])


KEYED_COLUMN_BIND = f"""
SELECT o_custkey, {", ".join(f"nullif(count(*) FILTER (year(o_orderdate) = {y}), 0) AS orders_{y}, round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2) AS total_{y}" for y in YEARS)}
FROM orders GROUP BY 1
"""


def keyed_table_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, suppliers and names of nations bound by nation; not every table has every nation."""
    customers = table(spark, sf, "customer").filter(F.col("c_nationkey") > 2).groupBy(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf, "supplier").filter(F.col("s_nationkey") < 20).groupBy(F.col("s_nationkey").alias("nation"))
    names = table(spark, sf, "nation").filter(F.col("n_nationkey") % 4 > 0).select(F.col("n_nationkey").alias("nation"), "n_name")
    parts = [customers.agg(F.count("*").alias("customers")), suppliers.agg(F.count("*").alias("suppliers")), names]
    return bind_keyed(parts, ["nation"])


KEYED_TABLE_BIND = """
WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_nationkey > 2 GROUP BY 1),
s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_nationkey < 20 GROUP BY 1),
n AS (SELECT n_nationkey AS nation, n_name FROM nation WHERE n_nationkey % 4 > 0)
SELECT nation, customers, suppliers, n_name FROM c FULL JOIN s USING (nation) FULL JOIN n USING (nation)
"""


def monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Observed (nation, region) x all segments x months, with the customers' orders where there are any."""
    o = table(spark, sf, "orders").groupBy("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.count("*").alias("n")
    )
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("n_nationkey", "n_regionkey", "c_mktsegment", "month")
        .agg(F.sum("n").alias("n"))
    )
    grid = complete_grid(
        c,
        ["n_nationkey", "n_regionkey"],
        {"c_mktsegment": None},
        ("month", F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-12-01")), "1 month"),
    )
    return grid.join(counts, ["n_nationkey", "n_regionkey", "c_mktsegment", "month"], "left")


GRID_COMPLETE = """
WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT n_nationkey, n_regionkey, c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n
  FROM orders JOIN c ON o_custkey = c_custkey GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT n_nationkey, n_regionkey FROM c), (SELECT DISTINCT c_mktsegment FROM c),
  (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month))
SELECT n_nationkey, n_regionkey, c_mktsegment, month, n FROM grid LEFT JOIN counts USING (n_nationkey, n_regionkey, c_mktsegment, month)
"""


def interpolate_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly totals as January anchors, every month between them on the line; NULL after the last."""
    yearly = written(
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("month"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    grid = complete_grid(
        yearly,
        ["o_orderpriority"],
        {},
        ("month", F.to_date(F.lit("1994-10-01")), F.to_date(F.lit("2001-12-01")), "1 month"),
    )
    dense = grid.join(yearly, ["o_orderpriority", "month"], "left")
    filled = interpolate(dense, ["o_orderpriority"], "month", "total", "filled")
    return filled.select("o_orderpriority", "month", F.round("filled", 2).alias("filled"))


INTERPOLATE_MONTHLY = """
WITH y AS (SELECT o_orderpriority, make_date(year(o_orderdate), 1, 1) AS a, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
seg AS (SELECT *, lead(a) OVER w AS b, lead(v) OVER w AS u FROM y WINDOW w AS (PARTITION BY o_orderpriority ORDER BY a)),
grid AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM y),
  (SELECT CAST(unnest(generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month))
SELECT g.o_orderpriority, g.month, round(CASE WHEN g.month = s.a THEN s.v
  ELSE s.v + (s.u - s.v) * date_diff('day', s.a, g.month) / date_diff('day', s.a, s.b) END, 2) AS filled
FROM grid g LEFT JOIN seg s ON g.o_orderpriority = s.o_orderpriority AND g.month >= s.a AND (g.month < s.b OR (s.b IS NULL AND g.month = s.a))
"""


def coverage_keys(spark: SparkSession, sf: str) -> DataFrame:
    return join_coverage(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id"), ["doc_id"])


COVERAGE_KEYS = """
WITH l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), d AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, coalesce(l.n, 0) AS left_rows, coalesce(d.n, 0) AS right_rows FROM l FULL JOIN d USING (doc_id) WHERE l.n IS NULL OR d.n IS NULL
"""


def coverage_sides(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return coverage_summary(li, table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), ["key"])


COVERAGE_SIDES = """
WITH l AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS key, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN o.n IS NULL THEN 'left' WHEN l.n IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS keys,
  CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS left_rows, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS right_rows
FROM l FULL JOIN o USING (key) GROUP BY 1
"""


def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return null_report(docs, ["lang", "source", "text", "quality", "toxic"])


QUALITY_CHECKS = """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT count(*) AS n, count(lang) AS a, count(source) AS b, count(text) AS c, count(quality) AS d, count(toxic) AS e FROM d)
SELECT unnest(['lang', 'source', 'text', 'quality', 'toxic']) AS "column", n, unnest([n - a, n - b, n - c, n - d, n - e]) AS n_null FROM t
"""


def period_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Years held by more than one source."""
    parts = {
        "orders": table(spark, sf, "orders").select(F.col("o_orderdate").alias("t")),
        "lineitem": table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("t")),
        "events": table(spark, sf, "events").select(F.col("ts").alias("t")),
    }
    return source_overlap(union_with_source(parts, "source"), F.year("t").cast("bigint"), "source")


PERIOD_OVERLAP = """
WITH u AS (SELECT year(o_orderdate) AS period, 'orders' AS source FROM orders UNION ALL SELECT year(l_shipdate), 'lineitem' FROM lineitem
  UNION ALL SELECT year(ts), 'events' FROM events), c AS (SELECT period, source, count(*) AS n FROM u GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY period) AS sources FROM c
"""

QUERIES = {
    "wide_to_long": (wide_to_long_query, WIDE_TO_LONG),
    "long_to_wide": (long_to_wide_query, LONG_TO_WIDE),
    "keyed_column_bind": (keyed_column_bind, KEYED_COLUMN_BIND),
    "keyed_table_bind": (keyed_table_bind, KEYED_TABLE_BIND),
    "grid_complete": (monthly_counts, GRID_COMPLETE),
    "interpolate_monthly": (interpolate_monthly, INTERPOLATE_MONTHLY),
    "join_coverage": (coverage_keys, COVERAGE_KEYS),
    "coverage_summary": (coverage_sides, COVERAGE_SIDES),
    "quality_checks": (quality_checks, QUALITY_CHECKS),
    "source_overlap": (period_overlap, PERIOD_OVERLAP),
}
