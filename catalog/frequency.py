"""Counts, shares, cross tables, tests, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import rounded, table
from ratewright.functions.predicates import in_band, one_of, unless
from ratewright.operators.frequency import (
    chi_square,
    count_by,
    cross_table,
    frequency,
    share_of_total,
    share_within,
    summary_by_group,
    top_k,
    weighted_count,
    without_margins,
)
from ratewright.sources.tables import union_by_name


def freq_one_way(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"))
    return rounded(frequency(events, "event_type"), "pct", "valid_pct")


FREQ_ONE_WAY = """
WITH c AS (SELECT nullif(event_type, 'error') AS event_type, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT sum(n) AS all_n, sum(n) FILTER (event_type IS NOT NULL) AS valid_n FROM c)
SELECT event_type, n, round(n / all_n, 6) AS pct,
  CASE WHEN event_type IS NOT NULL THEN round(n / valid_n, 6) END AS valid_pct,
  printf('%.1f%%', round_even(n / all_n * 100, 1)) AS pct_text
FROM c, t
"""


def freq_two_way_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Status within priority; one status is taken as missing and has its own cell."""
    orders = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    wide = cross_table(orders, "o_orderpriority", "o_orderstatus", ["F", "O"], "Total")
    return rounded(wide, "p_F", "p_O", "p_NA")


FREQ_TWO_WAY_PCT = """
WITH w AS (SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority,
  count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O,
  count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) AS n_NA, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority))
SELECT o_orderpriority, n_F, n_O, n_NA, round(n_F / n, 6) AS p_F, round(n_O / n, 6) AS p_O, round(n_NA / n, 6) AS p_NA FROM w
"""


def freq_two_way_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by status, long form; a level is called like the total row, one like a missing value, and one is missing."""
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, "Total").when(F.col("l_linenumber") == 2, "NA").when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("string")).alias("line"),
        F.when(F.col("l_suppkey") % 10 == 0, "NA").when(F.col("l_suppkey") % 10 > 1, F.col("l_suppkey").cast("string")).alias("supplier"),
    )
    return rounded(cross_table(lines, "line", "supplier", total="Total"), "pct")


FREQ_TWO_WAY_LEVELS = """
WITH l AS (SELECT CASE WHEN l_linenumber = 1 THEN 'Total' WHEN l_linenumber = 2 THEN 'NA' WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END AS line,
  CASE WHEN l_suppkey % 10 = 0 THEN 'NA' WHEN l_suppkey % 10 > 1 THEN CAST(l_suppkey AS VARCHAR) END AS supplier FROM lineitem),
c AS (SELECT line, supplier, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT line, sum(n) AS row_n FROM c GROUP BY line), k AS (SELECT DISTINCT supplier FROM c),
g AS (SELECT r.line, k.supplier, coalesce(n, 0) AS n, row_n, false AS margin FROM r CROSS JOIN k
  LEFT JOIN c ON c.line IS NOT DISTINCT FROM r.line AND c.supplier IS NOT DISTINCT FROM k.supplier)
SELECT line, supplier, n, margin, round(n / row_n, 6) AS pct FROM g
UNION ALL SELECT 'Total', supplier, CAST(sum(n) AS BIGINT), true, round(sum(n) / (SELECT sum(n) FROM c), 6) FROM c GROUP BY supplier
"""


def freq_two_way_named_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Wide form with a level called NA beside the missing ones, and a level called like the total row."""
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "2-HIGH", "Total").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "NA").when(F.col("o_orderstatus") == "O", "O").alias("status"),
    )
    return rounded(cross_table(orders, "priority", "status", ["NA", "O"], "Total", margin="is_total"), "p_NA", "p_O", "p_NA_")


FREQ_TWO_WAY_NAMED_LEVELS = """
WITH o AS (SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN 'Total' ELSE o_orderpriority END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'NA' WHEN 'O' THEN 'O' END AS status FROM orders),
w AS (SELECT CASE WHEN grouping(priority) = 1 THEN 'Total' ELSE priority END AS priority, grouping(priority) = 1 AS is_total,
  count(*) FILTER (status = 'NA') AS n_NA, count(*) FILTER (status = 'O') AS n_O, count(*) FILTER (status IS NULL) AS n_NA_, count(*) AS n FROM o GROUP BY ROLLUP (priority))
SELECT priority, is_total, n_NA, n_O, n_NA_, round(n_NA / n, 6) AS p_NA, round(n_O / n, 6) AS p_O, round(n_NA_ / n, 6) AS p_NA_ FROM w
"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers within return flags; number 3 is taken as missing."""
    lines = table(spark, sf, "lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(3)))
    return rounded(summary_by_group(lines, "l_returnflag", "l_linenumber"), "pct", "group_pct", "valid_pct")


SUMMARY = """
WITH c AS (SELECT l_returnflag, nullif(l_linenumber, 3) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS group_n, sum(n) FILTER (l_linenumber IS NOT NULL) AS known FROM c GROUP BY 1),
t AS (SELECT sum(n) AS total FROM c),
grid AS (SELECT * FROM g, (SELECT DISTINCT l_linenumber FROM c)),
s AS (SELECT grid.l_returnflag, grid.l_linenumber, coalesce(n, 0) AS n, group_n, group_n / total AS gp, coalesce(n, 0) / group_n AS p, CASE WHEN grid.l_linenumber IS NOT NULL THEN coalesce(n, 0) / known END AS vp
  FROM grid LEFT JOIN c ON c.l_returnflag = grid.l_returnflag AND c.l_linenumber IS NOT DISTINCT FROM grid.l_linenumber, t)
SELECT l_returnflag, l_linenumber, n, group_n, round(gp, 6) AS group_pct, round(p, 6) AS pct, round(vp, 6) AS valid_pct,
  printf('%.1f%%', round_even(gp * 100, 1)) AS group_text, printf('%.1f%%', round_even(p * 100, 1)) AS pct_text FROM s
"""


def topk_codes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_brand").rlike("#1|#2"))
    return rounded(top_k(part, ["p_brand", "p_type"], 15), "pct")


TOPK_CODES = """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part
  WHERE p_type IN ('ECONOMY', 'PROMO') AND regexp_matches(p_brand, '#1|#2') GROUP BY ALL)
SELECT p_brand, p_type, n, round(n / t, 6) AS pct, printf('%.1f%%', round_even(n / t * 100, 1)) AS pct_text
FROM c, (SELECT sum(n) AS t FROM c) ORDER BY n DESC, p_brand, p_type LIMIT 15
"""


def chi_square_stat(spark: SparkSession, sf: str) -> DataFrame:
    test = chi_square(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return rounded(test.withColumn("df", F.col("df").cast("bigint")), "statistic", "p_value")


CHI_SQUARE_STAT = """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT a, sum(n) AS rn FROM c GROUP BY a), k AS (SELECT b, sum(n) AS kn FROM c GROUP BY b),
t AS (SELECT sum(n) AS total FROM c),
e AS (SELECT coalesce(n, 0) AS o, rn * kn / CAST(total AS DOUBLE) AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b),
s AS (SELECT sum((o - e) * (o - e) / e) AS x, CAST(sum(o) AS BIGINT) AS n, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS df FROM e)
SELECT round(x, 6) AS statistic, df, n,
  round(exp(-x / 2) * list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda i: pow(x / 2, i) / factorial(CAST(i AS INTEGER)))), 6) AS p_value FROM s
"""


def chi_square_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by line number: thousands of degrees of freedom."""
    test = chi_square(table(spark, sf, "lineitem"), "l_partkey", "l_linenumber")
    return rounded(test.withColumn("df", F.col("df").cast("bigint")), "statistic", "p_value")


# The tail for even degrees of freedom is a finite sum; its terms are taken in log space.
CHI_SQUARE_WIDE = """
WITH c AS (SELECT l_partkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT a, sum(n) AS rn FROM c GROUP BY a), k AS (SELECT b, sum(n) AS kn FROM c GROUP BY b),
t AS (SELECT sum(n) AS total FROM c),
e AS (SELECT coalesce(n, 0) AS o, rn * kn / CAST(total AS DOUBLE) AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b),
s AS (SELECT sum((o - e) * (o - e) / e) AS x, CAST(sum(o) AS BIGINT) AS n, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS df FROM e)
SELECT round(x, 6) AS statistic, df, n,
  round(list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda i: exp(i * ln(x / 2) - x / 2 - lgamma(i + 1)))), 6) AS p_value FROM s
"""


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    keys = ["l_returnflag", F.year("l_shipdate").cast("bigint").alias("year")]
    return rounded(weighted_count(df, keys, "l_quantity", "quantity"), "quantity")


WEIGHTED = """
SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL
"""


def weighted_count_without_total(spark: SparkSession, sf: str) -> DataFrame:
    """A table that also carries total rows must not count everyone twice."""
    by_flag = count_by(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", name="items")
    totals = by_flag.groupBy("l_linestatus").agg(F.sum("items").alias("items")).withColumn("l_returnflag", F.lit("Total"))
    with_totals = union_by_name([by_flag, totals])
    return weighted_count(without_margins(with_totals, {"l_returnflag": "Total"}), ["l_linestatus"], "items")


WITHOUT_TOTAL = "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1"


def share_in_stratum(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("bigint"))
    return rounded(share_within(count_by(df, "l_returnflag", "year", "l_linestatus"), ["l_returnflag", "year"]), "pct")


SHARE_IN_STRATUM = """
WITH c AS (SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS year, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag, year), 6) AS pct FROM c
"""


def share_of_grand_total(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(share_of_total(count_by(table(spark, sf, "lineitem"), "l_suppkey")), "pct")


SHARE_OF_GRAND_TOTAL = """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT *, round(n / (SELECT sum(n) FROM c), 6) AS pct FROM c
"""


def null_aware_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows each predicate keeps when the column has NULLs."""
    o = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"),
        F.nullif("o_orderstatus", F.lit("P")).alias("s"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )
    p, s, year = F.col("p"), F.col("s"), F.col("year")
    kept = {
        "between": year.between(1996, 1999),
        "not_equal": p != "1-URGENT",
        "conjunction": year.between(1996, 1999) & ~p.rlike("^[12]") & ~(s == "F"),
        "pattern": p.rlike("URG|LOW"),
        "not_pattern": ~p.rlike("URG|LOW"),
        "member": p.isin("1-URGENT", "2-HIGH"),
        "unless": unless(p == "1-URGENT"),
        "unless_listed_or_null": unless(one_of("p", ["1-URGENT", None])),
        "one_of_null": one_of("p", [None]),
        "equal": F.col("month") == 1,
    }
    counted = o.agg(*[F.count_if(c).alias(n) for n, c in kept.items()])
    return counted.unpivot([], list(kept), "predicate", "n")


NULL_AWARE_FILTERS = """
WITH o AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS p, nullif(o_orderstatus, 'P') AS s, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT 'between' AS predicate, count(*) AS n FROM o WHERE y BETWEEN 1996 AND 1999
UNION ALL SELECT 'not_equal', count(*) FROM o WHERE p <> '1-URGENT'
UNION ALL SELECT 'conjunction', count(*) FROM o WHERE y BETWEEN 1996 AND 1999 AND NOT regexp_matches(p, '^[12]') AND NOT (s = 'F')
UNION ALL SELECT 'pattern', count(*) FROM o WHERE regexp_matches(p, 'URG|LOW')
UNION ALL SELECT 'not_pattern', count(*) FROM o WHERE NOT regexp_matches(p, 'URG|LOW')
UNION ALL SELECT 'member', count(*) FROM o WHERE p IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'unless', count(*) FROM o WHERE p IS DISTINCT FROM '1-URGENT'
UNION ALL SELECT 'unless_listed_or_null', count(*) FROM o WHERE p IS NOT NULL AND p <> '1-URGENT'
UNION ALL SELECT 'one_of_null', count(*) FROM o WHERE p IS NULL
UNION ALL SELECT 'equal', count(*) FROM o WHERE m = 1
"""


def lexical_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Text ranges on labels: binary order, both ends included."""
    part = table(spark, sf, "part").select("p_brand", "p_name")
    tests = {
        "brand_span": in_band("p_brand", None, ("Brand#1", "Brand#2")),
        "brand_span_or_listed": in_band("p_brand", ["Brand#9"], ("Brand#1", "Brand#2")),
        "name_span": in_band("p_name", None, ("blue", "green z")),
    }
    return part.groupBy(F.substring("p_brand", 1, 7).alias("prefix")).agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


LEXICAL_RANGES = """
SELECT substr(p_brand, 1, 7) AS prefix, count(*) FILTER (p_brand BETWEEN 'Brand#1' AND 'Brand#2') AS brand_span,
  count(*) FILTER (p_brand = 'Brand#9' OR p_brand BETWEEN 'Brand#1' AND 'Brand#2') AS brand_span_or_listed,
  count(*) FILTER (p_name BETWEEN 'blue' AND 'green z') AS name_span FROM part GROUP BY 1
"""

QUERIES = {
    "freq_one_way": (freq_one_way, FREQ_ONE_WAY),
    "freq_two_way_pct": (freq_two_way_pct, FREQ_TWO_WAY_PCT),
    "freq_two_way_levels": (freq_two_way_levels, FREQ_TWO_WAY_LEVELS),
    "freq_two_way_named_levels": (freq_two_way_named_levels, FREQ_TWO_WAY_NAMED_LEVELS),
    "summary_by_group": (summary, SUMMARY),
    "topk_codes": (topk_codes, TOPK_CODES),
    "chi_square_stat": (chi_square_stat, CHI_SQUARE_STAT),
    "chi_square_wide": (chi_square_wide, CHI_SQUARE_WIDE),
    "weighted_count": (weighted, WEIGHTED),
    "weighted_count_without_total": (weighted_count_without_total, WITHOUT_TOTAL),
    "share_in_stratum": (share_in_stratum, SHARE_IN_STRATUM),
    "share_of_grand_total": (share_of_grand_total, SHARE_OF_GRAND_TOTAL),
    "null_aware_filters": (null_aware_filters, NULL_AWARE_FILTERS),
    "lexical_ranges": (lexical_ranges, LEXICAL_RANGES),
}
