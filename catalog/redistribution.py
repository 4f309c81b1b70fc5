"""Redistribution of ill-defined categories: one stage on orders, all stages on records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import AGE_CODES, cause_rules, raw_records, recoded_sql, r6, rounded, table
from ratewright.operators.redistribute import (
    Stage,
    empty_pools,
    expected_counts,
    label_counts,
    number_copies,
    pool_shares,
    redistribute,
    row_key,
)
from ratewright.plans.records import (
    STAGES,
    STAGES_ON_LEVEL_ONE,
    STRATA,
    clean_records,
    recode_records,
    redistribute_records,
)
from ratewright.functions.hashing import uniform
from ratewright.sources.tables import written

ORDER_STRATA = ["o_orderpriority", "year"]
# Status P stands for the ill-defined category, F and O for the targets.
ORDER_STAGES = (Stage("status", ("P",), drop="P"),)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year"), "o_orderstatus"
    )


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    return label_counts(orders(spark, sf), ORDER_STRATA, "o_orderstatus", "o_orderstatus")


def pool_shares_query(spark: SparkSession, sf: str) -> DataFrame:
    shares = pool_shares(order_counts(spark, sf), ORDER_STRATA, ORDER_STAGES)
    return shares.select(*ORDER_STRATA, F.col("_value").alias("value"), "n", "total", "below", "upto", r6("p").alias("p"))


ORDERS_SQL = """
o AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year, o_orderstatus FROM orders),
c AS (SELECT o_orderpriority, year, o_orderstatus AS value, count(*) AS n FROM o WHERE o_orderstatus <> 'P' GROUP BY ALL),
pool AS (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority, year) AS BIGINT) AS total,
  CAST(sum(n) OVER (PARTITION BY o_orderpriority, year ORDER BY value) AS BIGINT) AS upto FROM c)
"""
POOL_SHARES = f"WITH {ORDERS_SQL} SELECT o_orderpriority, year, value, n, total, upto - n AS below, upto, round(n / total, 6) AS p FROM pool"


def redistribute_expected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        expected_counts(orders(spark, sf), ORDER_STRATA, "o_orderstatus", "o_orderstatus", ORDER_STAGES), "n_expected"
    )


REDISTRIBUTE_EXPECTED = f"""
WITH {ORDERS_SQL}, ill AS (SELECT o_orderpriority, year, count(*) AS k FROM o WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT o_orderpriority, year, value, n AS n_start, round(n + coalesce(k, 0) * n / total, 6) AS n_expected FROM pool LEFT JOIN ill USING (o_orderpriority, year)
UNION ALL SELECT o_orderpriority, year, 'P', k, 0.0 FROM ill
"""


def redistribute_draw(spark: SparkSession, sf: str) -> DataFrame:
    return redistribute(orders(spark, sf), "o_orderkey", ORDER_STRATA, "o_orderstatus", "o_orderstatus", ORDER_STAGES)


REDISTRIBUTE_DRAW = f"""
WITH {ORDERS_SQL}, u AS (SELECT *, ('0x' || substr(md5(o_orderkey || ':123:pool'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM o)
SELECT u.o_orderkey, u.o_orderpriority, u.year, u.o_orderstatus, CASE WHEN u.o_orderstatus = 'P' THEN p.value ELSE u.o_orderstatus END AS status
FROM u LEFT JOIN pool p ON u.o_orderstatus = 'P' AND u.o_orderpriority = p.o_orderpriority AND u.year = p.year AND u >= (upto - n) / total AND u < upto / total
"""


def redistribute_quota(spark: SparkSession, sf: str) -> DataFrame:
    return redistribute(
        orders(spark, sf), "o_orderkey", ORDER_STRATA, "o_orderstatus", "o_orderstatus", ORDER_STAGES, method="quota"
    )


REDISTRIBUTE_QUOTA = f"""
WITH {ORDERS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, year ORDER BY ('0x' || substr(md5(o_orderkey || ':123:pool'), 1, 8))::BIGINT, o_orderkey) - 1 AS i,
  count(*) OVER (PARTITION BY o_orderpriority, year) AS k FROM o WHERE o_orderstatus = 'P'),
k AS (SELECT DISTINCT o_orderpriority, year, k FROM r),
f AS (SELECT pool.*, k * n // total AS fl, k * n % total AS rest, k FROM pool JOIN k USING (o_orderpriority, year)),
g AS (SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY o_orderpriority, year ORDER BY rest DESC, value) <= k - sum(fl) OVER (PARTITION BY o_orderpriority, year) THEN 1 ELSE 0 END AS q FROM f),
h AS (SELECT *, sum(q) OVER (PARTITION BY o_orderpriority, year ORDER BY value) AS hi FROM g)
SELECT o_orderkey, o_orderpriority, year, o_orderstatus, o_orderstatus AS status FROM o WHERE o_orderstatus <> 'P'
UNION ALL SELECT r.o_orderkey, r.o_orderpriority, r.year, r.o_orderstatus, coalesce(h.value, 'P') FROM r
LEFT JOIN h ON r.o_orderpriority = h.o_orderpriority AND r.year = h.year AND r.i >= h.hi - h.q AND r.i < h.hi
"""


def recoded(spark: SparkSession, sf: str) -> DataFrame:
    return recode_records(clean_records(raw_records(spark, sf), AGE_CODES), cause_rules())


def _stage_rows(stages) -> str:
    def text(value):
        return "NULL" if value is None else f"'{value}'"

    results = list(dict.fromkeys(s.result for s in stages))
    return ", ".join(
        f"({i}, '{label}', {results.index(s.result) + 2}, {text(s.value)}, {text(s.keep)}, {text(s.drop)})"
        for i, s in enumerate(stages)
        for label in s.labels
    )


def stages_sql(stages=STAGES, residual: str = "group_2") -> str:
    return (
        "WITH "
        + recoded_sql(residual)
        + f""", stage(no, label, step, fixed, keep, leave) AS (VALUES {_stage_rows(stages)}),
cnt AS (SELECT sex, age_band, group_2_1 AS value, count(*) AS n FROM recoded WHERE group_2_1 IS NOT NULL GROUP BY ALL),
pool AS (SELECT no, sex, age_band, value, n, sum(n) OVER (PARTITION BY no, sex, age_band) AS total, sum(n) OVER (PARTITION BY no, sex, age_band ORDER BY value) AS upto
  FROM stage JOIN cnt ON fixed IS NULL AND (keep IS NULL OR regexp_matches(value, keep)) AND (leave IS NULL OR NOT regexp_matches(value, leave)))
"""
    )


RESULT_COLUMNS_SQL = """
  CASE WHEN step <= 2 THEN coalesce(g, group_2_1) ELSE group_2_1 END AS group_2_2,
  CASE WHEN step <= 3 THEN coalesce(g, group_2_1) ELSE group_2_1 END AS group_2_3,
  CASE WHEN step <= 4 THEN coalesce(g, group_2_1) ELSE group_2_1 END AS group_2_4
"""


def redistribute_staged(spark: SparkSession, sf: str) -> DataFrame:
    """All stages on recoded records, drawn by key."""
    return redistribute_records(recoded(spark, sf), "key").select(
        "key", "sex", "age_band", "code", "label", "group_1", "group_2", "group_2_1", "group_2_2", "group_2_3", "group_2_4"
    )


DRAWN_SQL = """, u AS (SELECT r.*, s.no, s.step, s.fixed,
  CASE WHEN s.no = 0 AND ('0x' || substr(md5(key || ':123:split'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN 'CMNN' END AS split,
  ('0x' || substr(md5(key || ':123:pool'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM recoded r LEFT JOIN stage s ON r.label = s.label),
given AS (SELECT u.*, coalesce(fixed, split, p.value) AS g FROM u LEFT JOIN pool p ON u.no = p.no AND u.sex = p.sex AND u.age_band = p.age_band
  AND split IS NULL AND u.u >= (upto - n) / total AND u.u < upto / total)
"""


def redistribute_staged_sql() -> str:
    return (
        stages_sql()
        + DRAWN_SQL
        + """SELECT key, sex, age_band, code, label, group_1, group_2, group_2_1, """
        + RESULT_COLUMNS_SQL
        + " FROM given"
    )


def redistribute_staged_quota(spark: SparkSession, sf: str) -> DataFrame:
    """All stages with exact quotas: records per stratum and final cause."""
    df = redistribute_records(recoded(spark, sf), "key", method="quota")
    return df.groupBy("sex", "age_band", "group_2_4").agg(F.count("*").alias("n"))


def redistribute_staged_quota_sql() -> str:
    return (
        stages_sql()
        + """, asked AS (SELECT no, sex, age_band, count(*) AS k FROM recoded JOIN stage USING (label) WHERE fixed IS NULL GROUP BY ALL),
taken AS (SELECT *, CASE WHEN no = 0 THEN CAST(round(k * 0.5) AS BIGINT) ELSE 0 END AS t FROM asked),
f AS (SELECT pool.*, k - t AS m, (k - t) * n // total AS fl, (k - t) * n % total AS rest FROM pool JOIN taken USING (no, sex, age_band)),
q AS (SELECT no, sex, age_band, value, fl + CASE WHEN row_number() OVER (PARTITION BY no, sex, age_band ORDER BY rest DESC, value) <= m - sum(fl) OVER (PARTITION BY no, sex, age_band) THEN 1 ELSE 0 END AS q FROM f),
moved AS (SELECT sex, age_band, value, q AS n FROM q UNION ALL SELECT sex, age_band, 'CMNN', t FROM taken
  UNION ALL SELECT r.sex, r.age_band, coalesce(s.fixed, r.group_2_1), 1 FROM recoded r LEFT JOIN stage s ON r.label = s.label WHERE s.no IS NULL OR s.fixed IS NOT NULL
  UNION ALL SELECT r.sex, r.age_band, r.group_2_1, 1 FROM recoded r JOIN stage s USING (label) WHERE s.fixed IS NULL AND s.no <> 0
    AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.no = s.no AND p.sex = r.sex AND p.age_band = r.age_band))
SELECT sex, age_band, value AS group_2_4, CAST(sum(n) AS BIGINT) AS n FROM moved GROUP BY 1, 2, 3 HAVING sum(n) > 0
"""
    )


def redistribute_staged_expected(spark: SparkSession, sf: str) -> DataFrame:
    table_ = expected_counts(recoded(spark, sf), STRATA, "label", "group_2_1", STAGES)
    return rounded(table_.filter(F.col("n_expected") > 0), "n_expected").drop("n_start")


def redistribute_staged_expected_sql() -> str:
    return (
        stages_sql()
        + """, asked AS (SELECT no, sex, age_band, sum(CASE WHEN no = 0 THEN 0.5 ELSE 1.0 END) AS k, any_value(group_2_1) AS own FROM recoded JOIN stage USING (label) WHERE fixed IS NULL GROUP BY no, sex, age_band),
moved AS (SELECT sex, age_band, coalesce(value, own) AS value, k * coalesce(n / total, 1.0) AS n FROM asked LEFT JOIN pool USING (no, sex, age_band)
  UNION ALL SELECT sex, age_band, 'CMNN', k FROM asked WHERE no = 0
  UNION ALL SELECT r.sex, r.age_band, coalesce(s.fixed, r.group_2_1), 1.0 FROM recoded r LEFT JOIN stage s ON r.label = s.label WHERE s.no IS NULL OR s.fixed IS NOT NULL)
SELECT sex, age_band, value, round(sum(CAST(n AS DOUBLE)), 6) AS n_expected FROM moved GROUP BY 1, 2, 3
"""
    )


def redistribute_level_one(spark: SparkSession, sf: str) -> DataFrame:
    """Residual rows labelled by level one: unspecific pneumonia and general GC2 stay "GC"."""
    df = recode_records(clean_records(raw_records(spark, sf), AGE_CODES), cause_rules(), residual="group_1")
    df = redistribute_records(df, "key", STAGES_ON_LEVEL_ONE)
    return df.groupBy("label", "group_2_2", "group_2_3", "group_2_4").agg(F.count("*").alias("n"))


def redistribute_level_one_sql() -> str:
    return (
        stages_sql(STAGES_ON_LEVEL_ONE, "group_1")
        + DRAWN_SQL
        + ", final AS (SELECT *, "
        + RESULT_COLUMNS_SQL
        + " FROM given) SELECT label, group_2_2, group_2_3, group_2_4, count(*) AS n FROM final GROUP BY ALL"
    )


def empty_pool_report(spark: SparkSession, sf: str) -> DataFrame:
    """Strata of part brand and size in which type PROMO finds no STANDARD part to go to."""
    part = table(spark, sf, "part").select("p_brand", "p_size", "p_type")
    stages = (Stage("type", ("PROMO",), keep="STANDARD"),)
    counts = written(label_counts(part, ["p_brand", "p_size"], "p_type", "p_type"))
    return empty_pools(counts, ["p_brand", "p_size"], stages)


EMPTY_POOL_REPORT = """
SELECT 'PROMO' AS labels, p_brand, p_size, count(*) AS n FROM part p WHERE p_type = 'PROMO'
  AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = 'STANDARD' AND q.p_brand = p.p_brand AND q.p_size = p.p_size) GROUP BY ALL
"""


def keyed_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Items without identifier, numbered among their copies and drawn by content and number."""
    items = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    numbered = number_copies(items, chunk=100)
    key = row_key(["l_returnflag", "l_linestatus", "l_linenumber", "copy"])
    return numbered.select("*", uniform(key, "7").alias("u"))


KEYED_COPIES = """
WITH n AS (SELECT l_returnflag, l_linestatus, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber) AS copy FROM lineitem)
SELECT *, ('0x' || substr(md5('1=' || l_returnflag || '|1=' || l_linestatus || '|' || length(CAST(l_linenumber AS VARCHAR)) || '=' || l_linenumber || '|' || length(CAST(copy AS VARCHAR)) || '=' || copy || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM n
"""

QUERIES = {
    "pool_shares": (pool_shares_query, POOL_SHARES),
    "redistribute_expected": (redistribute_expected, REDISTRIBUTE_EXPECTED),
    "redistribute_draw": (redistribute_draw, REDISTRIBUTE_DRAW),
    "redistribute_quota": (redistribute_quota, REDISTRIBUTE_QUOTA),
    "redistribute_staged": (redistribute_staged, redistribute_staged_sql),
    "redistribute_staged_quota": (redistribute_staged_quota, redistribute_staged_quota_sql),
    "redistribute_staged_expected": (redistribute_staged_expected, redistribute_staged_expected_sql),
    "redistribute_level_one": (redistribute_level_one, redistribute_level_one_sql),
    "empty_pools": (empty_pool_report, EMPTY_POOL_REPORT),
    "keyed_copies": (keyed_copies, KEYED_COPIES),
}
