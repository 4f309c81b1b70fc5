"""Names, text, number and date expressions, column-set operators, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import r6, table
from ratewright.functions.text import (
    normalise_code,
    number_text,
    parse_number,
    percent_text,
    remove_all,
    remove_first,
    replace_first,
    strip_digits_and_marks,
    title_case,
)
from ratewright.operators.columns import (
    across,
    clean_names,
    drop_empty_columns,
    rename,
    rename_at,
    unite,
)
from ratewright.sources.tables import read_parquet_sources, union_by_name, union_with_source, written


def code_normalise(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    tail = F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, "").otherwise(
        (F.col("p_partkey") % 10).cast("string")
    )
    raw = F.concat(F.lower(F.substring("p_type", 1, 1)), F.lpad(number, 2, "0"), tail)
    parts = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return parts.select("p_partkey", "raw", normalise_code("raw").alias("code"), normalise_code("raw", "0").alias("padded"))


CODE_NORMALISE = """
WITH c AS (SELECT p_partkey, lower(substr(p_type, 1, 1)) || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') ||
  CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE CAST(p_partkey % 10 AS VARCHAR) END AS raw FROM part)
SELECT p_partkey, raw,
  CASE WHEN upper(raw) LIKE '%X' THEN regexp_replace(upper(raw), 'X$', '.0') ELSE substr(upper(raw), 1, 3) || '.' || substr(upper(raw), 4) END AS code,
  CASE WHEN upper(raw) LIKE '%X' THEN regexp_replace(upper(raw), 'X$', '.0')
       ELSE substr(upper(raw), 1, 3) || '.' || CASE WHEN length(raw) = 3 THEN '0' ELSE substr(upper(raw), 4) END END AS padded FROM c
"""


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        F.upper("c_mktsegment").alias("upper"),
        title_case("c_mktsegment").alias("title"),
        F.col("c_name").rlike("0{7}").alias("detected"),
        replace_first("c_name", "0", "o").alias("first_replaced"),
        remove_first("c_name", "0+").alias("first_removed"),
        remove_all("c_name", "0").alias("all_removed"),
        strip_digits_and_marks("c_name").alias("letters"),
        F.substring("c_name", 1, 3).alias("head"),
        F.substr("c_name", F.lit(10)).alias("tail"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pasted"),
        parse_number("c_name").alias("number"),
        parse_number(F.concat(F.lit("ca. "), F.format_number("c_acctbal", 2), F.lit(" EUR"))).alias("money"),
    )


TEXT_FUNCTIONS = """
SELECT c_custkey, upper(c_mktsegment) AS upper, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title,
  c_name LIKE '%0000000%' AS detected, regexp_replace(c_name, '0', 'o') AS first_replaced, regexp_replace(c_name, '0+', '') AS first_removed,
  replace(c_name, '0', '') AS all_removed, regexp_replace(c_name, '[0-9#]', '', 'g') AS letters, left(c_name, 3) AS head,
  substr(c_name, 10) AS tail, c_mktsegment || '-' || c_nationkey AS pasted, CAST(regexp_extract(c_name, '[0-9]+') AS DOUBLE) AS number,
  c_acctbal AS money FROM customer
"""


def number_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = written(
        table(spark, sf, "customer").groupBy("c_mktsegment").agg(
            F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")
        )
    )
    share = F.col("n") / c.agg(F.sum("n")).scalar()
    return c.select(
        "c_mktsegment",
        percent_text(share, 1).alias("pct"),
        percent_text(share, 2).alias("pct_2"),
        number_text("n").alias("n_text"),
        number_text(F.round("balance"), 0).alias("balance_text"),
        F.bround("balance", 1).alias("rounded"),
        r6(F.log("n")).alias("log_n"),
    )


NUMBER_FUNCTIONS = """
WITH c AS (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT c_mktsegment, printf('%.1f%%', round_even(n / t * 100, 1)) AS pct, printf('%.2f%%', round_even(n / t * 100, 2)) AS pct_2,
  translate(format('{:,}', n), ',', '.') AS n_text, translate(format('{:,}', CAST(round(balance) AS BIGINT)), ',', '.') AS balance_text,
  round_even(balance, 1) AS rounded, round(ln(n), 6) AS log_n FROM c, t
"""


def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select(
        "o_orderkey",
        F.year("day").cast("bigint").alias("year"),
        F.month("day").cast("bigint").alias("month"),
        F.make_date(F.year("day"), F.lit(1), F.lit(1)).alias("january"),
        F.datediff("day", F.make_date(F.year("day"), F.lit(1), F.lit(1))).cast("bigint").alias("days"),
        F.size(F.sequence(F.make_date(F.year("day"), F.lit(1), F.lit(1)), "day", F.expr("interval 1 month")))
        .cast("bigint")
        .alias("months_so_far"),
    )


DATE_FUNCTIONS = """
SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, make_date(year(o_orderdate), 1, 1) AS january,
  date_diff('day', make_date(year(o_orderdate), 1, 1), CAST(o_orderdate AS DATE)) AS days,
  CAST(month(o_orderdate) AS BIGINT) AS months_so_far FROM orders
"""


def column_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that clash or hold marks, cleaned, then renamed by position and by name, then dropped."""
    n = table(spark, sf, "nation").toDF("Nation Key", "Naçión (Name)", "Nation-Key")
    cleaned = clean_names(n)
    renamed = rename_at(rename(cleaned, {"nacion_name": "name"}), 0, ["key"])
    return renamed.select("name", "key", F.col("nation_key_2").alias("region")).withColumn("spare", F.lit(1)).drop("spare")


COLUMN_NAMES = "SELECT n_name AS name, n_nationkey AS key, n_regionkey AS region FROM nation"


def empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") < 0, F.col("event_type")).alias("blank"),
        F.nullif("event_type", F.lit("click")).alias("event_type"),
    )
    return drop_empty_columns(events)


EMPTY_COLUMNS = "SELECT event_id, nullif(event_type, 'click') AS event_type FROM events"


def across_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_discount").alias("rate_discount"), F.avg("l_tax").alias("rate_tax"), F.count("*").alias("n")
    )
    return across(li, "^rate_", lambda c: F.round(c * 100, 4))


ACROSS_COLUMNS = """
SELECT l_returnflag, round(avg(l_discount) * 100, 4) AS rate_discount, round(avg(l_tax) * 100, 4) AS rate_tax, count(*) AS n
FROM lineitem GROUP BY 1
"""


def united_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )
    return unite(o, ["o_orderpriority", "status"], "key")


UNITED_KEY = """
SELECT o_orderkey, o_orderpriority, nullif(o_orderstatus, 'P') AS status,
  o_orderpriority || '_' || coalesce(nullif(o_orderstatus, 'P'), 'NA') AS key FROM orders
"""


def union_of_balances(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return union_by_name([c, s])


UNION_OF_BALANCES = """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier
"""


def union_with_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = {
        "customer": table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")),
    }
    return union_with_source(parts, "source").groupBy("source", "nation").agg(F.count("*").alias("n"))


UNION_WITH_NAMES = """
SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL
"""


def file_provenance(spark: SparkSession, sf: str) -> DataFrame:
    files = read_parquet_sources(spark, [f"{sf}/orders.parquet"], "file")
    return files.groupBy("file", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("n"))


FILE_PROVENANCE = "SELECT 'orders.parquet' AS file, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL"


def written_table(spark: SparkSession, sf: str) -> DataFrame:
    """Counts written to the shared folder and read back."""
    return written(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")))


WRITTEN_TABLE = "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1"

QUERIES = {
    "code_normalise": (code_normalise, CODE_NORMALISE),
    "text_functions": (text_functions, TEXT_FUNCTIONS),
    "number_functions": (number_functions, NUMBER_FUNCTIONS),
    "date_functions": (date_functions, DATE_FUNCTIONS),
    "column_names": (column_names, COLUMN_NAMES),
    "drop_empty_columns": (empty_columns, EMPTY_COLUMNS),
    "across_columns": (across_columns, ACROSS_COLUMNS),
    "united_key": (united_key, UNITED_KEY),
    "union_by_name": (union_of_balances, UNION_OF_BALANCES),
    "union_with_source": (union_with_names, UNION_WITH_NAMES),
    "file_provenance": (file_provenance, FILE_PROVENANCE),
    "written_table": (written_table, WRITTEN_TABLE),
}
