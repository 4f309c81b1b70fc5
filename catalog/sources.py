"""Sources and sinks: the given tables landed as files below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import table
from ratewright.sources.losses import Losses
from ratewright.sources.tables import read_csv_union, read_sheets, read_table, shared_folder, sheet_range, write_table, written


def landing(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/landed-{uuid.uuid4().hex}"


def landed_suppliers(spark: SparkSession, sf: str) -> tuple[list[str], DataFrame]:
    """Suppliers landed as two groups of CSV files whose headers differ in order and columns."""
    folder, suppliers = landing(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    even = F.col("s_suppkey") % 2 == 0
    # Some numbers are unreadable: a balance with a currency, a nation that is a word.
    balance = F.when(F.col("s_suppkey") % 10 == 4, F.concat(F.lit("$"), "s_acctbal")).otherwise(F.col("s_acctbal").cast("string"))
    nation = F.when(F.col("s_suppkey") % 15 == 9, F.lit("none")).otherwise(F.col("s_nationkey").cast("string"))
    text = suppliers.withColumns({"s_acctbal": balance, "s_nationkey": nation})
    text.filter(even).write.option("header", True).csv(f"{folder}/even")
    text.filter(~even).select("s_nationkey", "s_suppkey", "s_name").write.option("header", True).csv(f"{folder}/odd")
    return [f"{folder}/even", f"{folder}/odd"], suppliers


def csv_union(spark: SparkSession, sf: str) -> DataFrame:
    """The landed suppliers as one table, with the folder each row came from; unreadable values are NULL."""
    paths, suppliers = landed_suppliers(spark, sf)
    return read_csv_union(spark, paths, suppliers.schema, "source", folders=True)


CSV_UNION = """
SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 15 <> 9 THEN s_nationkey END AS s_nationkey,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 10 <> 4 THEN s_acctbal END AS s_acctbal, CASE s_suppkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source FROM supplier
"""


def read_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read and unreadable values per column, counted by the pass that writes the union."""
    paths, suppliers = landed_suppliers(spark, sf)
    losses = Losses()
    written(read_csv_union(spark, paths, suppliers.schema, losses=losses))
    return losses.table(spark)


READ_LOSSES = """
SELECT 'read' AS step, 'rows' AS metric, count(*) AS n FROM supplier UNION ALL SELECT 'read', 's_suppkey', 0 UNION ALL SELECT 'read', 's_name', 0
UNION ALL SELECT 'read', 's_nationkey', count(*) FILTER (s_suppkey % 15 = 9) FROM supplier
UNION ALL SELECT 'read', 's_acctbal', count(*) FILTER (s_suppkey % 10 = 4) FROM supplier
"""


def sheet_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations landed as one sheet per region, a fixed cell range taken from every sheet, with the name of the sheet.

    A sheet has the letters of its columns as header and its row number in ``row``; the range leaves out the heading row.
    """
    folder = landing(spark)
    nations = table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 2).cast("int").alias("row"), F.col("n_name").alias("A"), F.col("n_nationkey").cast("string").alias("B"), "n_regionkey"
    )
    names = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    nations = nations.join(names, "n_regionkey").drop("n_regionkey")
    nations.write.partitionBy("region").option("header", True).csv(folder)
    sheets = read_sheets(spark, folder, nations.drop("region").schema, folders=True)
    return sheet_range(sheets, "A3:B20", ["name", "key"])


SHEET_RANGES = """
SELECT r_name AS sheet, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey + 2 BETWEEN 4 AND 20
"""


def partitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written by status, read back and counted."""
    folder = landing(spark)
    write_table(table(spark, sf, "orders"), folder, ["o_orderstatus"])
    return read_table(spark, folder).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def replaced_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written by year and clustered by customer; then one year is written again with half its rows, the others stay."""
    folder = landing(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    write_table(orders, folder, ["year"], ["o_custkey"])
    again = orders.filter((F.col("year") == 1997) & (F.col("o_orderkey") % 2 == 0))
    write_table(again.withColumn("o_totalprice", F.col("o_totalprice") + 1), folder, ["year"], ["o_custkey"], replace="partitions")
    back = read_table(spark, folder).filter(F.col("year").between(1996, 1998))
    return back.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_custkey").alias("last_customer"))


REPLACED_PARTITIONS = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice + CASE WHEN year(o_orderdate) = 1997 THEN 1 ELSE 0 END), 2) AS total, max(o_custkey) AS last_customer
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND (year(o_orderdate) <> 1997 OR o_orderkey % 2 = 0) GROUP BY 1
"""

PARTITIONED_SINK = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"

QUERIES = {
    "csv_union": (csv_union, CSV_UNION),
    "read_losses": (read_losses, READ_LOSSES),
    "replaced_partitions": (replaced_partitions, REPLACED_PARTITIONS),
    "sheet_ranges": (sheet_ranges, SHEET_RANGES),
    "partitioned_sink": (partitioned_sink, PARTITIONED_SINK),
}
