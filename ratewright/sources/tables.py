"""Readers and writers: CSV unions, landed sheets, Parquet, written intermediates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.sources.losses import Losses


def _origin(folders: bool) -> Column:
    """Name of the file a row came from, without its ending, or of the folder of that file (what follows ``=`` in it)."""
    if folders:
        return F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"(?:[^/=]+=)?([^/]+)/[^/]+$", 1))
    return F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")


def read_csv_union(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType,
    source: str | None = None,
    folders: bool = False,
    losses: Losses | None = None,
) -> DataFrame:
    """Several CSV files as one table, matched by header name.

    Files may order or lack columns differently: each is read with its own
    header as text, cast to ``schema`` (unreadable values become NULL), and
    unioned by name. ``source`` adds the file name, for overlap checks, or with
    ``folders`` the name of the folder a path is. ``losses`` counts, in the same
    pass, the rows and the unreadable values of each column.
    """
    parts = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        there = [f for f in schema.fields if f.name in raw.columns]
        origin = [(_origin(True) if folders else F.col("_metadata.file_name")).alias(source)] if source else []
        raw = raw.select(*[F.col(f"`{f.name}`") for f in there], *origin)
        if losses is not None:
            lost = {f.name: F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()) for f in there}
            raw = losses.watch(raw, "read", {"rows": F.count("*"), **lost})
        cols = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f in there else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        parts.append(raw.select(*cols, *([source] if source else [])))
    return union_by_name(parts)


def read_sheets(
    spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType, sheet: str = "sheet", folders: bool = False
) -> DataFrame:
    """Landed sheets (one CSV per sheet, same layout) with the sheet name as a column.

    One scan over all files; the name is the file name without its ending, or
    with ``folders`` the name of the folder that holds a sheet's files, as Spark
    writes them. A file whose header differs from ``schema`` is an error, not a
    mix of columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("recursiveFileLookup", folders).csv(paths).select("*", _origin(folders).alias(sheet))


def read_parquet_sources(
    spark: SparkSession, paths: Sequence[str], source: str = "source"
) -> DataFrame:
    """Several Parquet tables of one layout with the file each row came from."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_name").alias(source))


def sheet_range(df: DataFrame, ref: str, names: Sequence[str], row: str = "row") -> DataFrame:
    """Cells of a landed sheet inside a range such as ``B14:C36``, header row left out.

    The landed table has spreadsheet letters as column names and the sheet row
    number in ``row``; other columns (such as the sheet name) are kept. The row
    filter and the column list reach the scan.
    """
    first, top, last, bottom = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", ref).groups()
    letters = [c for c in df.columns if re.fullmatch(r"[A-Z]{1,3}", c)]
    wanted = letters[letters.index(first) : letters.index(last) + 1]
    if len(wanted) != len(names):
        raise ValueError(f"range {ref} has {len(wanted)} columns, got {len(names)} names")
    kept = [c for c in df.columns if c not in letters and c != row]
    return df.filter(F.col(row).between(int(top) + 1, int(bottom))).select(
        *kept, *[F.col(c).alias(n) for c, n in zip(wanted, names)]
    )


def union_by_name(parts: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables; columns missing in one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_with_source(parts: dict[str, DataFrame], source: str) -> DataFrame:
    """Rows of all tables, each marked with the name it is listed under."""
    return union_by_name(df.withColumn(source, F.lit(name)) for name, df in parts.items())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    replace: str = "table",
) -> None:
    """Write a Parquet table, partitioned for pruning when asked.

    ``replace="table"`` overwrites all of it, ``"partitions"`` only the
    partitions that ``df`` has rows for. ``cluster_by`` deals the rows into
    ranges of (partition, cluster) and sorts them, so each file of a partition
    holds a narrow span of these columns and scans skip by its statistics; a
    partition with most of the rows is several ranges, so several files and
    tasks. Without it a task writes the rows it has.
    """
    if replace not in ("table", "partitions"):
        raise ValueError(f"replace is table or partitions, not {replace}")
    if replace == "partitions" and not partition_by:
        raise ValueError("a table without partitions has none to replace")
    if cluster_by:
        order = [*partition_by, *cluster_by]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mode = "dynamic" if replace == "partitions" else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a
    folder of the warehouse, which driver and executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written"
    return re.sub(r"^file:/+", "/", folder).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true size
    of the result, so that a join to it is broadcast when it fits
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when it does not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
