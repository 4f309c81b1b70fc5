"""Session settings for local runs; on a cluster pass your own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "ratewright", cores: int | str | None = None) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster leave ``spark.sql.shuffle.partitions`` high and let adaptive
    execution coalesce. Outside ``llm`` no result depends on its value.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # One process is its own cluster; on any other, the cluster's own setting holds.
        .config("spark.checkpoint.dir", f"{tempfile.gettempdir()}/ratewright-written")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
