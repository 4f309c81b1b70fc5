"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.sources.tables import shared_folder

FOLDS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python worker process; later tasks of that process get the same object.

    A worker keeps one object: what an earlier stage remembered goes when another stage begins, so a long job does not add them up.
    """
    store = vars(sys).setdefault("_ratewright_worker", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from (NULL ids belong to it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def smallest_hashes(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those with the smallest hashes of ``keys``: the same rows on any partitioning.

    Rows whose hash lies far above the wanted share are dropped before anything is sorted, so tasks send few rows however many they
    are.
    """
    hashed = F.xxhash64(*keys)
    return df.where(hash_below(hashed, F.lit(hash_share(most, df.count())))).orderBy(hashed, *keys).limit(most)


def hash_share(most: int, n: int) -> float:
    """Share of the hash range that holds ``most`` of ``n`` rows with certainty enough (twice as many and a thousand are expected)."""
    return min(1.0, (2 * most + 1000) / max(1, n))


def hash_below(hashed: Column, share: Column) -> Column:
    """True for the smallest ``share`` of 64-bit hashes."""
    return (share >= 1) | (hashed.cast("double") < share * 2.0**64 - 2.0**63)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for raw files below the shared folder, as a path that tasks can open too."""
    import uuid

    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(filesystem, path) of a folder or file in the shared store: local mount, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
