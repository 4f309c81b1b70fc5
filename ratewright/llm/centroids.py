"""Centroid clustering of integer vectors with subvector dictionaries.

The vectors are stored in chunks. In a chunk every block of two dimensions is dictionary-encoded without loss: its distinct subvectors
and, for each vector, a code. A round computes the exact squared distance of every distinct subvector to the same dimensions of every
centroid, once, and a vector's distance to a centroid is the sum of its blocks' entries, looked up by code. The new centroids come from
the dictionaries as well: how often a cluster uses each code, times the subvector.

All arithmetic is on integers. Only centroids and one row per cluster ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.sources.tables import written

SCALE, CLUSTERS, ROUNDS, SEED = 64, 16, 3, 1
BLOCK = 2
CHUNK = 16_384
#: Components beyond this size are left out: a long would not hold their squared distances.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, size: int, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (longs): floor(scale * x) of the vectors with an id and exactly ``size`` present, finite components."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x * scale) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    kept = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") == size) & fine)
    return kept.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in order of the hash (repeated ids: smaller vector first)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["vector"] for r in vectors.orderBy(hashed, "vector").limit(clusters).select("vector").collect()], np.int64)


def encode_blocks(matrix: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Per block of dimensions the distinct subvectors and the code of each row, as packed integers."""
    dictionaries, codes = [], []
    for at in range(0, matrix.shape[1], BLOCK):
        part = matrix[:, at : at + BLOCK] + LARGEST  # not negative, below 2^29
        packed = part[:, 0] if part.shape[1] == 1 else (part[:, 0] << 29) | part[:, 1]
        distinct, code = np.unique(packed, return_inverse=True)
        split = distinct[:, None] if part.shape[1] == 1 else np.column_stack([distinct >> 29, distinct & ((1 << 29) - 1)])
        dictionaries.append((split - LARGEST).astype("<i4").tobytes())
        codes.append(code.astype("<u2").tobytes())  # a chunk has no more than 2^16 rows
    return dictionaries, codes


def encoded(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ids (packed), dictionaries and codes (one per block) of chunks of at most ``chunk`` vectors (65,536 or less)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                dictionaries, codes = encode_blocks(np.stack(part["vector"].to_numpy()).astype(np.int64))
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy("<i8").tobytes()], "dictionaries": [dictionaries], "codes": [codes]})

    return vectors.mapInPandas(pack, "ids binary, dictionaries array<binary>, codes array<binary>")


def unpacked(row, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The dictionaries and codes of one chunk, as arrays."""
    widths = [min(BLOCK, width - at) for at in range(0, width, BLOCK)]
    dictionaries = [np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, w) for raw, w in zip(row.dictionaries, widths)]
    return dictionaries, [np.frombuffer(raw, "<u2") for raw in row.codes]


def distances(dictionaries: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids: each distinct subvector's part is computed once and summed by code."""
    total = np.zeros((len(codes[0]), len(centroids)), np.int64)
    for b, (distinct, code) in enumerate(zip(dictionaries, codes)):
        gap = distinct[:, None, :] - centroids[None, :, b * BLOCK : b * BLOCK + distinct.shape[1]]
        total += (gap * gap).sum(axis=2)[code]
    return total


def cluster_sums(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sums (one per dimension) of the vectors nearest to each centroid; ties go to the smaller number."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = centroids.shape[1]
        for batch in batches:
            for row in batch.itertuples():
                dictionaries, codes = unpacked(row, width)
                mine = distances(dictionaries, codes, centroids).argmin(axis=1)
                n = np.bincount(mine, minlength=len(centroids))
                sums = []
                for distinct, code in zip(dictionaries, codes):
                    used = np.bincount(mine * len(distinct) + code, minlength=len(centroids) * len(distinct))
                    sums.append(used.reshape(len(centroids), -1) @ distinct)
                table = pd.DataFrame({"cluster": np.arange(len(centroids)), "n": n, "sums": list(np.hstack(sums))})
                yield table[table["n"] > 0]

    parts = chunks.select("dictionaries", "codes").mapInPandas(add, "cluster int, n long, sums array<long>")
    width = centroids.shape[1]
    totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals)
    return summed.select("cluster", "n", F.array(*[F.col(f"s{k}") for k in range(width)]).alias("sums"))


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Every centroid with vectors becomes their mean, rounded down; the others stay."""
    after = centroids.copy()
    for row in sums.collect():  # one row per cluster
        after[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return after


def assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = distances(*unpacked(row, centroids.shape[1]), centroids)
                mine = found.argmin(axis=1)
                yield pd.DataFrame({"vec_id": np.frombuffer(row.ids, "<i8"), "cluster": mine, "distance": found[np.arange(len(mine)), mine]})

    return chunks.mapInPandas(assign, "vec_id long, cluster int, distance long")


def long_or_null(total: Column) -> Column:
    return total.try_cast("long")


def clustered(
    vectors: DataFrame,
    size: int = 64,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    Kept are rows with an id and exactly ``size`` components, none NULL or non-finite (nor beyond 2^27 once scaled, where squared
    distances leave the range of a long); repeated rows and ids are kept as they are. With fewer vectors than ``clusters`` there are as
    many clusters as vectors; an empty table gives an empty result. Ties go to the smaller cluster, equal starting hashes to the smaller
    vector. A sum of distances beyond a long is NULL. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, size, id_col, vector_col)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = written(encoded(rows))
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(chunks, centroids))
    placed = written(assigned(chunks, centroids))
    found = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # one row per cluster
    whole = sum(int(r["inertia"]) for r in found)
    said = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(r["cluster"], str(r["inertia"]), str(whole), said[r["cluster"]]) for r in found],
        "cluster int, cluster_inertia string, inertia string, centroid_sha256 string",
    )
    facts = facts.withColumns({c: long_or_null(F.col(c)) for c in ("cluster_inertia", "inertia")})
    return placed.join(F.broadcast(facts), "cluster").select(  # at most one row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
