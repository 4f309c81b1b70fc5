"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and every vector is sent down to a leaf. A query walks the tree with a priority queue: the node
whose centre is nearest to it is opened next, so leaves come out by promise, and the first ``m`` of them are searched exactly.
``m`` is widened until a sample of queries, whose true neighbours are known by brute force over all vectors, finds the wanted share of
them.

Equal vectors are searched once, with their smallest ids; large leaves are split into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import smallest_hashes
from ratewright.sources.tables import written

SAMPLE_VECTORS = 20_000
CHILDREN = 8
LEAF_SAMPLE = 60
KMEANS_ROUNDS = 10
CALIBRATION_QUERIES = 200
RECALL = 0.97
BLOCK = 4096
SEED = 5


@dataclass
class Tree:
    """Centres by node, children by node (empty for a leaf), leaf number by node (-1 inside)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        """The leaf each unit vector falls into, going to the nearest child."""
        out = np.zeros(len(units), np.int32)
        waiting = [(0, np.arange(len(units)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            nearest = (units[rows] @ self.centres[self.children[node]].T).argmax(axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node])]
        return out

    def leaves_by_promise(self, unit: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk."""
        near = self.centres @ unit
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-float(near[child]), child))
        return out


def units_of(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_tree(units: np.ndarray) -> Tree:
    rng = np.random.default_rng(SEED)
    centres, children, waiting = [units.mean(axis=0)], [[]], [(0, np.arange(len(units)))]
    while waiting:
        node, rows = waiting.pop()
        if len(rows) <= LEAF_SAMPLE:
            continue
        points = units[rows]
        middle = points[rng.choice(len(points), CHILDREN, replace=False)]
        for _ in range(KMEANS_ROUNDS):
            nearest = (points @ middle.T).argmax(axis=1)
            for k in range(CHILDREN):
                mine = points[nearest == k]
                if len(mine):
                    total = mine.sum(axis=0)
                    middle[k] = total / max(np.linalg.norm(total), 1e-12)
        nearest = (points @ middle.T).argmax(axis=1)
        used = np.unique(nearest)
        if len(used) < 2:
            continue
        for k in used:
            centres.append(middle[k])
            children.append([])
            children[node].append(len(centres) - 1)
            waiting.append((len(centres) - 1, rows[nearest == k]))
    leaf = np.full(len(centres), -1, np.int32)
    ends = [n for n, below in enumerate(children) if not below]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf)


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled first so that no square overflows or vanishes."""
    x, y = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def best_of(queries: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, keys: np.ndarray, most: int) -> pd.DataFrame:
    """The ``most`` nearest of ``vectors`` to each query, by exact cosine, ties to the smaller key."""
    rough = units_of(queries) @ units_of(vectors).T
    wide = min(len(keys), most + 4)
    at = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
    floor = np.take_along_axis(rough, at, axis=1).min(axis=1)
    rows, cols = np.nonzero(rough >= floor[:, None] - 1e-12)  # with everything tied at the edge
    score = cosines(queries[rows], vectors[cols])
    out = pd.DataFrame({"query": query_keys[rows], "score": score, "rep": keys[cols]})
    out = out.sort_values(["query", "score", "rep"], ascending=[True, False, True], kind="stable")
    return out.groupby("query", sort=False).head(most)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles) of rows with an id whose components are present, finite and not all zero, of the commonest length."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("vector") == F.lit(size["size"] if size else 0))


def nearest(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (a condition on ``vec_id``) holds.

    All other rows are candidates; rows with the query's id are its own. Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components take no part, nor do those of another length than the commonest. Repeated rows count once; with fewer candidates all are
    returned; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(usable(vectors, id_col, vector_col).distinct())
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)  # equal vectors beyond the k + 1 smallest ids never rank
    groups = written(few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = written(rows.where(is_query).join(groups.select("vector", "rep"), "vector").select("vec_id", "rep"))

    sample = smallest_hashes(groups.select("rep", "vector"), ["rep"], SAMPLE_VECTORS).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    tree = fit_tree(units_of(as_matrix(sample["vector"])))

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["leaf"] = tree.leaf_of(units_of(as_matrix(batch["vector"])))
                yield batch

    placed = written(groups.select("rep", "vector").mapInPandas(to_leaves, "rep long, vector array<double>, leaf int"))
    leaves = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # one row per leaf
    queries = asked.select("rep").distinct().join(placed.select("rep", "vector"), "rep")
    visits = calibrated(placed, queries, tree, k, recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["leaves"] = [tree.leaves_by_promise(unit, visits) for unit in units_of(as_matrix(batch["vector"]))]
                yield batch

    visiting = queries.mapInPandas(walk, "rep long, vector array<double>, leaves array<int>")
    visiting = visiting.select("rep", "vector", F.explode("leaves").alias("leaf")).join(leaves, "leaf")
    visiting = visiting.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "vector")
    stored = placed.join(leaves, "leaf").select("leaf", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "rep", "vector")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, matrix, keys = None, [], None, None
        for batch in batches:
            for now, part in batch.groupby(["leaf", "block", "role"], sort=False):
                if now[:2] != name:
                    name, held, matrix = now[:2], [], None
                if now[2] == 0:  # a block's vectors come before its queries
                    held.append(part)
                    continue
                if not held:
                    continue
                if matrix is None:
                    block = pd.concat(held)
                    matrix, keys = as_matrix(block["vector"]), block["rep"].to_numpy()
                yield best_of(as_matrix(part["vector"]), part["rep"].to_numpy(), matrix, keys, k + 1)

    together = stored.unionByName(visiting).repartition(n_parts, "leaf", "block").sortWithinPartitions("leaf", "block", "role", "rep")
    found = together.mapInPandas(search, "query long, score double, rep long")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    named = found.join(groups.select("rep", "ids"), "rep").select("query", "score", "ids")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(named, "query")
    answers = answers.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(placed: DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """query, score, rep, leaf of the ``most`` nearest of all vectors to a bounded table of queries; tasks keep their best."""
    vectors, keys = as_matrix(queries["vector"]), queries["rep"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best = best_of(vectors, keys, as_matrix(batch["vector"]), batch["rep"].to_numpy(), most)
                yield best.merge(batch[["rep", "leaf"]], on="rep")

    found = placed.mapInPandas(scan, "query long, score double, rep long, leaf int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).toPandas()


def calibrated(placed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The least number of leaves that finds ``recall`` of the true neighbours of a sample of queries."""
    sample = smallest_hashes(queries, ["rep"], CALIBRATION_QUERIES).toPandas()
    if not len(sample):
        return 1
    true = brute_force(placed, sample, k + 1)
    order = {rep: tree.leaves_by_promise(unit, tree.n_leaves) for rep, unit in zip(sample["rep"], units_of(as_matrix(sample["vector"])))}
    needed = np.sort([order[q].index(leaf) + 1 for q, rep, leaf in zip(true["query"], true["rep"], true["leaf"]) if q != rep] or [1])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
