"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct word shingles. Its sketch is filled in rounds: in round i every shingle falls into a hashed bin and
offers i plus a fraction; a bin keeps the least offer. From round t on, round i fills bin i - t, so every coordinate is filled after 2 t
rounds at most, and usually after a few. Two sketches agree in a share of coordinates concentrated around the Jaccard
similarity. Bands of ``ROWS`` coordinates propose pairs, the share of equal coordinates rules out hopeless ones, and what remains is
verified on the full sets.

* Texts with the same words are one class; classes, not rows, are compared.
* A bucket (classes with an equal band) is split into blocks of bounded size; a task compares two blocks, and verified links join
  classes in a union-find, so that pairs already connected there need no verification and only a forest of links leaves the task.
* A pair that shares several bands is looked at in the first of them only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import kept_in_worker
from ratewright.llm.components import components
from ratewright.llm.sketches import WordHashes, shingle_hashes
from ratewright.sources.tables import written

SHINGLE_WORDS = 3
PERCENT = 85
COORDINATES = 256
BANDS, ROWS = 32, 4  # a band's coordinates, 16 bits of each, are one 64-bit word
BANDED = BANDS * ROWS
BLOCK = 512
SLACK = 5.0  # standard deviations of an estimate below the threshold that still count as possible
EMPTY = np.uint64(2**64 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed values: splitmix64
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white space characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    return shingle_hashes([word.decode("latin-1") for word in words], size, known)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def fast_similarity_sketch(hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """``t`` coordinates (a power of two) of a non-empty set of 64-bit hashes; each agrees with probability Jaccard.

    Rounds are taken several at a time for small sets: an offer of a later round never beats one of an earlier round, so rounds
    beyond the one that fills the last bin change nothing.
    """
    filled = np.full(t, EMPTY)
    at_once = max(1, min(2 * t, 6 * t // len(hashes)))
    for first in range(0, 2 * t, at_once):
        rounds = np.arange(first, min(first + at_once, 2 * t), dtype=np.uint64)[:, None]
        x = mix(hashes[None, :] + (rounds + np.uint64(1)) * GOLDEN)
        bins = np.where(rounds < t, x & np.uint64(t - 1), rounds - np.uint64(t))  # later rounds have their own bin
        np.minimum.at(filled, bins.astype(np.intp).ravel(), ((rounds << np.uint64(54)) | (x >> np.uint64(10))).ravel())
        if filled.max() != EMPTY:
            break
    return filled


def packed_sketch(sketch: np.ndarray) -> bytes:
    """What is kept of a sketch: 16 bits of each coordinate of a band, a byte of each other one."""
    banded, others = sketch[:BANDED], sketch[BANDED:]
    return (banded & np.uint64(2**16 - 1)).astype("<u2").tobytes() + (others & np.uint64(255)).astype(np.uint8).tobytes()


def band_keys(packed: bytes) -> np.ndarray:
    """One 64-bit key per band, from the kept bits alone: within a band, keys are equal where the kept bits are, and only there."""
    words = np.frombuffer(packed, "<u8", BANDS)
    return mix(words ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN))


PREPARED = "doc_id long, digest binary, n_shingles long, bands array<long>, sketch binary"


def prepared(documents: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Class digest, size of the set, band keys and packed sketch of every row."""

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept_in_worker("word hashes", WordHashes)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                hashes = shingles(words, size, known)
                if len(hashes):
                    packed = packed_sketch(fast_similarity_sketch(hashes))
                    rows.append((doc_id, digest, len(hashes), band_keys(packed).view(np.int64), packed))
                else:
                    rows.append((doc_id, digest, 0, np.zeros(0, np.int64), b""))
            out = pd.DataFrame(rows, columns=["doc_id", "digest", "n_shingles", "bands", "sketch"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return keyed.mapInPandas(sketches, PREPARED)


def possible_pairs(group: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, share of equal coordinates) of the pairs this task must look at, as places in ``group``.

    Both blocks against each other, or one block against itself; pairs whose first equal band is another one are left to that bucket,
    which they share, since buckets are made of the very bits that are compared here.
    """
    kept = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), COORDINATES + BANDED)
    banded, others = np.ascontiguousarray(kept[:, : 2 * BANDED]).view("<u2"), kept[:, 2 * BANDED :]
    block, band = group["block"].to_numpy(), group["band"].to_numpy()
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    firsts, seconds, shares = [], [], []
    for begin in range(0, len(left), 32):
        rows = left[begin : begin + 32]
        equal = banded[rows][:, None, :] == banded[right][None, :, :]
        share = equal.sum(axis=2, dtype=np.float32) + (others[rows][:, None, :] == others[right][None, :, :]).sum(axis=2, dtype=np.float32)
        share /= COORDINATES
        share[rows[:, None] >= right[None, :] if i == j else np.zeros_like(share, bool)] = 0
        a, b = np.nonzero(share >= least)
        if len(a):
            first = equal[a, b].reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1)
            mine = (first == band[rows[a]]) & (first == band[right[b]])
            a, b = a[mine], b[mine]
            firsts.append(rows[a])
            seconds.append(right[b])
            shares.append(share[a, b])
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *firsts]), np.concatenate([none, *seconds]), np.concatenate([np.zeros(0, np.float32), *shares]))


def by_group(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """``work`` on each run of rows with the same (key, i, j) of a sorted stream; a run is two blocks at most."""
    held: list[pd.DataFrame] = []
    name = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["key", "i", "j"]].to_numpy()
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
        begin = 0
        for end in ends:
            now = tuple(keys[begin])
            if now != name and held:
                done = work(pd.concat(held, ignore_index=True))
                if done is not None and len(done):
                    yield done
                held = []
            name = now
            held.append(batch.iloc[begin:end])
            begin = end
    if held:
        done = work(pd.concat(held, ignore_index=True))
        if done is not None and len(done):
            yield done


def links(documents: DataFrame, nodes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): verified links between classes, enough to connect every two classes that a path of links connects.

    ``nodes`` has node (the smallest id of a class), bands and sketch.
    """
    threshold = percent / 100
    least = threshold - SLACK * (threshold * (1 - threshold) / COORDINATES) ** 0.5
    n_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = rows.join(buckets, "key").join(nodes.select("node", "sketch"), "node")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    members = members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "node", "sketch")

    def worth_reading(group: pd.DataFrame) -> pd.DataFrame | None:
        if len(group) < 2:
            return None
        first, second, _ = possible_pairs(group, least)
        return group.iloc[np.union1d(first, second)]

    def shortlist(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_group(batches, worth_reading)

    grouped = members.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    listed = written(grouped.mapInPandas(shortlist, members.schema))

    texts = documents.select(documents[id_col].cast("long").alias("node"), documents[text_col].cast("string").alias("text"))
    readable = texts.join(listed, "node").repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept_in_worker("word hashes", WordHashes)

        def forest(group: pd.DataFrame) -> pd.DataFrame:
            first, second, share = possible_pairs(group, least)
            node, text = group["node"].to_numpy(), group["text"]
            sets: dict[int, np.ndarray] = {}
            parent = list(range(len(group)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def hashes(x: int) -> np.ndarray:
                if x not in sets:
                    sets[x] = shingles(words_of(text.iloc[x]), size, known)
                return sets[x]

            found = []
            for k in np.argsort(-share, kind="stable"):
                x, y = int(first[k]), int(second[k])
                p, q = root(x), root(y)
                if p == q:
                    continue
                a, b = hashes(x), hashes(y)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    parent[p] = q
                    found.append((node[x], node[y]))
            return pd.DataFrame(found, columns=["a", "b"])

        return by_group(batches, forest)

    return readable.mapInPandas(verify, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    A set is the distinct ``size``-word shingles of the whole text (all words as one shingle when there are fewer); links join sets with
    100 * common >= ``percent`` * united. NULL texts and texts without words have no shingle and no link. Rows with the same id are one
    document: what links to one of its texts links to all. A row without an id links with nothing, has no component_id, and is
    kept. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = written(prepared(documents, size, id_col, text_col))
    linkable = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    least = linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("least"))
    nodes = written(least.select("digest", F.col("least.doc_id").alias("node"), "least.bands", "least.sketch"))
    classes = nodes.select("digest", "node")
    first = F.min("node").over(Window.partitionBy("doc_id"))  # another class only where rows share an id
    shared_ids = linkable.select("doc_id", "digest").join(classes, "digest").select(F.col("node").alias("a"), first.alias("b")).where("a <> b")
    roots = components(links(documents, nodes, size, percent, id_col, text_col).unionByName(shared_ids))
    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    found = rows.select("doc_id", "digest", "n_shingles").join(named, "digest", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("root")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
