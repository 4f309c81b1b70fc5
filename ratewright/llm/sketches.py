"""Document fingerprints: every shingle hash below a fixed fraction of the hash range (a scaled sketch).

The sketch of a union is the union of the sketches, and the share of one sketch found in another estimates containment however
unequal the documents are. A document whose hashes all lie above the threshold keeps its smallest hash, so only a document without
words has an empty fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import kept_in_worker

SHINGLE_WORDS = 5
FRACTION = 1 / 8
MOST_WORDS = 400_000
FOLD = np.uint64(0x100000001B3)  # fixed values: FNV prime, splitmix64 multipliers
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash by word; forgets everything when full."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = value
        return value


def shingle_hashes(words: list[str], size: int, known: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``size`` words; with fewer words, of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(known.__getitem__, words)), np.uint64)
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    rolled = np.full(n, size, np.uint64)
    for k in range(size):
        rolled = (rolled ^ hashes[k : k + n]) * FOLD
        rolled ^= rolled >> np.uint64(29)
    rolled = (rolled ^ (rolled >> np.uint64(30))) * MIX[0]
    rolled = (rolled ^ (rolled >> np.uint64(27))) * MIX[1]
    return np.unique(rolled ^ (rolled >> np.uint64(31)))


def sketch(text: str | None, known: WordHashes, size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> np.ndarray:
    """Sorted retained hashes of a text: words in lower case between white space."""
    hashes = shingle_hashes((text or "").lower().split(), size, known)
    kept = hashes[hashes < np.uint64(int(fraction * 2**64) - 1)]
    return kept if len(kept) else hashes[:1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch that the larger one holds; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return shared(a, b) / min(len(a), len(b))


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    below = both[both < np.uint64(int(fraction * 2**64) - 1)]
    return below if len(below) else both[:1]


def written_out(values: np.ndarray) -> str:
    """16 hexadecimal digits per retained hash."""
    return values.astype(">u8").tobytes().hex()


def edited_text(text: str, other: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of descending ids, each range ended by the first row of the next one (``guest``).

    There is a range for each shuffle partition; its ends are quantiles of the ids. The first id of each range comes from one small
    aggregate, and the last range is ended by the first row of all. Columns: doc_id, text, part, guest.
    """
    spark = documents.sparkSession
    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = sorted({int(e) for e in keyed.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}, reverse=True)
    # part 0 holds the largest ids; NULL sorts last in descending order
    part = F.size(F.filter(F.lit(ends).cast("array<long>"), lambda e: e >= F.col("doc_id"))) if ends else F.lit(0)
    dealt = keyed.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(ends))).otherwise(part))
    heads = {r["part"]: r["head"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # one row per range
    order = sorted(heads)
    hosts = spark.createDataFrame([(heads[p], p, order[i - 1]) for i, p in enumerate(order)], "head long, home int, host int")
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))
    guest = F.when(F.col("host").isNotNull(), F.array(F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))))
    none = F.array().cast("array<struct<part:int,guest:boolean>>")
    # at most one row per shuffle partition
    at = dealt.join(F.broadcast(hosts), dealt["doc_id"].eqNullSafe(hosts["head"]) & (dealt["part"] == hosts["home"]), "left")
    return at.select("doc_id", "text", F.explode(F.concat(own, F.coalesce(guest, none))).alias("at")).select("doc_id", "text", "at.part", "at.guest")


def fingerprint_edits(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, fraction: float = FRACTION
) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness; one row per input row.

    NULL texts count as empty; a text without words has the empty fingerprint, alike only to another such. Repeated ids are ordered
    by text. One document alone is its own next one. An empty table gives an empty result. Other columns are ignored.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept_in_worker("word hashes", WordHashes)
        last, part, done = None, None, False  # the row that waits for its next one
        for batch in batches:
            rows = []
            for p, guest, doc_id, text in zip(batch["part"], batch["guest"], batch["doc_id"], batch["text"]):
                if p != part:
                    last, part, done = None, p, False
                if done:
                    continue  # only the first guest counts
                own = sketch(text, known, size, fraction)
                if last is not None:
                    before_id, before, before_own = last
                    edited = edited_text(before, text)
                    other = sketch(edited, known, size, fraction)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((before_id, len(before), digest, written_out(before_own), written_out(other), likeness(before_own, other), likeness(before_own, own)))
                last, done = (None if pd.isna(doc_id) else int(doc_id), text, own), guest
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    dealt = with_next(documents, id_col, text_col)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined_up = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return lined_up.mapInPandas(compare, ROW)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """``sketch array<string>`` of every text (hexadecimal hashes, ascending), for joins, unions and containment.

    One row per input row, repeated rows and ids included; NULL and wordless texts have empty sketches; an empty table gives none.
    """

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept_in_worker("word hashes", WordHashes)
        for batch in batches:
            batch["sketch"] = [[f"{int(h):016x}" for h in sketch(text, known, size, fraction)] for text in batch["text"]]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[["doc_id", "sketch"]]

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return keyed.mapInPandas(sketches, "doc_id long, sketch array<string>")
