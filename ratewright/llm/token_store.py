"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

``write_store`` writes three things below one folder of the shared store:

* payload shards (``tokens-*.bin``): nothing but ids, little-endian unsigned 16 or 32 bits, in ascending key order over all
  shards;
* a directory (Parquet, by Spark's committer): one row per document with its shard and place, and one row per shard;
* index shards (``index-*.mph``): a key's hash names its index shard, a displacement table sends the key to its own slot without
  collisions or gaps, and the slot holds a 32-bit fingerprint of the key and its shard, offset and length.

A lookup costs one displacement, one slot and one range read, whatever the number of documents. The fingerprint turns keys that
were never stored into misses (but for one in 2^32).

Tasks name their files freshly, and the directory that Spark commits lists only the files of tasks that succeeded: a task that
is lost and run again, or run twice, leaves an unlisted file and nothing else.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import crc_of_ids, kept_in_worker, open_store, run_folder
from ratewright.llm.tokens import TextEncoder

SHARD_TOKENS = 1 << 26
KEYS_PER_INDEX = 50_000
KEYS_PER_BUCKET = 3
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: splitmix64


@dataclass(frozen=True)
class Store:
    """A written store: its folder and its two directories."""

    folder: str
    documents: DataFrame  # doc_id, copy, shard, offset, n_tokens
    shards: DataFrame  # shard, file, n_tokens, start
    indexes: DataFrame  # bucket, file
    n_buckets: int
    dtype: str


# minimal perfect hash of the keys of one index shard


def mix(x: np.ndarray) -> np.ndarray:
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def places(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + displacement * MIX[0]) % np.uint64(n)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Displacement by bucket for distinct 64-bit hashes; a negative one is a slot itself (-1 - slot)."""
    n = len(hashes)
    n_buckets = n // KEYS_PER_BUCKET + 1
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n_buckets)
    begins = np.concatenate([[0], np.cumsum(counts)])
    displacements, taken = np.zeros(n_buckets, np.int64), np.zeros(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] < 2:
            break
        keys, step, tries = hashes[order[begins[b] : begins[b + 1]]], 0, 32
        while True:
            trial = np.arange(step, step + tries, dtype=np.uint64)
            slots = places(keys[None, :], trial[:, None], n)
            good = ~taken[slots].any(axis=1)
            if good.any():
                inner = np.sort(slots, axis=1)
                good &= (inner[:, 1:] != inner[:, :-1]).all(axis=1)
            if good.any():
                chosen = int(np.argmax(good))
                displacements[b] = step + chosen
                taken[slots[chosen]] = True
                break
            step, tries = step + tries, min(tries * 2, 4096)
    alone, free = np.flatnonzero(counts == 1), np.flatnonzero(~taken)
    displacements[alone] = -1 - free[: len(alone)]
    return displacements


def slots_of(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    moved = displacements[(hashes % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(moved < 0, -1 - moved, places(hashes, np.maximum(moved, 0).astype(np.uint64), n))


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def index_bytes(hashes: np.ndarray, prints: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """An index shard: number of keys and buckets, displacements, slots."""
    moved = perfect_hash(hashes)
    table = np.zeros(len(hashes), SLOT)
    at = slots_of(hashes, moved, len(hashes))
    table["fingerprint"][at], table["shard"][at], table["offset"][at], table["length"][at] = prints, shard, offset, length
    return np.array([len(hashes), len(moved)], "<u8").tobytes() + moved.astype("<i8").tobytes() + table.tobytes()


class Index:
    """A read index shard; ``find`` answers many keys at once, each in constant time."""

    def __init__(self, raw: bytes):
        self.n, n_buckets = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        self.moved = np.frombuffer(raw, "<i8", n_buckets, 16)
        self.table = np.frombuffer(raw, SLOT, self.n, 16 + 8 * n_buckets)

    def find(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slot records)."""
        if not self.n:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), SLOT)
        rows = self.table[slots_of(hashes, self.moved, self.n)]
        return rows["fingerprint"] == prints, rows


def _hashes(df: DataFrame, n_buckets: int) -> DataFrame:
    """Adds the key's slot hash, its fingerprint (from an independent hash) and its index shard."""
    other = F.xxhash64(F.lit("fingerprint"), "doc_id", "copy")
    return df.withColumns(
        {
            "hash": F.xxhash64("doc_id", "copy"),
            "print": other.bitwiseAND(F.lit(0xFFFFFFFF)),
            "bucket": F.pmod(F.shiftright(other, 32), F.lit(n_buckets)).cast("int"),
        }
    )


# writing


def write_store(
    documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> Store:
    """Encode every whole text (NULL: empty), append ``end_id``, and write shards, directory and index.

    One range partitioning by key; texts are encoded after it, streamed to the files, and never held as a whole. Rows with the
    same key are stored one after the other and told apart by ``copy`` (0, 1, ...); a NULL key sorts first and is a key too. An
    empty table gives a store without shards. Columns other than the two named are ignored.
    """
    spark = documents.sparkSession
    folder = run_folder(spark, "tokens")
    dtype = TextEncoder(tokenizer_path).dtype.str

    def to_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_in_worker(f"tokens {tokenizer_path}", lambda: TextEncoder(tokenizer_path))
        end = np.array([end_id], encoder.dtype).tobytes()
        files, base = open_store(folder)
        out, name, written, sequence = None, "", 0, -1
        before, copy = object(), 0
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                key = None if pd.isna(key) else int(key)
                copy = copy + 1 if key == before else 0
                before = key
                if out is None or written >= shard_tokens:
                    if out is not None:
                        out.close()
                    sequence, written, name = sequence + 1, 0, f"tokens-{uuid.uuid4().hex}.bin"
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}")
                raw = encoder.encode(text) + end
                out.write(raw)
                n = len(raw) // encoder.dtype.itemsize
                rows.append((key, copy, name, sequence, written, n))
                written += n
            part = pd.DataFrame(rows, columns=["doc_id", "copy", "file", "sequence", "offset", "n_tokens"])
            part["doc_id"] = part["doc_id"].astype("Int64")
            yield part
        if out is not None:
            out.close()

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keyed.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed = in_order.mapInPandas(to_files, "doc_id long, copy long, file string, sequence int, offset long, n_tokens long")
    placed.withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")

    per_file = placed.groupBy("file", "part", "sequence").agg(F.sum("n_tokens").alias("n_tokens"))
    so_far = Window.orderBy("part", "sequence")  # over one row per shard file
    shards = per_file.select(
        (F.row_number().over(so_far) - 1).cast("long").alias("shard"),
        "file",
        "n_tokens",
        (F.sum("n_tokens").over(so_far) - F.col("n_tokens")).alias("start"),
    )
    shards.write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    directory = placed.join(shards.select("file", "shard"), "file").select("doc_id", "copy", "shard", "offset", "n_tokens")
    n_buckets = max(1, -(-placed.count() // KEYS_PER_INDEX))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        files, base = open_store(folder)
        name = f"index-{uuid.uuid4().hex}.mph"
        raw = index_bytes(
            group["hash"].to_numpy(np.int64).view(np.uint64), group["print"].to_numpy(), group["shard"].to_numpy(), group["offset"].to_numpy(), group["n_tokens"].to_numpy()
        )
        with files.open_output_stream(f"{base}/{name}") as out:
            out.write(raw)
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "file": [name]})

    hashed = _hashes(directory, n_buckets).select("bucket", "hash", "print", "shard", "offset", "n_tokens")
    hashed.groupBy("bucket").applyInPandas(build, "bucket int, file string").write.parquet(f"{folder}/indexes")
    return Store(folder, directory, shards, spark.read.parquet(f"{folder}/indexes"), n_buckets, dtype)


# reading


def find(store: Store, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, offset, n_tokens) of the keys (doc_id, copy) that the index holds."""
    folder = store.folder

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_store(folder)
        opened, index = None, None
        for batch in batches:
            for name, group in batch.groupby("file", sort=False):
                if name != opened:
                    with files.open_input_file(f"{base}/{name}") as source:
                        index, opened = Index(source.read()), name
                found, rows = index.find(group["hash"].to_numpy(np.int64).view(np.uint64), group["print"].to_numpy())
                group = group[found]
                rows = rows[found]
                yield pd.DataFrame(
                    {
                        "doc_id": group["doc_id"].astype("Int64").to_numpy(),
                        "copy": group["copy"].to_numpy(),
                        "shard": rows["shard"].astype(np.int64),
                        "offset": rows["offset"].astype(np.int64),
                        "n_tokens": rows["length"].astype(np.int64),
                    }
                )

    asked = _hashes(keys.select("doc_id", "copy"), store.n_buckets).join(store.indexes, "bucket")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select("file", "doc_id", "copy", "hash", "print").repartition(n, "file").sortWithinPartitions("file")
    return asked.mapInPandas(look_up, "doc_id long, copy long, shard long, offset long, n_tokens long")


def fetch(store: Store, keys: DataFrame, digest_only: bool = False) -> DataFrame:
    """The stored ids of the keys: doc_id, copy, start, n_tokens, ids_crc32 and, unless ``digest_only``, ids."""
    folder, dtype = store.folder, np.dtype(store.dtype)
    size = dtype.itemsize

    def payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_store(folder)
        opened, source = None, None
        for batch in batches:
            crcs, ids = [], []
            for name, offset, n in zip(batch["file"], batch["offset"], batch["n_tokens"]):
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened = io.BufferedReader(files.open_input_file(f"{base}/{name}"), 1 << 20), name
                source.seek(offset * size)
                row = np.frombuffer(source.read(n * size), dtype)
                crcs.append(crc_of_ids(row))
                if not digest_only:
                    ids.append(row.astype(np.int64))
            out = batch[["doc_id", "copy", "start", "n_tokens"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["ids_crc32"] = np.array(crcs, np.int64)
            if not digest_only:
                out["ids"] = ids
            yield out
        if source is not None:
            source.close()

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = find(store, keys).join(store.shards.select("shard", "file", F.col("start").alias("before")), "shard")
    where = where.select("file", "doc_id", "copy", "offset", "n_tokens", (F.col("before") + F.col("offset")).alias("start"))
    schema = "doc_id long, copy long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    return where.repartition(n, "file").sortWithinPartitions("file", "offset").mapInPandas(payloads, schema)
