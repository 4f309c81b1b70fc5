"""Line deduplication with two Bloom filters: once seen and twice seen.

Documents are read once for the digests of their long lines. The digests fill two filters, once seen and twice seen, which are cut into
segments by hash: each batch of documents sends a segment four bytes per line, and a segment merges its batches one by one, so a line of
two batches, or twice in one, sets its bits in the second filter: (once, twice) + (once', twice') = (once or once', twice or twice' or
(once and once')). Lines whose bits are all set there are suspected repeats; only they shuffle, as digest and id, to be counted exactly
and to find the document that keeps the line.

The filters have 16 bits per line up to ``MOST_BITS``, which bounds the memory of a task; beyond that more lines are suspected, none fewer,
and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.llm.common import kept_in_worker, open_store, run_folder
from ratewright.sources.tables import written

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
DIGEST = 16
PAIRS_PER_ROW = 1 << 16
SEGMENT_BITS = 1 << 18
BITS_PER_LINE = 16
MOST_BITS = 1 << 31
PROBES = 4
HOT_KEYS = 20_000


def line_keys(text: str) -> list[bytes]:
    """The key of every line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(WHITE).lower() for line in text.encode("utf-8").split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points; a code point has one to four bytes."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8")) >= least)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def line_digests(documents: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Packed rows (digests binary, ids binary): the distinct long lines of every document with an id, many documents to a row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests, ids, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                mine = {digest(key) for key in line_keys(text) if long_enough(key, least)}
                digests.extend(mine)
                ids.append(np.full(len(mine), doc_id, "<i8"))
                held += len(mine)
                if held >= PAIRS_PER_ROW:
                    yield pd.DataFrame({"digests": [b"".join(digests)], "ids": [np.concatenate(ids).tobytes()]})
                    digests, ids, held = [], [], 0
        if held:
            yield pd.DataFrame({"digests": [b"".join(digests)], "ids": [np.concatenate(ids).tobytes()]})

    named = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return named.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).mapInPandas(pack, "digests binary, ids binary")


def halves(packed: bytes) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(packed, "<u8").reshape(-1, 2)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes[:, 0] >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def probes(short: np.ndarray) -> np.ndarray:
    """The bits of each line inside its segment, from 32 bits of its digest."""
    wide = short.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier
    step = (wide >> np.uint64(40)) | np.uint64(1)
    return (short[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)


def seen_twice(messages: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The twice-seen filter of one segment, bit by bit, from (lines, those of them found more than once) of each batch."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for lines, again in messages:
        bits = probes(np.frombuffer(lines, "<u4").astype(np.uint64)).ravel()
        twice[bits[once[bits]]] = True
        once[bits] = True
        twice[probes(np.frombuffer(again, "<u4").astype(np.uint64)).ravel()] = True
    return twice


def segment_messages(packed: DataFrame, segments: int) -> DataFrame:
    """segment, lines, again: what each packed row adds to each segment, four bytes per distinct line."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["digests"]:
                hashes, n = np.unique(halves(raw), axis=0, return_counts=True)
                segment = segment_of(hashes, segments)  # ascending, as the digests are
                order = np.argsort(segment, kind="stable")
                segment, short, many = segment[order], hashes[order, 1].astype("<u4"), n[order] > 1
                starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(segments)))
                ends = np.append(starts[1:], len(segment))
                yield pd.DataFrame(
                    {
                        "segment": segment[starts].astype(np.int32),
                        "lines": [short[a:b].tobytes() for a, b in zip(starts, ends)],
                        "again": [short[a:b][many[a:b]].tobytes() for a, b in zip(starts, ends)],
                    }
                )

    return packed.select("digests").mapInPandas(send, "segment int, lines binary, again binary")


def twice_seen(packed: DataFrame, segments: int, folder: str) -> None:
    """Write the twice-seen filter, one row per segment, below ``folder``."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        twice = seen_twice(list(zip(rows["lines"], rows["again"])))
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [np.packbits(twice).tobytes()]})

    segment_messages(packed, segments).groupBy("segment").applyInPandas(merge, "segment int, bits binary").write.parquet(folder)


def read_filter(folder: str, segments: int) -> np.ndarray:
    """The written filter as packed bits, one row per segment; a segment nobody wrote is empty."""
    import pyarrow.dataset as ds

    store, path = open_store(folder)
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    files = [f for f in ds.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False).files]
    for batch in ds.dataset(files, filesystem=store, format="parquet").to_batches(columns=["segment", "bits"], batch_size=64) if files else ():
        for segment, bits in zip(batch["segment"].to_pylist(), batch["bits"]):
            out[segment] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def suspects(packed: DataFrame, segments: int, folder: str) -> DataFrame:
    """high, low (the digest), doc_id of the lines whose bits are all set in the twice-seen filter."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = kept_in_worker("twice-seen lines", dict)
        if folder not in held:  # a worker holds one filter at a time
            held.clear()
            held[folder] = read_filter(folder, segments)
        bits = held[folder]
        for batch in batches:
            for digests, ids in zip(batch["digests"], batch["ids"]):
                hashes = halves(digests)
                segment = segment_of(hashes, segments)[:, None]
                at = probes(hashes[:, 1].astype("<u4").astype(np.uint64))
                found = (bits[segment, at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
                hit = found.all(axis=1)
                signed = hashes[hit].view("<i8")
                yield pd.DataFrame({"high": signed[:, 0], "low": signed[:, 1], "doc_id": np.frombuffer(ids, "<i8")[hit]})

    return packed.mapInPandas(look_up, "high long, low long, doc_id long")


def lost_lines(documents: DataFrame, id_col: str, text_col: str, least: int, least_documents: int) -> DataFrame:
    """doc_id, lost (digests): the lines each document loses, by exact counts."""
    spark = documents.sparkSession
    packed = written(line_digests(documents, id_col, text_col, least))
    n = packed.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    segments = int(min(max(1, -(-n * BITS_PER_LINE // SEGMENT_BITS)), MOST_BITS // SEGMENT_BITS))
    folder = run_folder(spark, "twice-seen-lines")
    twice_seen(packed, segments, folder)
    pairs = written(suspects(packed, segments, folder).distinct())
    counts = pairs.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    repeated = written(counts.where(F.col("n") >= least_documents))
    # A line of very many documents would be one task of the join below. Those with more than a 20,000th of all pairs are fewer than
    # 20,000, whatever the size of the table, so they are broadcast.
    bound = pairs.count() / HOT_KEYS
    hot, cold = F.broadcast(repeated.where(F.col("n") > bound)), repeated.where(F.col("n") <= bound)
    line = ["high", "low"]
    cool = pairs.join(hot, line, "left_anti").join(cold, line)
    gone = pairs.join(hot, line).unionByName(cool).where(F.col("doc_id") < F.col("keeper"))
    return written(gone.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("lost")))


CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(CUT)
def cut_lines(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
    """A text without its lost lines; rows without lost lines pass nothing and get nothing."""
    out = []
    for whole, gone in zip(text, lost):
        if whole is None or gone is None:
            out.append((None, 0))
            continue
        gone = {np.array([row["high"], row["low"]], "<i8").tobytes() for row in gone}
        lines = whole.split("\n")
        kept = [line for line, key in zip(lines, line_keys(whole)) if digest(key) not in gone]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_dropped"])


def without_repeated_lines(
    documents: DataFrame,
    least: int = 40,
    least_documents: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    into: str = "lines",
) -> DataFrame:
    """``documents`` with shortened texts and a struct ``into`` (n_lines before, n_dropped).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``least`` code points found in at least
    ``least_documents`` documents lose all their lines but those of the largest id that holds them, where every one stays. NULL texts
    count as empty, and an empty text is one empty line; a text that loses all lines is empty. Rows that repeat an id are one document.
    Rows without an id neither count as documents nor lose lines. An empty table gives an empty result; other columns are kept, a column
    called like ``into`` is replaced.
    """
    lost = lost_lines(documents, id_col, text_col, least, least_documents)
    lost = lost.select(F.col("doc_id").alias("__line_owner"), F.col("lost").alias("__lost_lines"))
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    # The texts shuffle once by id at every size; a table of lost lines small enough to be broadcast is no reason for another plan.
    joined = documents.withColumn(text_col, text).join(lost.hint("merge"), documents[id_col].cast("long") == lost["__line_owner"], "left")
    cut = cut_lines(F.when(F.col("__lost_lines").isNotNull(), F.col(text_col)), F.col("__lost_lines"))
    found = joined.withColumn("__cut", cut)
    n_lines = (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long")
    counted = found.withColumn(into, F.struct(n_lines.alias("n_lines"), F.col("__cut.n_dropped").alias("n_dropped")))
    shortened = counted.withColumn(text_col, F.coalesce(F.col("__cut.text"), F.col(text_col)))
    return shortened.drop("__line_owner", "__lost_lines", "__cut")
