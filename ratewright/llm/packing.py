"""Packing by lexical retrieval: neighbours of a seed document by BM25 fill the rest of its sequence.

Terms are token ids, so document frequencies are one vector as long as the vocabulary and come from all documents. Documents are dealt to
shards by their most telling term, so that documents with the same rare terms meet; a term that many documents share is salted. A
shard holds ``SHARD_TOKENS`` tokens at most and has its own inverted index with the corpus's statistics. Documents may be cut
anywhere: sequences are full, and what is left of a shard becomes sequences of a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import crc_of_ids, kept_in_worker
from ratewright.llm.tokens import MOST_CHUNKS, MOST_PIECES, TextEncoder
from ratewright.sources.tables import written

LENGTH = 2048
SHARD_TOKENS = 2_000_000
DOCUMENTS_PER_SALT = 500
QUERY_TERMS = 8
NEIGHBOURS = 16
K1, B = 1.2, 0.75


def tokenized(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, remembered: tuple[int, int]) -> DataFrame:
    """doc_id, n_tokens, ids (packed 32- or 16-bit unsigned) of every whole text, ``end_id`` last; NULL counts as empty.

    ``seen`` on one row of each batch holds, as packed pairs (id, n), how many documents of the batch have each id.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_in_worker(f"tokens {tokenizer_path} {remembered}", lambda: TextEncoder(tokenizer_path, remembered))
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            if not len(batch):
                continue
            ids = [encoder.encode(text) + end for text in batch["text"]]
            n = [len(raw) // encoder.dtype.itemsize for raw in ids]
            counts = np.bincount(np.concatenate([np.unique(np.frombuffer(raw, encoder.dtype)) for raw in ids]))
            present = np.flatnonzero(counts)
            seen = np.column_stack([present, counts[present]]).astype("<i8").tobytes()
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids": ids, "seen": [seen] + [None] * (len(ids) - 1)})

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return keyed.mapInPandas(encode, "doc_id long, n_tokens long, ids binary, seen binary")


def document_frequencies(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """Number of documents with each id, from the counts of the batches; as long as the vocabulary."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["seen"]:
                pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
                yield pd.DataFrame({"term": pairs[:, 0], "n": pairs[:, 1]})

    counted = tokens.select("seen").where(F.col("seen").isNotNull()).mapInPandas(unpack, "term long, n long")
    total = counted.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_ids, np.int64)
    out[total["term"].to_numpy(np.int64)] = total["n"]
    return out


class Shard:
    """Documents of one shard with a BM25 inverted index over them."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.ids = ids
        n = len(ids)
        terms, docs, weights, self.queries = [], [], [], []
        for k, tokens in enumerate(ids):
            term, tf = np.unique(tokens, return_counts=True)
            weight = idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / mean_length)))
            top = np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS] if len(weight) > QUERY_TERMS else slice(None)
            self.queries.append(term[top])
            terms.append(term)
            docs.append(np.full(len(term), k))
            weights.append(weight)
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = np.concatenate(docs)[order], np.concatenate(weights)[order].astype(np.float32)
        self.begins = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused = np.ones(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents by falling BM25 score for the seed's most telling terms."""
        score = np.zeros(len(self.unused), np.float32)
        for term in self.queries[seed]:
            at = slice(self.begins[term], self.begins[term + 1])
            score[self.docs[at]] += self.weights[at]
        score *= self.unused
        best = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if len(score) > NEIGHBOURS else np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def pack(shard: Shard, length: int = LENGTH) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); all but the last few are full."""
    ids, unused = shard.ids, shard.unused
    following, pending = 0, None  # pending: (document, first id not yet placed)
    while True:
        if pending is None:
            while following < len(ids) and not unused[following]:
                following += 1
            if following == len(ids):
                return
            pending = following, 0
            unused[following] = False
        seed, start = pending
        left = len(ids[seed]) - start
        while left >= length:
            yield [(seed, start, length)]
            start, left = start + length, left - length
        pending = None
        if not left:
            continue
        pieces, room = [(seed, start, left)], length - left
        while room:
            near = shard.neighbours(seed)
            if not len(near):  # nothing shares a telling term: the next unused documents in order
                while following < len(ids) and not unused[following]:
                    following += 1
                near = np.array([following] if following < len(ids) else [], np.int64)
            for k in near:
                if not room:
                    break
                unused[k] = False
                put = min(room, len(ids[k]))
                pieces.append((int(k), 0, put))
                room -= put
                if put < len(ids[k]):
                    pending = int(k), put
            if not len(near):
                break
        if not room:
            yield pieces
            continue
        yield from in_powers_of_two(pieces)


def in_powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a sequence that cannot be filled, cut into sequences of falling powers of two."""
    total = sum(n for _, _, n in pieces)
    waiting = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, sequence = total & (1 << bit), []
        while room:
            doc, start, n = waiting.pop()
            put = min(room, n)
            sequence.append((doc, start, put))
            room -= put
            if put < n:
                waiting.append((doc, start + put, n - put))
        if sequence:
            yield sequence


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: tuple[int, int] = (MOST_CHUNKS, MOST_PIECES),
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, or of a smaller power of two at the end of a shard.

    Every id of every document lies in exactly one piece; no sequence needs padding. NULL and empty texts are their end id alone. Rows with
    the same id, or none, are packed each for itself. An empty table gives an empty result; other columns are ignored. ``remembered`` bounds
    the memory of the encoder (chunks and pieces of a generation); it changes the time, not the result.
    """
    encoder = TextEncoder(tokenizer_path)
    dtype, n_ids = encoder.dtype.str, 1 << (8 * encoder.dtype.itemsize) if encoder.dtype.itemsize == 2 else 1 << 20
    tokens = written(tokenized(documents, tokenizer_path, end_id, id_col, text_col, remembered))
    totals = tokens.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    n_documents, mean_length = totals["n"], max(1.0, (totals["tokens"] or 0) / max(1, totals["n"]))
    frequency = document_frequencies(tokens, n_ids)
    idf = np.log1p((n_documents - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    idf[end_id] = 0
    salts = np.maximum(1, frequency // DOCUMENTS_PER_SALT)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            telling = []
            for doc_id, raw in zip(batch["doc_id"], batch["ids"]):
                ids = np.frombuffer(raw, dtype)
                place = int(idf[ids].argmax())
                term = int(ids[place])
                telling.append(term * 65_536 + hash((0 if pd.isna(doc_id) else int(doc_id)) * 2_654_435_761 >> 7) % int(salts[term]))
            batch["topic"] = telling
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        numbers = iter(range(context.partitionId() << 36, (context.partitionId() + 1) << 36))
        keys, ids, held = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"], batch["ids"]):
                keys.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(np.frombuffer(raw, dtype))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield pieces_of(keys, ids, numbers)
                    keys, ids, held = [], [], 0
        if ids:
            yield pieces_of(keys, ids, numbers)

    def pieces_of(keys: list[int | None], ids: list[np.ndarray], numbers: Iterator[int]) -> pd.DataFrame:
        rows = []
        for sequence in pack(Shard(ids, idf, mean_length), length):
            number, offset = next(numbers), 0
            for k, start, n in sequence:
                rows.append((keys[k], start, n, crc_of_ids(ids[k][start : start + n]), len(ids[k]), number, offset))
                offset += n
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    n_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.select("doc_id", "ids").mapInPandas(route, "doc_id long, ids binary, topic long")
    return dealt.repartition(n_parts, "topic").sortWithinPartitions("topic", "doc_id", "ids").mapInPandas(fill, PIECES)
