"""Byte-level BPE as a monoid: the ids of a text are joined from the ids of its halves.

A piece of text (one match of the splitting pattern) is a leaf when short and is merged directly, lowest rank first. A longer
piece is halved, both halves are encoded, and the two lists are joined: the tokens next to the seam are decoded, encoded
again together, and the window grows until the tokens outside it provably keep their places. The proof is pairwise: a
list of tokens is the encoding of its bytes exactly when every two neighbours are the encoding of theirs. Neighbours
inside either half and inside the window hold already, so only the two pairs at the window's ends are tested.

Joining is associative with the empty list as its unit, so any tree over the bytes gives the same ids. Decoding
concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame

from ratewright.llm.common import kept_in_worker

LEAF_BYTES = 32
LONG_LEAF = 256
NEVER = 1 << 60
LEAF_TOKENS = 4096
FIRST_WINDOW = 2
MOST_PIECES = 300_000
LONGEST_KEPT = 100


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) by token, from a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Pieces(dict):
    """(ids as comma-joined text, ids) by piece; forgets everything when full."""

    def __init__(self, codec: TreeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[str, list[int]]:
        ids = self.codec.encode_piece(piece.encode("utf-8"))
        known = ",".join(map(str, ids)), ids
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = known
        return known


class TreeCodec:
    """Encode and decode bytes by ranks; ``encode_text`` splits a text by the pattern first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.leaf_bytes = leaf_bytes
        self.pieces = _Pieces(self)
        self.pairs: dict[tuple[int, int], bool] = {}

    # encoding

    def encode_leaf(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG_LEAF:
            return self._merge_by_heap(piece)
        rank_of, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pair_ranks = [rank_of(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pair_ranks:
            best = min(pair_ranks)
            if best == NEVER:
                break
            at = pair_ranks.index(best)
            merged = parts[at] + parts[at + 1]
            parts[at : at + 2] = [merged]
            del pair_ranks[at]
            if at < len(pair_ranks):
                pair_ranks[at] = rank_of(merged + parts[at + 1], NEVER)
            if at:
                pair_ranks[at - 1] = rank_of(parts[at - 1] + merged, NEVER)
        return [self.ranks[part] for part in parts]

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        """The same merges for a long window: pairs wait in a heap by (rank, place), parts form a linked list."""
        n = len(piece)
        parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank, i, 1, 1) for i in range(n - 1) if (rank := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(waiting)

        def propose(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (rank, i, len(parts[i]), len(parts[j])))

        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if j >= n or len(parts[i]) != left or len(parts[j]) != right:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(i)
            if before[i] >= 0:
                propose(before[i])
        return [self.ranks[part] for part in parts if part]

    def stands(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.encode_leaf(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) >= MOST_PIECES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left or right
        width = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.encode_leaf(self.decode(left[a:]) + self.decode(right[:b]))
            if (not a or self.stands(left[a - 1], middle[0])) and (b == len(right) or self.stands(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.encode_leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode_text(self, text: str | None) -> tuple[str, list[int]]:
        """(ids as comma-joined text, ids) of a text: each match of the pattern separately, in order."""
        if not text:
            return "", []
        known = [self.pieces[piece] for piece in self.pattern.findall(text)]
        return ",".join([said for said, _ in known]), list(chain.from_iterable([ids for _, ids in known]))

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated up a tree of halves."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids; one row per input row with digests of both.

    NULL and empty texts have no tokens (digests of nothing). Repeated rows give repeated rows, a NULL id stays NULL, an empty
    table gives an empty result, and other columns of any name are ignored. No shuffle: rows are read and mapped.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_in_worker(f"bpe {ranks_path} {pattern}", lambda: TreeCodec(read_ranks(ranks_path), pattern))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                said, ids = codec.encode_text(text)
                decoded = codec.decode(ids)
                rows.append((doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return keyed.mapInPandas(digests, ROUND_TRIP)


def encoded(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text as ``ids array<int>`` (empty for NULL); one row per input row, repeated rows included, none for an empty table."""

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_in_worker(f"bpe {ranks_path} {pattern}", lambda: TreeCodec(read_ranks(ranks_path), pattern))
        for batch in batches:
            batch["ids"] = [codec.encode_text(text)[1] for text in batch["text"]]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[["doc_id", "ids"]]

    keyed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return keyed.mapInPandas(ids_of, "doc_id long, ids array<int>")
