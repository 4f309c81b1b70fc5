"""Token shards, tree-joined encoding, packing: against the libraries, and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ratewright.llm import bpe, packing, token_store
from ratewright.llm.tokens import TextEncoder

BYTES, WORDS = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "ß", "İ", "́", "<|endoftext|>", "世界", " ", "\x1c", "Σ", "don't", "🎉", "\xa0", "É"]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunked_encoding_equals_the_library(path):
    encoder, want = TextEncoder(path), library(path)
    for text in fuzz(2000):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want(text), repr(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("shard_tokens", [1 << 26, 500])
def test_store_returns_every_document(awkward, awkward_rows, shard_tokens):
    store = token_store.write_store(awkward, BYTES, end_id=0, shard_tokens=shard_tokens)
    got = token_store.fetch(store, store.documents).collect()
    encode, start, want = library(BYTES), 0, []
    for doc_id, text in sorted(((i, t) for i, t, _ in awkward_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(text) + [0]
        want.append((doc_id, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got), key=lambda r: r[1]) == want
    assert (store.shards.count() > 5) == (shard_tokens == 500)


def test_unknown_keys_are_not_found(spark, awkward):
    store = token_store.write_store(awkward, BYTES, end_id=0)
    keys = spark.createDataFrame([(7, 0), (5, 1), (5, 2), (987654321, 0)], "doc_id long, copy long")
    assert sorted((r.doc_id, r.copy) for r in token_store.find(store, keys).collect()) == [(5, 1), (7, 0)]


def test_empty_store(nothing):
    store = token_store.write_store(nothing, BYTES, end_id=0)
    assert token_store.fetch(store, store.documents).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_perfect_hash_has_no_collision_and_no_gap(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    slots = token_store.slots_of(hashes, token_store.perfect_hash(hashes), len(hashes)) if n else np.zeros(0, int)
    assert sorted(slots) == list(range(len(hashes)))


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf_bytes", [1, 4, 32])
def test_tree_equals_direct_merging(tik, leaf_bytes):
    codec = bpe.TreeCodec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, leaf_bytes=leaf_bytes)
    rng = random.Random(5)
    texts = fuzz(500, 2) + ["".join(rng.choice("aabcdeéthein") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for text in [*texts, "a" * 3000, "!" * 3000, "世" * 1000, "1" * 999]:
        said, ids = codec.encode_text(text)
        assert ids == tik.encode_ordinary(text) and said == ",".join(map(str, ids))
        assert codec.decode(ids) == text.encode()


def test_join_is_associative_with_a_unit(tik):
    codec = bpe.TreeCodec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    a, b, c = (codec.encode_piece(part.encode()) for part in ("interna", "tionali", "sation"))
    assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == tik.encode_ordinary("internationalisation")
    assert codec.join([], a) == codec.join(a, []) == a


def test_round_trip(awkward, awkward_rows, nothing, tik):
    got = bpe.round_trip(awkward, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, _ in awkward_rows:
        ids = tik.encode_ordinary(text or "")
        digests = (hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode()))
        want.append((doc_id, len(ids), *digests))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    few = awkward.where("doc_id in (202, 207)")
    assert {r.doc_id: r.ids for r in bpe.encoded(few, RANKS, public_tokenizers.PATTERN).collect()} == {202: [], 207: tik.encode_ordinary("word")}


def test_packing_places_every_id_once_without_padding(awkward, awkward_rows, nothing):
    rows = packing.packed(awkward, WORDS, end_id=1).collect()
    encode, want = library(WORDS), Counter()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for sequence in sequences.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    names = Counter(i for i, _, _ in awkward_rows)
    for doc_id, text, _ in awkward_rows:
        ids = encode(text) + [1]
        if doc_id is None or names[doc_id] > 1:
            want[doc_id] += len(ids)
            continue
        at = 0
        for r in sorted(pieces[doc_id, len(ids)], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for name, n in want.items():
        assert sum(r.length for r in rows if r.doc_id == name) == n
    assert packing.packed(nothing, WORDS, end_id=1).count() == 0


def test_neighbours_share_telling_terms():
    idf = np.zeros(100, np.float32)
    idf[10:] = 1 + np.arange(90) / 100
    docs = [[20, 21, 22], [50, 51, 52], [20, 21, 99], [50, 51, 60], [30]]
    shard = packing.Shard([np.array(d) for d in docs], idf, 3.0)
    assert list(shard.neighbours(0)) == [0, 2]
    shard.unused[0] = False
    assert list(shard.neighbours(0)) == [2] and list(shard.neighbours(1)) == [1, 3]
    first = next(packing.pack(packing.Shard([np.array(d) for d in docs], idf, 3.0), length=4))
    assert [d for d, _, _ in first] == [0, 2]


def test_a_window_is_filled_with_neighbours_of_its_seed():
    """More neighbours than one list holds are asked of the seed again, not of the document packed last."""
    idf = np.zeros(400, np.float32)
    idf[10:] = 1.0
    seed, kin, lure = [20] * 3, [[20, 100 + i] for i in range(packing.NEIGHBOURS + 4)], [100 + packing.NEIGHBOURS - 1, 300]
    docs = [np.array(d) for d in (seed, lure, *kin)]
    first = next(packing.pack(packing.Shard(docs, idf, 2.0), length=3 + 2 * len(kin)))
    assert sorted(d for d, _, _ in first) == [0, *range(2, 2 + len(kin))]
