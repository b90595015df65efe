"""Operators 1, 3 and 8 against the libraries that define them."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from oreline.llm import bpe, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIK = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ENCODER = bpe.TextEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, remember=500)
PARTS = st.sampled_from(["a", "ab", "the", " ", "  ", "\n", "\t", "1", "é", "!", "'s", "aaaa", "xyxyxy", "\U0001f600", "漢字", "▁", "　", "\x1c", "<s>"])


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=40).map("".join)), max_size=8))
def test_replay_is_the_library(texts):
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)]
    assert [ids(x) for x in ENCODER.encode(texts)] == [TIK.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join))
def test_chunk_counts_add_up(text):
    if token_counts.plain(text):
        assert sum(map(len, SP.encode(text.split(" ")))) == len(SP.encode(text))


def test_merges_that_wait_for_lower_ranks():
    # pair ab has rank 5; xab, which abx-like repeats form, has a lower one
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 5, b"aba": 3, b"abab": 4}
    own = bpe.MergeReplay(ranks)
    lib = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for w in (b"abab", b"ababab", b"aababab", b"abababababa"):
        got, starts = own.encode([b"zz", w])
        assert got[starts[1] :].tolist() == lib.encode_ordinary(w.decode())


def test_long_words():
    for t in ("a" * 30_000, "xy" * 10_000, " " * 3_000 + "x", "abcabcabd" * 2_000):
        assert ids(ENCODER.encode([t])[0]) == TIK.encode_ordinary(t)


def test_caches_are_bounded_in_bytes(spark):
    """Many long texts without spaces and many short words: whole results, small caches."""
    rng = np.random.default_rng(6)
    long = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 4_000))) for _ in range(60)]
    short = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 4_000)) for _ in range(6)]
    own = bpe.TextEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, remember=2_000_000)
    for texts in (long[:30], short[:3], long[30:], short[3:]):
        assert [ids(x) for x in own.encode(texts)] == [TIK.encode_ordinary(t) for t in texts]
        assert own.held <= 2_000_000 and all(len(x) <= own.LONGEST for x in [*own.spaced, *own.bare])
    docs = spark.createDataFrame(list(enumerate(long + short)), "doc_id bigint, text string")
    out = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), remember=100_000).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: len(SP.encode(t)) for i, t in enumerate(long + short)}


def test_library_where_the_file_asks_for_it(tmp_path):
    """A file whose special tokens strip, or another pattern, goes through the library itself."""
    import json

    spec = json.load(open(P.path("byte_bpe_50k.json")))
    spec["added_tokens"][0]["lstrip"] = True
    path = str(tmp_path / "strip.json")
    json.dump(spec, open(path, "w"))
    for file, pattern in ((path, P.PATTERN), (P.path("byte_bpe_50k.json"), r"\S+|\s+"), (P.path("byte_bpe_50k.json"), P.PATTERN)):
        lib = Tokenizer.from_file(file)
        for t in ("two words  <|endoftext|> more", "it's 12 o'clock"):
            assert packing.token_encoder(file, pattern)(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encode_decode_of_odd_rows(odd_docs):
    out = bpe.encode_decode(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter()
    for r in odd_docs.collect():
        t = r["text"] or ""
        i = TIK.encode_ordinary(t)
        want[(r["doc_id"], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r[:4]) for r in out) == want
    assert all(bytes(r["decoded"]) == TIK.decode_bytes(r["ids"]) for r in out)


def test_token_counts_of_odd_rows(odd_docs):
    out = token_counts.count_tokens(odd_docs, P.path("piece_bpe_32k.model"), limit=30, frequent=5, remember=20).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(SP.encode(r["text"] or "")), n > 30) for r in odd_docs.collect())
    assert Counter(map(tuple, out)) == want


def check_packing(rows, docs, capacity=2048):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = Counter()
    for r in docs:
        own = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        n = -(-len(own) // capacity)
        head = len(own) - capacity * (n - 1)
        for k in range(n):
            a, b = (0, head) if k == 0 else (head + capacity * (k - 1), head + capacity * k)
            pieces[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_odd_rows(odd_docs):
    out = packing.pack_documents(odd_docs, P.path("byte_bpe_50k.json"), P.PATTERN, per_partition=4).collect()
    check_packing(out, odd_docs.collect())


def test_packing_is_tight(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, per_partition=64).collect()
    bins = check_packing(out, docs.collect())
    lengths = np.array([r["length"] for r in out])
    assert packing.lower_bound(lengths, 2048) <= bins <= packing.lower_bound(lengths, 2048) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bounds_hold(lengths):
    """No bound is above the fewest bins, found by trying all assignments."""
    x = np.array(lengths)

    def fits(i, rooms):
        if i == len(order):
            return True
        tried = set()
        for k, r in enumerate(rooms):
            if r >= order[i] and r not in tried:
                tried.add(r)
                if fits(i + 1, [*rooms[:k], r - order[i], *rooms[k + 1 :]]):
                    return True
        return False

    order = sorted(lengths, reverse=True)
    fewest = next(n for n in range(1, len(lengths) + 1) if fits(0, [12] * n))
    bins, _, count = packing.best_fit_decreasing(x, 12)
    assert packing.lower_bound(x, 12) <= fewest <= count
    assert np.bincount(bins, weights=x).max() <= 12


@pytest.mark.parametrize("name", ["bpe", "counts", "packing"])
def test_empty_table(no_docs, name):
    run = {
        "bpe": lambda: bpe.encode_decode(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "counts": lambda: token_counts.count_tokens(no_docs, P.path("piece_bpe_32k.model")),
        "packing": lambda: packing.pack_documents(no_docs, P.path("byte_bpe_50k.json"), P.PATTERN),
    }[name]
    assert run().count() == 0
