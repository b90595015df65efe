"""Operator 2 against all pairs, and its parts."""

import random

import numpy as np
import pytest
import xxhash

from oreline.llm import simhash
from oreline.llm.components import connected_components


def plain_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = [w for w in words.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, fp, most=5):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_fingerprints(odd_docs):
    for r in simhash.fingerprints(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["fp"] % (1 << 64) == plain_fingerprint(r["text"] or "")


def test_spark_hash_is_the_contract_s(spark):
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("split,blocks", [(1024, None), (4, None), (16, 6), (8, 7)])
def test_links_connect_what_all_pairs_connect(spark, split, blocks):
    rng = random.Random(split)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {near(rng, base) for _ in range(25)}
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    stars = connected_components(simhash.links(rows, split=split, blocks=blocks))
    root = {r["a"] % (1 << 64): r["b"] % (1 << 64) for r in stars.collect()}
    groups = {}
    for f, r in zip(fps, roots(fps), strict=True):
        groups.setdefault(r, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("kind", ["alike", "unlike"])
def test_a_bucket_of_100_000(spark, kind):
    """Alike rows (within 4 bits of one) and unlike ones that share a block, with planted pairs."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 63))
    if kind == "alike":
        fps = {base} | {base ^ sum(1 << int(b) for b in set(four)) for four in rng.integers(12, 64, (110_000, 4)).tolist()}
    else:
        fps = {int(x) << 12 | (base & 4095) for x in rng.integers(0, 1 << 51, 100_000)}
        fps |= {f ^ (1 << 40) ^ (1 << 63) for f in sorted(fps)[:50]}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp bigint")
    stars = connected_components(simhash.links(rows, blocks=5)).collect()
    if kind == "alike":
        assert len(stars) == len(fps) - 1 and len({r["b"] for r in stars}) == 1
    else:
        low = {r["a"] % (1 << 64): r["b"] % (1 << 64) for r in stars}
        planted = [(f, f ^ (1 << 40) ^ (1 << 63)) for f in sorted(fps) if f ^ (1 << 40) ^ (1 << 63) in fps]
        assert len(planted) >= 100 and all(low.get(a, a) == low.get(b, b) for a, b in planted)


def test_open_masks_cover_what_a_bucket_leaves_open():
    for _, spans in simhash.bucket_tables(6, 4):
        masks = [m % (1 << 64) for m in simhash.open_masks(spans, 4)]
        own = sum(((1 << w) - 1) << s for s, w in spans)
        assert len(masks) == 5 and sum(masks) + own == (1 << 64) - 1


@pytest.mark.parametrize("split", [4, 1024])
def test_similar_links_against_all_pairs(spark, split):
    rng = np.random.default_rng(split)
    rows = [rng.integers(0, 1 << 64, 4, dtype=np.uint64) for _ in range(150)]
    for base in rows[:8]:
        for _ in range(40):
            bits = np.unpackbits(base.view(np.uint8))
            bits[rng.choice(256, int(rng.integers(1, 20)), replace=False)] ^= 1
            rows.append(np.packbits(bits).view(np.uint64))
    share, most = simhash.radius(0.8, 4)
    assert 0.15 < share < 0.153 and 38 < most < 46
    found = connected_components(simhash.similar_links(spark.createDataFrame([(r.astype("<u8").tobytes(),) for r in rows], "fp binary"), similarity=0.8, lanes=4, split=split)).collect()
    names = [r.astype("<u8").tobytes() for r in rows]
    low = list(range(len(rows)))
    of = {bytes(r["a"]): bytes(r["b"]) for r in found}
    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(rows[i] ^ rows[j]).sum() <= most:
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    groups, got = {}, {}
    for n, r in zip(names, low, strict=True):
        groups.setdefault(r, set()).add(n)
        got.setdefault(of.get(n, n), set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_lanes():
    text = " ".join(f"w{i}" for i in range(40_000))
    assert int(simhash.lanes_of(text, 4, 42, 4)[0]) == plain_fingerprint(text)
    assert len(set(simhash.lanes_of(text, 5, 42, 4).tolist())) == 4
    other = " ".join(f"w{i}" for i in range(4_000, 44_000))  # Jaccard 0.82
    share, most = simhash.radius(0.8, 4)
    assert np.bitwise_count(simhash.lanes_of(text, 5, 42, 4) ^ simhash.lanes_of(other, 5, 42, 4)).sum() <= most + 6


def test_rows_are_told_apart_by_id_and_text(spark):
    """One id on two texts, one text on two ids, repeated rows and null ids."""
    words = [f"word{i}" for i in range(400)]
    a, b = " ".join(words[:200]), " ".join(words[200:])
    near = " ".join([*words[:100], "other", *words[101:200]])
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, b, "z"), (9, b, "y"), (7, b, "w"), (7, b, "w"), (None, a, "x"), (11, near, "x"), (None, near, "x")]
    alone = [(None, "a null id on a text of its own is kept", "x"), (None, "and so is another one of these texts", "y")]
    docs = spark.createDataFrame(rows + alone, "doc_id bigint, text string, lang string").repartition(3)
    want = sorted([(3, a, "x"), (7, b, "w"), *alone], key=str)
    for n in (0, 500_000):
        assert sorted(map(tuple, simhash.one_of_each_group(docs, broadcast_rows=n).collect()), key=str) == want
    only = spark.createDataFrame([(9, a, "x")] * 50, "doc_id bigint, text string, lang string")
    assert list(map(tuple, simhash.one_of_each_group(only).collect())) == [(9, a, "x")]


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"] or "") for r in rows]
    root = roots(fps)
    ids = {}
    for r, x in zip(rows, root, strict=True):
        ids.setdefault(x, []).append(r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", min((i for i in ids[x] if i is not None), default=None)) for r, f, x in zip(rows, fps, root, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == want


def test_one_of_each_group(odd_docs, no_docs):
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_shuffled_removal(odd_docs):
    assert simhash.one_of_each_group(odd_docs, broadcast_rows=0).count() == simhash.one_of_each_group(odd_docs).count()


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(5, 5)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["a"]: r["b"] for r in found.collect()} == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 400)}


def test_blocks_grow_with_the_table():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [5, 5, 6, 8]
    for blocks in (5, 6, 8):
        assert all(sum(w for _, w in spans) >= 64 * (blocks - 4) // blocks - blocks for _, spans in simhash.bucket_tables(blocks, 4))
