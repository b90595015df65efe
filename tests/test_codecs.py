"""Codecs and containers: round trips, cuts, mutations."""

import dataclasses
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from oreline.operators import shapes
from oreline.operators.codecs import DISABLED, REGISTRY, bits, columns, decode, decode_all, encode, encode_all, entropy, matches, measured, tokens, transforms
from oreline.operators.codecs import adaptive, lanes, parses
from oreline.operators.codecs.bits import Corrupt
from oreline.operators.codecs.registry import choose
from oreline.plans import codecs as plans
from oreline.sources import census, container

RNG = random.Random(9)
FIXED = [b"", b"a", b"aa", b"ab", bytes(300), bytes(range(256)), b"abc" * 400, b"\n\n\n", b"one\ntwo\nthree\n", RNG.randbytes(1500), b"the cat sat on the mat " * 60, b"ab" * 700 + b"a"]
TEXTS = st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"ab", b"abc", b"\0\0\0", b"\n", b"xyz", b"\xff"]), max_size=80).map(b"".join))


@pytest.mark.parametrize("number", sorted(REGISTRY))
def test_every_codec_comes_back(number):
    for data in FIXED:
        assert decode(number, encode(number, data)) == data


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_all_codecs_on_random_texts(data):
    for number in REGISTRY:
        assert decode(number, encode(number, data)) == data


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_lanes_are_the_one_block_coder(blocks):
    packed = encode_all(2, blocks)
    assert packed == [entropy.rans_encode(b) for b in blocks] and decode_all(2, packed) == blocks


def test_lanes_notice_what_is_broken():
    packed = encode_all(2, FIXED)
    for i in (3, 6, 9):
        for broken in (packed[i][:-1], packed[i] + b"\0", b"", packed[i][:3]):
            with pytest.raises(Corrupt):
                decode_all(2, [*packed[:i], broken, *packed[i + 1 :]])


def test_disabled_and_unknown_numbers():
    for number in [*DISABLED, 200]:
        with pytest.raises(Corrupt):
            decode(number, b"")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**63 - 1))
def test_numbers(n):
    packed = bits.put_uvar(n)
    assert bits.get_uvar(packed, 0) == (n, len(packed))
    for cut in range(len(packed)):
        with pytest.raises(Corrupt):
            bits.get_uvar(packed[:cut], 0)
    with pytest.raises(Corrupt):
        bits.get_uvar(packed[:-1] + bytes([packed[-1] | 128]) + b"\0", 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=40))
def test_packing(values):
    x = np.array(values, dtype=np.uint64)
    width = int(x.max()).bit_length() if values else 0
    packed = bits.pack(x, width)
    assert len(packed) == (len(values) * width + 7) // 8 and bits.unpack(packed, len(values), width).tolist() == values
    with pytest.raises(Corrupt):
        bits.unpack(packed + b"\0", len(values), width)


def test_checksums():
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert bits.fnv1a(b"") == 0xCBF29CE484222325 and bits.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert bits.mask_positions(b"\x05\x80", 16).tolist() == [0, 2, 15]


def test_code_lengths_are_bounded():
    counts = np.array([int(1.7**i) for i in range(40)] + [0] * 216)
    lengths = entropy.code_lengths(counts)
    assert lengths.max() <= 15 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    freq = entropy.normalised(counts)
    assert freq.sum() == 4096 and (freq[:40] >= 1).all()


def test_block_sorting_sorts():
    for data in FIXED[1:]:
        at, start = bits.get_uvar(transforms.bwt_encode(data), 0)
        order = sorted(range(len(data)), key=lambda i: (data[i:] + data[:i], i))
        assert transforms.bwt_encode(data)[start:] == bytes(data[i - 1] for i in order) and order[at] == 0


def test_parses_cover_the_text():
    for data in FIXED:
        for tokens in (matches.greedy_tokens(data), matches.cheapest_tokens(data)):
            at = 0
            for match, position, size, distance in tokens:
                assert position == at and size > 0
                if match:
                    assert 0 < distance <= position and all(data[position + k] == data[position + k - distance] for k in range(size))
                at += size
            assert at == len(data)
        assert len(matches.cheapest_encode(data)) <= len(matches.greedy_encode(data)) + 8


def test_grammar_rules_are_bounded():
    made, x = matches.grammar(b"abcabcabcabcabcabc" * 50, rules=3)
    assert len(made) == 3 and len(x) < 900


def test_choice():
    assert choose(b"", (1, 2, 32))[0] == 0
    assert choose(RNG.randbytes(500), (1, 2, 32))[0] == 0
    number, payload = choose(b"abc" * 500, (1, 2, 32))
    assert number == 32 and len(payload) < 50
    assert choose(b"abc" * 500, (1, 2, 32), least_gain=10_000)[0] == 0
    assert choose(b"abcd" * 500, (1, 32), rate=1.0)[0] == 0


@pytest.mark.parametrize("size", [0, 1, 15, 16, 511, 512, 4095, 4096, 4097])
def test_containers(size):
    data = (b"some text with repeats, repeats " * 200)[:size]
    packed = container.write(data, 512, (2, 5, 9, 32))
    assert container.read(packed) == data
    assert sum(f.size for f in container.frames(packed)) == size
    for cut in {0, 1, 4, len(packed) // 2, len(packed) - 1} - {len(packed)}:
        with pytest.raises(Corrupt):
            container.read(packed[:cut])
    with pytest.raises(Corrupt):
        container.read(packed + b"\0")


def test_mutations_are_refused_or_harmless():
    data = b"some text with repeats, repeats, and more text " * 40
    packed = container.write(data, 700, (1, 2, 9, 32))
    rng = random.Random(1)
    for _ in range(300):
        at = rng.randrange(len(packed))
        broken = packed[:at] + bytes([packed[at] ^ 1 << rng.randrange(8)]) + packed[at + 1 :]
        try:
            assert container.read(broken) == data
        except Corrupt:
            pass


def test_container_tables(spark):
    rows = [(f, b, bytes([f]) * 300 + f"block {b}".encode()) for f in range(3) for b in range(4)]
    blocks = spark.createDataFrame([(f, b, bytearray(d)) for f, b, d in rows], "file int, block int, data binary")
    files = container.assemble(container.encode_blocks(blocks, ["file", "block"], "data"), "file", "block", 307)
    back = container.scan(files, "file", with_data=True).collect()
    assert {(r["file"], r["block_id"], bytes(r["data"])) for r in back} == set(rows)
    assert all(r["crc"] == zlib.crc32(bytes(r["data"])) for r in back)
    seen = {r["file"]: r["blocks"] for r in container.inspect(container.scan(files, "file"), "file").collect()}
    assert seen == {0: 4, 1: 4, 2: 4}


def test_census():
    import gzip
    import io
    import struct
    import zipfile

    text = b"embedded text, embedded text " * 20
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.txt", text)
        f.writestr(zipfile.ZipInfo("b.bin"), b"stored bytes")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(text)) + chunk(b"IEND", b"")
    data = b"junk" + gzip.compress(text) + z.getvalue() + png + zlib.compress(text) + b"tail"
    found = census.streams(data)
    assert [(k, e, n, ok) for k, e, _, _, n, ok in found] == [("gzip", "", len(text), True), ("zip", "a.txt", len(text), True), ("zip", "b.bin", 12, True), ("png", "IDAT", len(text), True), ("zlib", "", len(text), True)]
    broken = bytearray(zlib.compress(text))
    broken[12] ^= 255
    assert census.streams(bytes(broken)) == []


def test_replay():
    text = b"what is replayed must be the same bytes " * 30
    for level, window, memory, strategy in ((9, 15, 8, 0), (1, 12, 9, 0), (4, 15, 5, 1), (6, 14, 8, 2), (7, 9, 8, 3), (0, 15, 8, 0), (6, 15, 9, 4)):
        c = zlib.compressobj(level, zlib.DEFLATED, window, memory, strategy)
        stream = c.compress(text) + c.flush()
        found = census.replay(stream)
        c = zlib.compressobj(found[0], zlib.DEFLATED, found[1], found[2], found[3])
        assert c.compress(text) + c.flush() == stream
    assert census.replay(zlib.compress(text)[:2] + b"\x01\x00\x00\xff\xff" + struct.pack(">I", 1)) is None


def cabinet(blocks):
    """One folder of deflate blocks, each with the block before as its dictionary."""
    body, before = b"", b""
    for b in blocks:
        c = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = b"CK" + c.compress(b) + c.flush()
        body += struct.pack("<IHH", 0, len(packed), len(b)) + packed
        before = b
    head = 36 + 8
    return census.CABINET + struct.pack("<IIIIBBHHHHH", head + len(body), 0, head, 0, 3, 1, 1, 0, 0, 7, 0) + struct.pack("<IHH", head, len(blocks), 1) + body


def test_census_of_harder_files():
    import io
    import zipfile

    from oreline.plans.codecs import planted

    text = b"a text that is packed, " * 400
    for k, kind in enumerate(("gzip", "zip", "png", "zlib", "zip")):
        (found,) = census.streams(b"head" + planted(k, text) + b"tail")
        assert found[0] == kind and found[4:] == (len(text), True)
    (found,) = census.streams(b"xx" + cabinet([text[:500], text[100:700]]) + b"tail")
    assert found[:2] == ("cab", "folder 0") and found[4:] == (1100, True)
    # an archive of many entries, one damaged, behind bytes that look like headers
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for i in range(20):
            f.writestr(f"{i}.txt", text + bytes([i]))
        f.comment = b"a comment"
    raw = bytearray(b"\x78\x9c\x78\x9c\x1f\x8b\x08" + z.getvalue())
    assert [(x[1], x[5]) for x in census.streams(bytes(raw))] == [(f"{i}.txt", True) for i in range(20)]
    with zipfile.ZipFile(io.BytesIO(z.getvalue())) as f:
        at = f.infolist()[7].header_offset
    raw[7 + at + 30 + 5 + 20] ^= 255
    found = census.streams(bytes(raw))
    assert len(found) == 20 and not found[7][5] and sum(x[5] for x in found) == 19
    # candidates in great number, none of them a stream
    assert census.streams(b"\x78\x9c" * 50_000) == []
    assert census.streams(z.getvalue()[:200]) and not any(x[5] for x in census.streams(z.getvalue()[:60]))


COLUMNS = st.lists(st.one_of(st.integers(-(2**60), 2**60).map(str), st.integers(-5, 5).map(str), st.sampled_from(["-0", "01", "x", "", "é", "1.5"])), min_size=1, max_size=25)


@settings(max_examples=80, deadline=None)
@given(COLUMNS)
def test_leaf_payloads(tokens):
    for leaf in range(5):
        payload = columns.leaf_encode(leaf, tokens)
        if payload is not None:
            assert columns.leaf_decode(leaf, payload, len(tokens)) == tokens
        else:
            assert leaf > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(['{"a":1}', '{"a":22}', '{"a": 1}', "oops", "", "[1,2]", '{"a":"x"}']), max_size=30))
def test_region_carriers(lines):
    packed = columns.region_encode(lines, shapes.scalar_spans)
    assert columns.region_decode(packed) == lines
    for cut in range(0, len(packed), 5):
        with pytest.raises(Corrupt):
            columns.region_decode(packed[:cut])


def test_corrections_and_added_words():
    text = bytes(RNG.randbytes(200))
    changed = bytearray(text)
    changed[50] ^= 1
    changed[120] ^= 1
    both = text + bytes(changed)
    assert tokens.sparse_decode(tokens.sparse_encode(both)) == both
    assert len(tokens.sparse_encode(both)) < len(encode(9, both))
    words = RNG.choices(range(2**32), k=60)
    moved = b"".join(w.to_bytes(4, "little") for w in words) + b"".join(((w + 99) % 2**32).to_bytes(4, "little") for w in words) + b"xy"
    assert decode(17, encode(17, moved)) == moved and len(encode(17, moved)) < len(moved) * 0.6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(-50, 50), st.integers(-(2**50), 2**50)), max_size=120))
def test_segmented_series(values):
    assert measured.series_decode(measured.series_encode(values)) == values


def test_segments_follow_the_orders():
    noise = RNG.choices(range(-1000, 1000), k=96)
    line = np.cumsum([10**6, *RNG.choices(range(-1000, 1000), k=95)]).tolist()
    curve = [10**9 + 10**5 * i * i for i in range(96)]
    cut = measured.segments(np.array(noise + line + curve, dtype=np.float64))
    assert sum(n for n, _ in cut) == 288 and cut[0][1] == 0 and cut[-1][1] == 2 and len({k for _, k in cut}) == 3


def test_matches_that_do_not_pay_are_taken_back():
    for data in FIXED:
        at = 0
        for _, position, size, _ in measured.measured_tokens(data):
            assert position == at
            at += size
        assert at == len(data)
    plain = bytes(RNG.choices(b"ab", k=6_000))
    assert sum(x[0] for x in measured.measured_tokens(plain)) < sum(x[0] for x in matches.greedy_tokens(plain))


@pytest.mark.parametrize("mode", sorted(entropy.LITERAL_MODES))
def test_literal_modes(mode):
    for data in FIXED:
        packed = entropy.literal_encode(data, mode)
        assert packed[0] == mode and entropy.literal_decode(packed) == data
        assert len(entropy.literal_encode(data)) <= len(packed)


def test_a_byte_is_a_context_once_it_was_seen_often_enough():
    gated = entropy.Contexts(4)
    assert gated.after(None) is gated.common and all(gated.after(65) is gated.common for _ in range(4))
    assert gated.after(65) is not gated.common and gated.after(66) is gated.common
    assert entropy.Contexts(0).after(65) is not None and entropy.Contexts(None).times[65] == 0
    pairs = b"".join(bytes([x, x ^ 255]) for x in RNG.choices(range(128), k=4_000))
    assert len(entropy.literal_encode(pairs, 2)) < len(entropy.literal_encode(pairs, 1))
    for broken in (b"", b"\0", b"\6" + entropy.literal_encode(b"abc")[1:], entropy.literal_encode(b"abc") + b"\0"):
        with pytest.raises(Corrupt):
            entropy.literal_decode(broken)


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.sampled_from([1, 2, 7, 1024]))
def test_indexed_block_sort(data, walks):
    packed = transforms.bwt_indexed_encode(data, walks)
    assert transforms.bwt_indexed_decode(packed) == data
    if data:
        rate = transforms.index_rate(len(data), walks)
        assert rate == 2 or (rate <= len(data) and rate // 2 * walks < len(data))
        assert packed.endswith(transforms.bwt_encode(data)[-len(data) :])


@pytest.mark.parametrize("post", [1, 2, 3])
def test_post_coders(post):
    from oreline.operators.codecs import registry

    for data in FIXED:
        packed = registry.sorted_encode(data, post)
        assert registry.sorted_decode(packed) == data and len(registry.sorted_encode(data)) <= len(packed)


def test_refused_post_coders_and_broken_indexes():
    from oreline.operators.codecs import registry

    for post in (0, 4, 9):
        with pytest.raises(ValueError):
            registry.sorted_encode(b"abc", post)
        packed = bytearray(registry.sorted_encode(b"abcabc", 3))
        packed[1 + packed[0]] = post
        with pytest.raises(Corrupt):
            registry.sorted_decode(bytes(packed))
    good = transforms.bwt_indexed_encode(b"banana" * 9, 4)
    for broken in (good[:-1], good + b"x", good[:1] + b"\3" + good[2:], good[:1] + b"\x40" + good[2:], good[:2] + b"\x7f" + good[3:]):
        with pytest.raises(Corrupt):
            transforms.bwt_indexed_decode(broken)


def many_blocks(count: int = 40) -> list[bytes]:
    """Blocks of phrases that come again at many distances, of two bytes, of any bytes, and the fixed ones."""
    rng = random.Random(17)
    phrases = [rng.randbytes(rng.randrange(2, 40)) for _ in range(30)]
    return [b"".join(rng.choices(phrases, k=rng.randrange(80))) for _ in range(count)] + [bytes(rng.choices(b"ab", k=900)), rng.randbytes(700), b"a" * 2000, *FIXED]


@pytest.mark.parametrize("window", [1 << 16, 200, 5])
def test_parses_of_many_blocks_are_those_of_one(window, monkeypatch):
    blocks = many_blocks()
    assert parses.greedy_all(blocks, window) == [matches.greedy_tokens(b, window) for b in blocks]
    cheapest = [matches.cheapest_tokens(b, window) for b in blocks]
    assert parses.cheapest_all(blocks, window) == cheapest
    monkeypatch.setattr(parses, "MATCHED_BYTES", 700)
    monkeypatch.setattr(parses, "PRICED_BYTES", 3000)
    assert parses.cheapest_all(blocks, window) == cheapest and parses.cheapest_all([b"", b""]) == [[], []]


def test_blocks_are_parsed_together(monkeypatch):
    blocks = many_blocks(10)
    before = [matches.greedy_encode(b) for b in blocks], [matches.cheapest_encode(b) for b in blocks]
    for name in ("greedy_tokens", "cheapest_tokens"):
        monkeypatch.setattr(matches, name, None)
    assert (encode_all(9, blocks), encode_all(10, blocks)) == before and decode_all(10, before[1]) == blocks


def test_streams_of_many_blocks_are_coded_together(monkeypatch):
    blocks = many_blocks(30) + [b"the quick brown fox " * 30 + RNG.randbytes(900)]
    packed, calls = [encode(18, b) for b in blocks], []
    own = REGISTRY[2].encode_all
    monkeypatch.setitem(REGISTRY, 2, dataclasses.replace(REGISTRY[2], encode_all=lambda x: calls.append(len(x)) or own(x)))
    assert encode_all(18, blocks) == packed and len(calls) == 1
    assert decode_all(18, packed) == blocks
    with pytest.raises(Corrupt):
        decode_all(18, [packed[0], packed[-1][:-1]])


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_huffman_lanes_are_the_one_block_coder(blocks):
    packed = [entropy.huffman_encode(b) for b in blocks]
    assert lanes.huffman_decode_all(packed) == blocks == [entropy.huffman_decode(p) for p in packed]


def test_huffman_lanes_notice_what_is_broken():
    rng = random.Random(4)
    packed = entropy.huffman_encode(b"the cat sat on the mat " * 9)
    for _ in range(200):
        broken = bytearray(packed[: rng.randrange(1, len(packed) + 1)])
        broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            expected = entropy.huffman_decode(bytes(broken))
        except Corrupt:
            expected = None
        try:
            assert lanes.huffman_decode_all([packed, bytes(broken)])[1] == expected
        except Corrupt:
            assert expected is None


def test_code_lengths_do_not_change():
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 3, 256), rng.integers(0, 1000, 256), (2.0 ** np.arange(40)).astype(np.int64), np.ones(256, dtype=np.int64), np.arange(256) == 7):
        counts = np.pad(counts.astype(np.int64), (0, 256 - len(counts)))
        lengths = entropy.code_lengths(counts)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 15
        if np.count_nonzero(counts) > 1:
            assert (2.0 ** -lengths[counts > 0]).sum() == 1
        codes, last = entropy.canonical_codes(lengths), None
        for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
            code = 0 if last is None else int(codes[last]) + 1 << int(lengths[s] - lengths[last])
            assert codes[s] == code
            last = s


def skewed_blocks() -> list[bytes]:
    """Blocks long enough that counts are halved, over one byte, two, few and all."""
    rng = np.random.default_rng(12)
    return [b"", b"a", bytes([255]) * 1500, rng.integers(0, 2, 2500, dtype=np.uint8).tobytes(), rng.integers(0, 256, 1200, dtype=np.uint8).tobytes(), np.minimum(255, rng.exponential(9, 2500)).astype(np.uint8).tobytes(), *FIXED]


@pytest.mark.parametrize("gate", [None, 0, 4])
def test_adaptive_lanes_are_the_one_block_coder(gate, monkeypatch):
    blocks = skewed_blocks()
    packed = [entropy.arithmetic_encode(b, gate) for b in blocks]
    assert adaptive.encode_all(blocks, gate) == packed and adaptive.decode_all(packed, gate) == blocks
    monkeypatch.setattr(adaptive, "LANE_BYTES", 3000)
    monkeypatch.setattr(adaptive, "LONGEST", 2000)
    assert adaptive.encode_all(blocks, gate) == packed and adaptive.decode_all(packed, gate) == blocks


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_literal_modes_of_many_blocks(blocks):
    packed = encode_all(20, blocks)
    assert packed == [entropy.literal_encode(b) for b in blocks] and decode_all(20, packed) == blocks


@pytest.mark.parametrize("number", [4, 20, 21])
def test_adaptive_lanes_notice_what_is_broken(number):
    rng = random.Random(number)
    packed = encode(number, b"the cat sat on the mat " * 9)
    for _ in range(150):
        broken = bytearray(packed[: rng.randrange(1, len(packed) + 1)])
        broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            expected = decode(number, bytes(broken))
        except Corrupt:
            expected = None
        try:
            assert decode_all(number, [packed, bytes(broken)])[1] == expected
        except Corrupt:
            assert expected is None


def test_literal_modes_are_tried_on_all_blocks_at_once(monkeypatch):
    blocks = skewed_blocks()
    packed = [entropy.literal_encode(b) for b in blocks]
    monkeypatch.setattr(entropy, "arithmetic_encode", None)
    assert encode_all(20, blocks) == packed and decode_all(20, packed) == blocks


def test_sorted_blocks_are_coded_together(monkeypatch):
    blocks = skewed_blocks()
    packed = [encode(21, b) for b in blocks]
    assert {p[bits.get_uvar(p, 0)[0] + bits.get_uvar(p, 0)[1]] for p in packed} == {1, 2, 3}
    monkeypatch.setattr(entropy, "arithmetic_encode", None)
    assert encode_all(21, blocks) == packed and decode_all(21, packed) == blocks
    with pytest.raises(Corrupt):
        decode_all(21, [packed[3], b"\0\4"])


def test_grammar_is_that_of_the_commonest_pairs():
    """Held against rules made one by one from counts in a dictionary."""
    for data in [*many_blocks(12), b"aaa" * 50 + b"b", b"aabaab" * 9, b"\0" * 9, bytes(2) + b"xyxyxyxy"]:
        x, made = list(data), []
        while len(made) < 768 and len(x) > 1:
            counts: dict[tuple[int, int], int] = {}
            for pair in zip(x[:-1], x[1:], strict=True):
                counts[pair] = counts.get(pair, 0) + 1
            best = min(counts, key=lambda p: (-counts[p], p))
            out, i = [], 0
            while i < len(x):
                whole = tuple(x[i : i + 2]) == best
                out.append(256 + len(made) if whole else x[i])
                i += 1 + whole
            if counts[best] < 4 or len(x) - len(out) < 4:
                break
            x = out
            made.append(best)
        rules, symbols = matches.grammar(data)
        assert (rules, symbols.tolist()) == (made, x)


def test_ranks_of_many_blocks_are_coded_together(monkeypatch):
    blocks = many_blocks(8)
    packed = [encode(6, b) for b in blocks]
    monkeypatch.setattr(entropy, "normalised", None)  # what the one-block coder would use
    assert encode_all(6, blocks) == packed and decode_all(6, packed) == blocks


def test_blocks_of_one_row_group_go_to_several_tasks(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(1, rng.randbytes(3_000_000).hex()), (2, "x"), (3, "")], "doc_id bigint, text string").coalesce(1)
    found = plans.round_trip(lambda name: docs, 0).withColumn("task", F.spark_partition_id())
    got = found.agg(F.count("*"), F.sum("n_bytes"), F.bool_and("ok"), F.countDistinct("task")).first()
    assert got[:3] == (1466, 6_000_001, True) and got[3] > 1
