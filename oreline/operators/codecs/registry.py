"""Codecs by number, and choosing between them."""

from __future__ import annotations

import bz2
import dataclasses
import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa

from oreline.operators.codecs import adaptive, entropy, lanes, matches, measured, parses, tokens, transforms
from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar


@dataclasses.dataclass(frozen=True)
class Codec:
    id: int
    name: str
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]
    cost: float = 0.0  # what decoding a byte costs, for additive selection
    encode_all: Callable[[list[bytes]], list[bytes]] | None = None  # many blocks at once, where that is faster
    decode_all: Callable[[list[bytes]], list[bytes]] | None = None
    fixed: int = 0  # bytes that every payload of a text has at least; a shorter text can't gain


def chain(*pairs: tuple[Callable, Callable]) -> tuple[Callable, Callable]:
    def forward(data: bytes) -> bytes:
        for f, _ in pairs:
            data = f(data)
        return data

    def back(data: bytes) -> bytes:
        for _, g in reversed(pairs):
            data = g(data)
        return data

    return forward, back


def arrow(name: str) -> tuple[Callable, Callable]:
    """A library codec, with the length that it needs before it."""

    def forward(data: bytes) -> bytes:
        return put_uvar(len(data)) + (pa.Codec(name).compress(data, asbytes=True) if data else b"")

    def back(data: bytes) -> bytes:
        n, at = get_uvar(data, 0)
        return pa.Codec(name).decompress(data[at:], n, asbytes=True) if n else b""

    return forward, back


BWT, MTF, RUNS = (transforms.bwt_encode, transforms.bwt_decode), (transforms.mtf_encode, transforms.mtf_decode), (transforms.zero_runs_encode, transforms.zero_runs_decode)
RANS, HUFFMAN, ARITHMETIC = (entropy.rans_encode, entropy.rans_decode), (entropy.huffman_encode, entropy.huffman_decode), (entropy.arithmetic_encode, entropy.arithmetic_decode)
SPLIT, LINES = (transforms.context_split_encode, transforms.context_split_decode), (transforms.transpose_encode, transforms.transpose_decode)


def by_ranks(*coder: Callable[[list[bytes]], list[bytes]]) -> tuple[Callable, Callable]:
    """Ranks and runs of many blocks under a coder and its decoder of many blocks."""
    forward, back = coder
    return (
        lambda blocks: forward([transforms.zero_runs_encode(transforms.mtf_encode(b)) for b in blocks]),
        lambda payloads: [transforms.mtf_decode(transforms.zero_runs_decode(b)) for b in back(payloads)],
    )


def tagged(*coders: tuple[Callable, Callable]) -> tuple[Callable, Callable]:
    """The coder of fewest bytes, ties to the first, after a byte with its place."""

    def forward(data: bytes) -> bytes:
        return min((bytes([i]) + f(data) for i, (f, _) in enumerate(coders)), key=len)

    def back(data: bytes) -> bytes:
        if not data or data[0] >= len(coders):
            raise Corrupt("no such coder")
        return coders[data[0]][1](data[1:])

    return forward, back


def gated(gate: int | None) -> tuple[Callable, Callable]:
    return lambda d: entropy.arithmetic_encode(d, gate), lambda d: entropy.arithmetic_decode(d, gate)


#: What codes a sorted block, by number: order 0 and order 1 over ranks and runs, or the column as it is. 0 and 4 are known and refused.
POST_CODERS = {1: chain(MTF, RUNS, gated(None)), 2: chain(MTF, RUNS, gated(0)), 3: tagged(RANS, HUFFMAN)}
POST_REFUSED = frozenset({0, 4})


def sorted_encode(data: bytes, post: int | None = None, walks: int = 1024) -> bytes:
    """A block sort with indexes and its post-coder's number before it; without a number the one of fewest bytes, ties to the lower."""
    if post is not None and post not in POST_CODERS:
        raise ValueError(f"post-coder {post} is {'refused' if post in POST_REFUSED else 'unknown'}")
    column = transforms.bwt_indexed_encode(data, walks)
    head = len(column) - len(data)
    coded = (bytes([p]) + POST_CODERS[p][0](column[head:]) for p in sorted(POST_CODERS) if post in (None, p))
    return put_uvar(head) + column[:head] + min(coded, key=len)


def sorted_decode(data: bytes) -> bytes:
    head, at = get_uvar(data, 0)
    end = at + head
    if end >= len(data) or data[end] not in POST_CODERS:
        raise Corrupt("the post-coder is missing, refused or unknown")
    return transforms.bwt_indexed_decode(data[at:end] + POST_CODERS[data[end]][1](data[end + 1 :]))


def sorted_encode_all(blocks: list[bytes]) -> list[bytes]:
    """``sorted_encode`` of each block; ranks and runs are made once and each post-coder codes all blocks together."""
    columns = [transforms.bwt_indexed_encode(b) for b in blocks]
    heads = [len(c) - len(b) for b, c in zip(blocks, columns, strict=True)]
    bodies = [c[h:] for c, h in zip(columns, heads, strict=True)]
    ranks = [transforms.zero_runs_encode(transforms.mtf_encode(b)) for b in bodies]
    plain = zip(lanes.encode_all(bodies), map(entropy.huffman_encode, bodies), strict=True)
    by_post = {1: adaptive.encode_all(ranks), 2: adaptive.encode_all(ranks, 0), 3: [min(b"\0" + r, b"\1" + h, key=len) for r, h in plain]}
    out = []
    for i, (column, head) in enumerate(zip(columns, heads, strict=True)):
        out.append(put_uvar(head) + column[:head] + min((bytes([p]) + by_post[p][i] for p in sorted(POST_CODERS)), key=len))
    return out


def sorted_decode_all(payloads: list[bytes]) -> list[bytes]:
    heads, by_post = [], {}
    for i, data in enumerate(payloads):
        head, at = get_uvar(data, 0)
        end = at + head
        if end >= len(data) or data[end] not in POST_CODERS:
            raise Corrupt("the post-coder is missing, refused or unknown")
        heads.append((at, end))
        by_post.setdefault(data[end], []).append(i)
    bodies: list[bytes] = [b""] * len(payloads)
    for post, places in by_post.items():
        coded = [payloads[i][heads[i][1] + 1 :] for i in places]
        if post == 3:
            plain = list(map(POST_CODERS[3][1], coded))
        else:
            plain = [transforms.mtf_decode(transforms.zero_runs_decode(x)) for x in adaptive.decode_all(coded, {1: None, 2: 0}[post])]
        for i, x in zip(places, plain, strict=True):
            bodies[i] = x
    return [transforms.bwt_indexed_decode(p[at:end] + b) for p, (at, end), b in zip(payloads, heads, bodies, strict=True)]


REGISTRY: dict[int, Codec] = {
    c.id: c
    for c in (
        Codec(0, "raw", bytes, bytes),
        Codec(1, "huffman", *HUFFMAN, 22.0, decode_all=lanes.huffman_decode_all, fixed=129),
        Codec(2, "rans", *RANS, 40.0, lanes.encode_all, lanes.decode_all),
        Codec(3, "rans_clustered", entropy.clustered_encode, entropy.clustered_decode, 45.0),
        Codec(4, "arithmetic", *ARITHMETIC, 90.0, adaptive.encode_all, adaptive.decode_all),
        Codec(5, "default", transforms.default_encode, transforms.default_decode, 20.0),
        Codec(6, "mtf_runs_rans", *chain(MTF, RUNS, RANS), 50.0, *by_ranks(lanes.encode_all, lanes.decode_all)),
        Codec(7, "bwt_mtf_rans", *chain(BWT, MTF, RUNS, RANS), 120.0),
        Codec(8, "bwt_mtf_huffman", *chain(BWT, MTF, RUNS, HUFFMAN), 110.0),
        Codec(9, "lz_greedy", matches.greedy_encode, matches.read_tokens, 10.0, parses.encoder(parses.greedy_all, matches.write_tokens)),
        Codec(10, "lz_cheapest", matches.cheapest_encode, matches.read_tokens, 10.0, parses.encoder(parses.cheapest_all, matches.write_tokens)),
        Codec(11, "self_reference", matches.self_reference_encode, matches.self_reference_decode, 12.0),
        Codec(12, "grammar", matches.grammar_encode, matches.grammar_decode, 15.0),
        Codec(13, "context_split_rans", *chain(SPLIT, RANS), 60.0),
        Codec(14, "transpose_rans", *chain(LINES, RANS), 50.0),
        Codec(15, "lz_rans", *chain((matches.greedy_encode, matches.read_tokens), RANS), 45.0),
        Codec(16, "sparse", tokens.sparse_encode, tokens.sparse_decode, 14.0),
        Codec(17, "word_reference", tokens.reference_encode, tokens.reference_decode, 8.0),
        Codec(18, "streams", tokens.streams_encode, tokens.streams_decode, 40.0, tokens.streams_encode_all, tokens.streams_decode_all),
        Codec(19, "lz_measured", measured.measured_encode, matches.read_tokens, 10.0),
        Codec(20, "gated_literals", entropy.literal_encode, entropy.literal_decode, 95.0, adaptive.literal_encode_all, adaptive.literal_decode_all),
        Codec(21, "sorted_indexed", sorted_encode, sorted_decode, 60.0, sorted_encode_all, sorted_decode_all),
        Codec(32, "deflate", lambda d: zlib.compress(d, 9), zlib.decompress, 25.0),
        Codec(33, "bzip2", bz2.compress, bz2.decompress, 100.0),
        Codec(34, "lzma", lambda d: lzma.compress(d, preset=6), lzma.decompress, 80.0),
        Codec(35, "zstd", *arrow("zstd"), 12.0),
        Codec(36, "brotli", *arrow("brotli"), 20.0),
        Codec(37, "lz4", *arrow("lz4_raw"), 4.0),
    )
}
#: Numbers that once meant a prediction pass; readers refuse them.
DISABLED = frozenset({31})


def codec(number: int) -> Codec:
    if number in DISABLED or number not in REGISTRY:
        raise Corrupt(f"codec {number} is disabled or unknown")
    return REGISTRY[number]


def encode(number: int, data: bytes) -> bytes:
    return codec(number).encode(data)


def decode(number: int, data: bytes) -> bytes:
    """The plain bytes; every failure of a codec is ``Corrupt``."""
    try:
        return codec(number).decode(data)
    except Corrupt:
        raise
    except Exception as e:
        raise Corrupt(f"codec {number}: {e}") from e


def encode_all(number: int, blocks: list[bytes]) -> list[bytes]:
    own = codec(number)
    return own.encode_all(blocks) if own.encode_all else list(map(own.encode, blocks))


def decode_all(number: int, payloads: list[bytes]) -> list[bytes]:
    own = codec(number)
    if not own.decode_all:
        return [decode(number, p) for p in payloads]
    try:
        return own.decode_all(payloads)
    except Corrupt:
        raise
    except Exception as e:
        raise Corrupt(f"codec {number}: {e}") from e


def choose(data: bytes, numbers: tuple[int, ...], rate: float = 0.0, least_gain: int = 0) -> tuple[int, bytes]:
    """The codec of least size + rate * cost * bytes, ties to the lower number; raw unless it gains ``least_gain`` bytes and more than none."""
    return choose_all([data], numbers, rate, least_gain)[0]


def choose_all(blocks: list[bytes], numbers: tuple[int, ...], rate: float = 0.0, least_gain: int = 0) -> list[tuple[int, bytes]]:
    """``choose`` for each block, a codec at a time."""
    best = [(float(len(b)), 0, b) for b in blocks]
    for n in sorted(numbers):
        some = [i for i, b in enumerate(blocks) if len(b) > REGISTRY[n].fixed]
        for i, packed in zip(some, encode_all(n, [blocks[i] for i in some]), strict=True):
            cost = len(packed) + rate * REGISTRY[n].cost * len(blocks[i])
            if cost < best[i][0] and len(packed) + max(1, least_gain) <= len(blocks[i]):
                best[i] = (cost, n, packed)
    return [(n, packed) for _, n, packed in best]
