"""Reversible transforms: block sorting, move to front, runs, context split, transposition, default with exceptions."""

from __future__ import annotations

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, mask_positions, put_uvar


def rotations(x: np.ndarray) -> np.ndarray:
    """Start of each rotation in sorted order, by prefix doubling; equal rotations keep their order."""
    n = len(x)
    rank, step = x.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step = new, step * 2
        if rank.max() == n - 1 or step >= n:
            return np.argsort(rank, kind="stable")


def bwt_encode(data: bytes) -> bytes:
    """The first rotation's place, then the last column of the sorted rotations."""
    if not data:
        return put_uvar(0)
    x = np.frombuffer(data, dtype=np.uint8)
    order = rotations(x)
    return put_uvar(int(np.flatnonzero(order == 0)[0])) + x[order - 1].tobytes()


def bwt_decode(data: bytes) -> bytes:
    at, start = get_uvar(data, 0)
    last = np.frombuffer(data[start:], dtype=np.uint8)
    n = len(last)
    if not n:
        return b""
    if at >= n:
        raise Corrupt("there is no such rotation")
    follow = np.argsort(last, kind="stable").tolist()
    out, row = np.empty(n, dtype=np.int64), follow[at]
    for i in range(n):
        out[i] = row
        row = follow[row]
    return last[out].tobytes()


def index_rate(n: int, walks: int) -> int:
    """How far apart indexes stand for about ``walks`` of them: a power of two, at least 2 and at most n where n allows it."""
    rate = 2
    while rate * walks < n and rate * 2 <= n:
        rate *= 2
    return rate


def bwt_indexed_encode(data: bytes, walks: int = 1024) -> bytes:
    """The size, the distance of the indexes and the places of the rotations that begin at its multiples, then the last column."""
    if not 1 <= walks <= 1 << 20:
        raise ValueError("no such number of walks")
    if not data:
        return put_uvar(0)
    x = np.frombuffer(data, dtype=np.uint8)
    order, rate = rotations(x), index_rate(len(x), walks)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    return put_uvar(len(x)) + put_uvar(rate) + b"".join(map(put_uvar, place[::rate].tolist())) + x[order - 1].tobytes()


def bwt_indexed_decode(data: bytes) -> bytes:
    """All stretches between indexes at once, a byte of each in every step."""
    n, at = get_uvar(data, 0)
    if not n:
        if at != len(data):
            raise Corrupt("bytes follow an empty text")
        return b""
    rate, at = get_uvar(data, at)
    if n > len(data) or rate < 2 or rate & rate - 1 or rate > max(2, n):
        raise Corrupt("no such distance of indexes")
    rows = []
    for _ in range(-(-n // rate)):
        row, at = get_uvar(data, at)
        rows.append(row)
    last = np.frombuffer(data[at:], dtype=np.uint8)
    if len(last) != n or max(rows) >= n:
        raise Corrupt("indexes and column don't agree")
    follow = np.argsort(last, kind="stable")
    row = np.array(rows)
    out = np.empty((len(rows), rate), dtype=np.uint8)
    for step in range(rate):
        row = follow[row]
        out[:, step] = last[row]
    return out.tobytes()[:n]


def mtf_encode(data: bytes) -> bytes:
    recent, out = list(range(256)), bytearray()
    for b in data:
        i = recent.index(b)
        out.append(i)
        if i:
            del recent[i]
            recent.insert(0, b)
    return bytes(out)


def mtf_decode(data: bytes) -> bytes:
    recent, out = list(range(256)), bytearray()
    for i in data:
        b = recent[i]
        out.append(b)
        if i:
            del recent[i]
            recent.insert(0, b)
    return bytes(out)


def zero_runs_encode(data: bytes) -> bytes:
    """Every run of zeros as a zero and its length less one."""
    x = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x == 0).astype(np.int8), [0]])))
    out, at = bytearray(), 0
    for lo, hi in edges.reshape(-1, 2).tolist():
        out += data[at:lo] + b"\0" + put_uvar(hi - lo - 1)
        at = hi
    return bytes(out + data[at:])


def zero_runs_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while (zero := data.find(b"\0", at)) >= 0:
        n, end = get_uvar(data, zero + 1)
        out += data[at:zero] + bytes(n + 1)
        at = end
    return bytes(out + data[at:])


def context_split_encode(data: bytes) -> bytes:
    """Bytes dealt to streams by the byte before them, in order; 256 lengths, then the streams."""
    x = np.frombuffer(data, dtype=np.uint8)
    before = np.concatenate([[0], x[:-1]]) if len(x) else x
    counts = np.bincount(before, minlength=256)
    return b"".join(map(put_uvar, counts.tolist())) + x[np.argsort(before, kind="stable")].tobytes()


def context_split_decode(data: bytes) -> bytes:
    counts, at = [], 0
    for _ in range(256):
        n, at = get_uvar(data, at)
        counts.append(n)
    body = data[at:]
    if sum(counts) != len(body):
        raise Corrupt("streams have another length")
    place = [0, *np.cumsum(counts)[:-1].tolist()]
    ends = np.cumsum(counts).tolist()
    out, before = bytearray(), 0
    for _ in range(len(body)):
        if place[before] >= ends[before]:
            raise Corrupt("a context's stream is too short")
        b = body[place[before]]
        place[before] += 1
        out.append(b)
        before = b
    return bytes(out)


def transpose_encode(data: bytes) -> bytes:
    """Lines column by column: the number of lines, their lengths, then all first bytes, all second bytes and so on."""
    lines = data.split(b"\n")
    lengths = np.array(list(map(len, lines)))
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lines)), lengths)
    col = np.arange(len(row)) - starts[row]
    body = np.frombuffer(b"".join(lines), dtype=np.uint8)
    return put_uvar(len(lines)) + b"".join(map(put_uvar, lengths.tolist())) + body[np.lexsort((row, col))].tobytes()


def transpose_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    if not n or n > len(data):
        raise Corrupt("there can't be that many lines")
    lengths = []
    for _ in range(n):
        x, at = get_uvar(data, at)
        lengths.append(x)
    lengths = np.array(lengths)
    body = np.frombuffer(data[at:], dtype=np.uint8)
    if lengths.sum() != len(body):
        raise Corrupt("lines have another length")
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(row)) - starts[row]
    plain = np.empty(len(body), dtype=np.uint8)
    plain[np.lexsort((row, col))] = body
    return b"\n".join(plain[a : a + k].tobytes() for a, k in zip(starts.tolist(), lengths.tolist(), strict=True))


def default_encode(data: bytes) -> bytes:
    """The commonest byte, a mask of the others, and the others."""
    x = np.frombuffer(data, dtype=np.uint8)
    common = int(np.argmax(np.bincount(x, minlength=256)))
    off = x != common
    return put_uvar(len(x)) + bytes([common]) + put_uvar(int(off.sum())) + np.packbits(off, bitorder="little").tobytes() + x[off].tobytes()


def default_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    if at >= len(data):
        raise Corrupt("no default")
    common = data[at]
    k, at = get_uvar(data, at + 1)
    size = (n + 7) // 8
    mask, values = data[at : at + size], data[at + size :]
    places = mask_positions(mask, n)
    if len(mask) != size or len(values) != k or len(places) != k:
        raise Corrupt("mask and values don't agree")
    out = np.full(n, common, dtype=np.uint8)
    out[places] = np.frombuffer(values, dtype=np.uint8)
    return out.tobytes()
