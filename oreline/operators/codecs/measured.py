"""Choices by measured cost: matches that are taken back where literals are cheaper, and series cut into segments of difference orders."""

from __future__ import annotations

import math

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar
from oreline.operators.codecs.entropy import arithmetic_decode, arithmetic_encode
from oreline.operators.codecs.matches import greedy_tokens, write_tokens
from oreline.operators.codecs.tokens import unzigzag, zigzag


class Costs:
    """Bits of bytes under counts that adapt as bytes are seen, and can be taken back."""

    def __init__(self, known: bytes = b""):
        self.counts = (np.bincount(np.frombuffer(known, dtype=np.uint8), minlength=256) + 1).tolist()
        self.total = len(known) + 256

    def trial(self, data: bytes) -> float:
        """Bits of ``data``, which counts as seen from now on."""
        bits = 0.0
        for b in data:
            bits -= math.log2(self.counts[b] / self.total)
            self.counts[b] += 1
            self.total += 1
        return bits

    def take_back(self, data: bytes) -> None:
        for b in data:
            self.counts[b] -= 1
        self.total -= len(data)


def measured_tokens(data: bytes) -> list[tuple[int, int, int, int]]:
    """The greedy parse in one pass, without the matches whose token costs more than their literals do where they stand."""
    literal, token = Costs(data), Costs()  # else the first literals look dear, matches are taken, and literals are never learned
    out: list[tuple[int, int, int, int]] = []
    for match, at, size, distance in greedy_tokens(data):
        plain = data[at : at + size]
        if match:
            code = put_uvar(size << 1 | 1) + put_uvar(distance)
            as_token = token.trial(code)
            as_plain = literal.trial(plain[:64]) * max(1.0, size / 64)  # what 64 literals cost says enough
            if as_token < as_plain:
                literal.take_back(plain[:64])
                out.append((1, at, size, distance))
                continue
            token.take_back(code)
            literal.take_back(plain[:64])
        literal.trial(plain)
        if out and not out[-1][0]:
            out[-1] = (0, out[-1][1], out[-1][2] + size, 0)
        else:
            out.append((0, at, size, 0))
    return out


def measured_encode(data: bytes) -> bytes:
    return write_tokens(data, measured_tokens(data))


def segments(values: np.ndarray, orders: int = 3, chunk: int = 32, switch_bits: float = 24.0) -> list[tuple[int, int]]:
    """(length, order) of the cheapest cut of a series into runs of difference orders, chunk by chunk, by dynamic programming.

    A chunk costs the bits of its zigzag differences; going on with another order costs ``switch_bits``.
    """
    n = len(values)
    bits = np.full((orders, n), 0.0)
    for k in range(orders):
        d = np.zeros(n, dtype=np.float64)
        d[: k + 1] = np.abs(values[: k + 1])
        if n > k:
            d[k:] = np.abs(np.diff(values, n=k))[: n - k]
        bits[k] = np.log2(2 * d + 1) + 1
    edges = list(range(0, n, chunk)) + [n]
    best, back = np.zeros(orders), []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = bits[:, lo:hi].sum(axis=1)
        move = best[:, None] + switch_bits * (1 - np.eye(orders))
        back.append(move.argmin(axis=0))
        best = move.min(axis=0) + own
    k, picked = int(best.argmin()), []
    for step in reversed(back):
        picked.append(k)
        k = int(step[k])
    out: list[list[int]] = []
    for (lo, hi), k in zip(zip(edges[:-1], edges[1:], strict=True), reversed(picked), strict=True):
        if out and out[-1][1] == k:
            out[-1][0] += hi - lo
        else:
            out.append([hi - lo, k])
    return [(n, k) for n, k in out]


def series_encode(values: list[int]) -> bytes:
    """Segments and their differences under adaptive range coding. A segment starts anew: its first values are its seeds."""
    v = np.array(values, dtype=object)
    cut = segments(np.array(values, dtype=np.float64)) if values else []
    head, body, at = put_uvar(len(values)) + put_uvar(len(cut)), bytearray(), 0
    for n, k in cut:
        head += put_uvar(n) + put_uvar(k)
        part = v[at : at + n].tolist()
        for _ in range(min(k, n - 1)):
            part = [part[0]] + [b - a for a, b in zip(part[:-1], part[1:], strict=True)]
        for x in part:
            body += put_uvar(zigzag(int(x)))
        at += n
    return head + arithmetic_encode(bytes(body))


def series_decode(data: bytes) -> list[int]:
    total, at = get_uvar(data, 0)
    count, at = get_uvar(data, at)
    if count > len(data):
        raise Corrupt("there can't be that many segments")
    cut = []
    for _ in range(count):
        n, at = get_uvar(data, at)
        k, at = get_uvar(data, at)
        cut.append((n, k))
    if sum(n for n, _ in cut) != total or any(not n or k > 8 for n, k in cut):
        raise Corrupt("segments don't add up")
    body, p, out = arithmetic_decode(data[at:]), 0, []
    for n, k in cut:
        part = []
        for _ in range(n):
            x, p = get_uvar(body, p)
            part.append(unzigzag(x))
        for _ in range(min(k, n - 1)):
            sums = [part[0]]
            for d in part[1:]:
                sums.append(sums[-1] + d)
            part = sums
        out += part
    if p != len(body):
        raise Corrupt("values go on after the series")
    return out
