"""Dictionary coders: greedy and cost-minimal parses over hash chains, self-reference, and pair grammars."""

from __future__ import annotations

import numpy as np

from oreline.operators.codecs.bits import Corrupt, common_prefix, get_uvar, put_uvar

LEAST, CHAIN = 4, 16


def matches_at(data: bytes, heads: dict[bytes, list[int]], i: int, window: int, keep: int = 8) -> list[tuple[int, int]]:
    """Up to ``keep`` earlier matches of at least four bytes: (length, distance), longest and nearest first."""
    found = []
    for j in reversed(heads.get(data[i : i + LEAST], ())[-CHAIN:]):
        if i - j > window:
            break
        found.append((common_prefix(data, j, i, len(data) - i), i - j))
    return sorted(found, key=lambda m: (-m[0], m[1]))[:keep]


def varint_cost(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


def greedy_tokens(data: bytes, window: int = 1 << 16) -> list[tuple[int, int, int, int]]:
    """Tokens (match, position, length, distance); a token without match is a run of literals."""
    heads: dict[bytes, list[int]] = {}
    tokens, i, run = [], 0, 0
    while i < len(data):
        best = next(iter(matches_at(data, heads, i, window)), (0, 0))
        step = best[0] if best[0] >= LEAST else 1
        if step > 1:
            if run < i:
                tokens.append((0, run, i - run, 0))
            tokens.append((1, i, *best))
            run = i + step
        for k in range(i, min(i + step, len(data) - LEAST + 1)):
            heads.setdefault(data[k : k + LEAST], []).append(k)
        i += step
    if run < len(data):
        tokens.append((0, run, len(data) - run, 0))
    return tokens


def cheapest_tokens(data: bytes, window: int = 1 << 16) -> list[tuple[int, int, int, int]]:
    """The parse of least bytes over literal and match edges, by dynamic programming from the end."""
    n = len(data)
    heads: dict[bytes, list[int]] = {}
    edges: list[list[tuple[int, int]]] = []
    live: dict[int, int] = {}  # length by distance; a match goes on at the next byte without comparing it again
    for i in range(n):
        live = {distance: length - 1 for distance, length in live.items() if length > LEAST}
        for j in heads.get(data[i : i + LEAST], ())[-CHAIN:]:
            if i - j <= window and i - j not in live:
                live[i - j] = common_prefix(data, j, i, n - i)
        edges.append(sorted(((length, distance) for distance, length in live.items()), key=lambda m: (-m[0], m[1]))[:3])
        if i + LEAST <= n:
            heads.setdefault(data[i : i + LEAST], []).append(i)
    cost, choice = [0.0] * (n + 1), [(1, 0)] * n
    for i in range(n - 1, -1, -1):
        best = (cost[i + 1] + 1.02, 1, 0)
        for length, distance in edges[i]:
            for size in {length, max(LEAST, length // 2)}:
                best = min(best, (cost[i + size] + 1 + varint_cost(size) + varint_cost(distance), size, distance))
        cost[i], choice[i] = best[0], best[1:]
    tokens, i, run = [], 0, 0
    while i < n:
        size, distance = choice[i]
        if distance:
            if run < i:
                tokens.append((0, run, i - run, 0))
            tokens.append((1, i, size, distance))
            run = i + size
        i += size
    if run < n:
        tokens.append((0, run, n - run, 0))
    return tokens


def write_tokens(data: bytes, tokens: list[tuple[int, int, int, int]]) -> bytes:
    """Separated streams: literal bytes apart from lengths and distances."""
    literals, marks = bytearray(), bytearray()
    for match, at, size, distance in tokens:
        marks += put_uvar(size << 1 | match)
        if match:
            marks += put_uvar(distance)
        else:
            literals += data[at : at + size]
    return put_uvar(len(data)) + put_uvar(len(marks)) + bytes(marks) + bytes(literals)


def read_tokens(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    size, at = get_uvar(data, at)
    stop, lit = at + size, at + size
    if stop > len(data):
        raise Corrupt("token stream is cut short")
    out = bytearray()
    while at < stop:
        x, at = get_uvar(data, at)
        length = x >> 1
        if x & 1:
            distance, at = get_uvar(data, at)
            if not 0 < distance <= len(out):
                raise Corrupt("a match reaches before the text")
            for _ in range(-(-length // distance)):
                out += out[-distance : len(out) - distance + min(distance, length)]
                length -= min(distance, length)
        else:
            out += data[lit : lit + length]
            lit += length
    if len(out) != n or lit != len(data) or at != stop:
        raise Corrupt("tokens give another text")
    return bytes(out)


def greedy_encode(data: bytes) -> bytes:
    return write_tokens(data, greedy_tokens(data))


def cheapest_encode(data: bytes) -> bytes:
    return write_tokens(data, cheapest_tokens(data))


def self_reference_encode(data: bytes, window: int = 1 << 16) -> bytes:
    """Phrases of an earlier place and a length, each followed by one literal."""
    heads: dict[bytes, list[int]] = {}
    out, i = bytearray(put_uvar(len(data))), 0
    while i < len(data):
        size, distance = next(iter(matches_at(data, heads, i, window)), (0, 0))
        size = min(size, len(data) - i - 1)
        if size < LEAST:
            size = distance = 0
        out += put_uvar(size) + (put_uvar(distance) if size else b"") + data[i + size : i + size + 1]
        for k in range(i, min(i + size + 1, len(data) - LEAST + 1)):
            heads.setdefault(data[k : k + LEAST], []).append(k)
        i += size + 1
    return bytes(out)


def self_reference_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    out = bytearray()
    while len(out) < n:
        size, at = get_uvar(data, at)
        if size:
            distance, at = get_uvar(data, at)
            if not 0 < distance <= len(out):
                raise Corrupt("a phrase reaches before the text")
            for _ in range(size):
                out.append(out[-distance])
        if at >= len(data):
            raise Corrupt("phrases end before the text does")
        out.append(data[at])
        at += 1
    if len(out) != n or at != len(data):
        raise Corrupt("phrases give another text")
    return bytes(out)


def grammar(data: bytes, rules: int = 768, least: int = 4) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Rules for the commonest pairs, one after another, and the text in symbols; symbol 256 + k is rule k."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int32)  # a copy
    made: list[tuple[int, int]] = []
    while len(made) < rules and len(x) > 1:
        pair = x[:-1] << 16 | x[1:]
        ordered = pair.copy()
        ordered.sort()
        changes = (ordered[1:] != ordered[:-1]).nonzero()[0]
        starts = np.zeros(len(changes) + 2, dtype=np.int64)
        starts[1:-1] = changes + 1
        starts[-1] = len(ordered)
        counts = starts[1:] - starts[:-1]
        k = int(counts.argmax())
        if counts[k] < least:
            break
        kind = int(ordered[starts[k]])
        hit = (pair == kind).nonzero()[0]
        if kind >> 16 == kind & 0xFFFF:  # of overlapping pairs every second
            index = np.arange(len(hit))
            first = np.diff(hit, prepend=-2) != 1
            hit = hit[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            if len(hit) < least:
                break
        x[hit] = 256 + len(made)
        x[hit + 1] = -1
        x = x[x >= 0]
        made.append((kind >> 16, kind & 0xFFFF))
    return made, x


def grammar_encode(data: bytes) -> bytes:
    made, x = grammar(data)
    return put_uvar(len(made)) + b"".join(put_uvar(a) + put_uvar(b) for a, b in made) + put_uvar(len(x)) + b"".join(map(put_uvar, x.tolist()))


def grammar_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    if n > len(data):
        raise Corrupt("there can't be that many rules")
    words = [bytes([i]) for i in range(256)]
    for _ in range(n):
        a, at = get_uvar(data, at)
        b, at = get_uvar(data, at)
        if a >= len(words) or b >= len(words):
            raise Corrupt("a rule uses a later one")
        words.append(words[a] + words[b])
    count, at = get_uvar(data, at)
    out = []
    for _ in range(count):
        s, at = get_uvar(data, at)
        if s >= len(words):
            raise Corrupt("there is no such symbol")
        out.append(words[s])
    if at != len(data):
        raise Corrupt("symbols go on after the text")
    return b"".join(out)
