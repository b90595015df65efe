"""Payloads of typed leaves and of shape carriers, and their decoders."""

from __future__ import annotations

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, pack, put_uvar, unpack
from oreline.operators.codecs.tokens import unzigzag, zigzag


def canonical(tokens: list[str]) -> list[int] | None:
    """The tokens as numbers if each is the plain form of a 62-bit number."""
    out = []
    for t in tokens:
        if not (t.lstrip("-").isdigit() and t.isascii()) or str(v := int(t)) != t or not -(1 << 61) < v < 1 << 61:
            return None
        out.append(v)
    return out


def packed(values: list[int]) -> bytes:
    """Offsets from the least value, with their width before them."""
    low = min(values)
    width = (max(values) - low).bit_length()
    return put_uvar(zigzag(low)) + bytes([width]) + pack(np.array([v - low for v in values], dtype=np.uint64), width)


def unpacked(data: bytes, at: int, count: int) -> list[int]:
    low, at = get_uvar(data, at)
    if at >= len(data):
        raise Corrupt("no width")
    return [int(x) + unzigzag(low) for x in unpack(data[at + 1 :], count, data[at])]


def steps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip(values[:-1], values[1:], strict=True)]


def summed(first: int, deltas: list[int]) -> list[int]:
    out = [first]
    for d in deltas:
        out.append(out[-1] + d)
    return out


def framed(tokens: list[str]) -> bytes:
    return b"".join(put_uvar(len(b)) + b for b in (t.encode() for t in tokens))


def unframed(data: bytes, at: int, count: int) -> tuple[list[str], int]:
    out = []
    for _ in range(count):
        n, at = get_uvar(data, at)
        if at + n > len(data):
            raise Corrupt("a token is cut short")
        try:
            out.append(data[at : at + n].decode())
        except UnicodeDecodeError as e:
            raise Corrupt("a token isn't text") from e
        at += n
    return out, at


def leaf_encode(leaf_id: int, tokens: list[str]) -> bytes | None:
    """A leaf's payload, or None if it can't hold the tokens. Ids are those of the leaf registry."""
    if leaf_id == 0:
        return framed(tokens)
    if leaf_id == 1:
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        width = (len(kinds) - 1).bit_length() if len(kinds) > 1 else 0
        return put_uvar(len(kinds)) + framed(list(kinds)) + bytes([width]) + pack(np.array([kinds[t] for t in tokens], dtype=np.uint64), width)
    v = canonical(tokens)
    if v is None or len(v) < leaf_id - 1:
        return None
    if leaf_id == 2:
        return packed(v)
    if leaf_id == 3:
        return put_uvar(zigzag(v[0])) + packed(steps(v))
    return put_uvar(zigzag(v[0])) + put_uvar(zigzag(v[1] - v[0])) + packed(steps(steps(v)))


def leaf_decode(leaf_id: int, data: bytes, count: int) -> list[str]:
    if leaf_id == 0:
        tokens, at = unframed(data, 0, count)
        if at != len(data):
            raise Corrupt("bytes follow the tokens")
        return tokens
    if leaf_id == 1:
        n, at = get_uvar(data, 0)
        if n > len(data):
            raise Corrupt("there can't be that many kinds")
        kinds, at = unframed(data, at, n)
        if at >= len(data):
            raise Corrupt("no width")
        ids = unpack(data[at + 1 :], count, data[at])
        if len(ids) and int(ids.max()) >= n:
            raise Corrupt("there is no such kind")
        return [kinds[int(i)] for i in ids]
    if leaf_id == 2:
        return list(map(str, unpacked(data, 0, count)))
    first, at = get_uvar(data, 0)
    if leaf_id == 3:
        return list(map(str, summed(unzigzag(first), unpacked(data, at, count - 1))))
    second, at = get_uvar(data, at)
    return list(map(str, summed(unzigzag(first), summed(unzigzag(second), unpacked(data, at, count - 2)))))


def region_encode(records: list[str], parse) -> bytes:
    """Lines by shape, their values column by column under each column's cheapest leaf; lines that don't parse are one raw region.

    ``parse`` gives a text's scalar spans or None. The order of lines is kept by an id per line, 0 for the raw region.
    """
    shapes: dict[tuple[str, ...], list[list[str]]] = {}
    order: list[int] = []
    raw: list[str] = []
    for text in records:
        spans = parse(text)
        if spans is None:
            raw.append(text)
            order.append(0)
            continue
        edges = [0, *(x for s in spans for x in s), len(text)]
        parts = tuple(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        shapes.setdefault(parts, []).append([text[a:b] for a, b in spans])
        order.append(1 + list(shapes).index(parts))
    out = put_uvar(len(records)) + b"".join(map(put_uvar, order)) + put_uvar(len(shapes)) + put_uvar(len(raw)) + framed(raw)
    for parts, rows in shapes.items():
        out += put_uvar(len(parts)) + framed(list(parts)) + put_uvar(len(rows))
        for column in zip(*rows, strict=True):
            found = [(len(p), i, p) for i in range(5) if (p := leaf_encode(i, list(column))) is not None]
            size, leaf, payload = min(found, key=lambda x: x[:2])
            out += bytes([leaf]) + put_uvar(size) + payload
    return out


def region_decode(data: bytes) -> list[str]:
    n, at = get_uvar(data, 0)
    if n > len(data):
        raise Corrupt("there can't be that many lines")
    order = []
    for _ in range(n):
        x, at = get_uvar(data, at)
        order.append(x)
    shapes, at = get_uvar(data, at)
    count, at = get_uvar(data, at)
    raw, at = unframed(data, at, count)
    queues = [iter(raw)]
    for _ in range(shapes):
        k, at = get_uvar(data, at)
        parts, at = unframed(data, at, k)
        rows, at = get_uvar(data, at)
        columns = []
        for _ in range(k - 1):
            if at >= len(data):
                raise Corrupt("a column is missing")
            leaf = data[at]
            size, at = get_uvar(data, at + 1)
            if at + size > len(data):
                raise Corrupt("a column is cut short")
            columns.append(leaf_decode(leaf, data[at : at + size], rows))
            at += size
        lines = []
        for r in range(rows):
            lines.append("".join(a + b for a, b in zip(parts, [*(c[r] for c in columns), ""], strict=True)))
        queues.append(iter(lines))
    if at != len(data):
        raise Corrupt("bytes follow the last column")
    out = [next(queues[x], None) if x < len(queues) else None for x in order]
    if None in out or any(next(q, None) is not None for q in queues):
        raise Corrupt("lines and shapes don't agree")
    return out
