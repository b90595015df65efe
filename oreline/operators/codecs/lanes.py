"""Entropy coders over many blocks at once: every block is a lane, and a step codes one symbol of each.

The bytes are those of the one-block coder; only the loop runs over positions instead of over bytes.
"""

from __future__ import annotations

import numpy as np

from oreline.operators.codecs import entropy
from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar
from oreline.operators.codecs.entropy import LOW, SCALE, normalised, rans_decode

MASK = (1 << SCALE) - 1


def by_length(blocks: list[bytes]) -> np.ndarray:
    """Longest first, so that the lanes still active at a step are a prefix."""
    return np.argsort(-np.array(list(map(len, blocks))), kind="stable")


def matrix(blocks: list[bytes]) -> np.ndarray:
    """Blocks as rows, padded with zeros, a column per position."""
    lengths = np.array(list(map(len, blocks)))
    out = np.zeros((int(lengths.max()), len(blocks)), dtype=np.uint8)
    for i, b in enumerate(blocks):
        out[: len(b), i] = np.frombuffer(b, dtype=np.uint8)
    return out


def active(lengths: np.ndarray, steps: int) -> list[int]:
    """How many lanes, longest first, are longer than each step."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def encode_all(blocks: list[bytes]) -> list[bytes]:
    some = [i for i, b in enumerate(blocks) if b]
    out = [put_uvar(0)] * len(blocks)
    if not some:
        return out
    lanes = [some[k] for k in by_length([blocks[i] for i in some])]
    x = matrix([blocks[i] for i in lanes])
    lengths = np.array([len(blocks[i]) for i in lanes])
    freq = np.stack([normalised(np.bincount(np.frombuffer(blocks[i], dtype=np.uint8), minlength=256)) for i in lanes])
    start = np.cumsum(freq, axis=1) - freq
    flat_f, flat_s, base = freq.reshape(-1), start.reshape(-1), np.arange(len(lanes)) * 256
    state = np.full(len(lanes), LOW, dtype=np.int64)
    written = np.zeros((len(lanes), int(lengths.max()) * 2 + 8), dtype=np.uint8)
    at = np.zeros(len(lanes), dtype=np.int64)
    counts = active(lengths, len(x))
    for t in range(len(x) - 1, -1, -1):
        k = counts[t]
        slot = base[:k] + x[t, :k]
        n, s = flat_f[slot], state[:k]
        most = (LOW >> SCALE << 8) * n
        while (full := np.flatnonzero(s >= most)).size:
            written[full, at[full]] = s[full] & 255
            at[full] += 1
            s[full] >>= 8
        quotient = s // n
        state[:k] = (quotient << SCALE) + (s - quotient * n) + flat_s[slot]
    for lane, i in enumerate(lanes):
        f = freq[lane]
        kinds = np.flatnonzero(f).tolist()
        head = b"".join(bytes([c]) + put_uvar(int(f[c])) for c in kinds)
        out[i] = put_uvar(len(blocks[i])) + bytes([len(kinds) - 1]) + head + int(state[lane]).to_bytes(4, "big") + written[lane, : at[lane]][::-1].tobytes()
    return out


def decode_all(payloads: list[bytes]) -> list[bytes]:
    """The blocks; a payload that isn't whole is left to the one-block decoder, which says what is wrong."""
    out: list[bytes | None] = [None] * len(payloads)
    parsed = []
    for i, p in enumerate(payloads):
        try:
            n, at = get_uvar(p, 0)
            if not n:
                out[i] = b""
                continue
            kinds, at = p[at] + 1, at + 1
            f = np.zeros(256, dtype=np.int64)
            order = []
            for _ in range(kinds):
                c = p[at]
                f[c], at = get_uvar(p, at + 1)
                order.append(c)
            if int(f.sum()) != 1 << SCALE or order != sorted(set(order)) or at + 4 > len(p):
                continue
            parsed.append((n, i, f, int.from_bytes(p[at : at + 4], "big"), p[at + 4 :]))
        except (Corrupt, IndexError):
            continue
    parsed.sort(key=lambda r: -r[0])
    if parsed:
        lengths = np.array([r[0] for r in parsed])
        freq = np.stack([r[2] for r in parsed])
        start = (np.cumsum(freq, axis=1) - freq).reshape(-1)
        lookup = np.stack([np.repeat(np.arange(256, dtype=np.uint8), f) for f in freq]).reshape(-1)
        flat_f = freq.reshape(-1)
        state = np.array([r[3] for r in parsed], dtype=np.int64)
        sizes = np.array([len(r[4]) for r in parsed])
        data = np.zeros((len(parsed), int(sizes.max()) + 4), dtype=np.uint8)
        for lane, r in enumerate(parsed):
            data[lane, : len(r[4])] = np.frombuffer(r[4], dtype=np.uint8)
        text = np.zeros((int(lengths.max()), len(parsed)), dtype=np.uint8)
        at = np.zeros(len(parsed), dtype=np.int64)
        base, table = np.arange(len(parsed)) * 256, np.arange(len(parsed)) << SCALE
        limit = data.shape[1] - 1
        for t, k in enumerate(active(lengths, len(text))):
            s = state[:k]
            low = s & MASK
            symbol = lookup[table[:k] + low]
            text[t, :k] = symbol
            slot = base[:k] + symbol
            s = flat_f[slot] * (s >> SCALE) + low - start[slot]
            for _ in range(2):
                short = np.flatnonzero(s < LOW)
                if not short.size:
                    break
                s[short] = s[short] << 8 | data[short, np.minimum(at[short], limit)]
                at[short] += 1
            state[:k] = s
        for lane, (n, i, *_) in enumerate(parsed):
            if state[lane] == LOW and at[lane] == sizes[lane]:
                out[i] = text[:n, lane].tobytes()
    return [rans_decode(p) if b is None else b for b, p in zip(out, payloads, strict=True)]


def huffman_decode_all(payloads: list[bytes]) -> list[bytes]:
    """The blocks; a payload that isn't whole is left to the one-block decoder, which says what is wrong."""
    out: list[bytes | None] = [None] * len(payloads)
    parsed = []
    for i, p in enumerate(payloads):
        try:
            n, at = get_uvar(p, 0)
        except Corrupt:
            continue
        if not n:
            out[i] = b""
        elif len(p) > at + 128 and n <= 8 * (len(p) - at - 128):
            parsed.append((n, i, p[at : at + 128], p[at + 128 :]))
    parsed.sort(key=lambda r: -r[0])
    if parsed:
        symbols, sizes, widths = [], [], []
        for _, _, table, _ in parsed:
            packed = np.frombuffer(table, dtype=np.uint8).astype(np.int64)
            lengths = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1)
            order = entropy.by_length(lengths)
            width = int(lengths.max())
            each = 1 << width - lengths[order]
            entries = 1 << width
            padding = np.full(max(0, entries - int(each.sum())), 255)  # no code: ends beyond the bits
            symbols.append(np.concatenate([np.repeat(order, each), padding])[:entries].astype(np.uint8))
            sizes.append(np.concatenate([np.repeat(lengths[order], each), padding + (1 << 40)])[:entries])
            widths.append(width)
        symbol, size, width = np.concatenate(symbols), np.concatenate(sizes), np.array(widths)
        first = np.cumsum([0, *map(len, symbols)])[:-1]
        bodies = [len(r[3]) for r in parsed]
        flat = np.frombuffer(b"".join(r[3] for r in parsed) + bytes(3), dtype=np.uint8).astype(np.int64)
        three = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        place = np.cumsum([0, *bodies])[:-1] * 8
        end = place + np.array(bodies) * 8
        last, shift, mask = len(three) - 1, 24 - width, (1 << width) - 1
        text = np.zeros((parsed[0][0], len(parsed)), dtype=np.uint8)
        for t, k in enumerate(active(np.array([r[0] for r in parsed]), len(text))):
            at = place[:k]
            entry = first[:k] + (three[np.minimum(at >> 3, last)] >> shift[:k] - (at & 7) & mask[:k])
            text[t, :k] = symbol[entry]
            place[:k] += size[entry]
        for lane, (n, i, *_) in enumerate(parsed):
            if place[lane] <= end[lane]:
                out[i] = text[:n, lane].tobytes()
    return [entropy.huffman_decode(p) if b is None else b for b, p in zip(out, payloads, strict=True)]
