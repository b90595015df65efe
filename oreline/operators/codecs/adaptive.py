"""Adaptive range coding of many blocks at once: every block is a lane with models of its own, and a step codes one byte of each.

The bytes are those of the one-block coder in ``entropy``, which defines them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar
from oreline.operators.codecs.entropy import BOTTOM, LITERAL_MODES, MASK, TOP, Model, arithmetic_decode
from oreline.operators.codecs.lanes import active, by_length, matrix

#: Lanes that are coded at once; each has up to 257 models of a kilobyte.
LANES = 768
#: Bytes of text in all lanes, padding included, and of the longest text that is decoded in a lane.
LANE_BYTES, LONGEST = 1 << 24, 1 << 20
MOST, STEP = (lambda m: (m.most, m.step))(Model())
AFTER = (np.arange(16)[None, :] > np.arange(16)[:, None]).astype(np.uint16) * np.uint16(STEP)


def how_many(held: np.ndarray) -> np.ndarray:
    """How many of each row's 16 booleans hold."""
    bits = np.bitwise_count(held.view(np.uint64)).astype(np.int64)
    return bits[:, 0] + bits[:, 1]


class Models:
    """Many models: counts, and running sums over sixteenths of the bytes and within each sixteenth."""

    def __init__(self, count: int):
        self.used = 0
        self.freq = np.empty((0, 256), dtype=np.uint16)
        self.within, self.coarse, self.total = self.freq.reshape(0, 16), self.freq[:, :16], np.empty(0, dtype=np.int64)
        self.more(count)

    def more(self, count: int) -> np.ndarray:
        """The numbers of ``count`` new models, in which every byte counts once."""
        new = np.arange(self.used, self.used + count)
        self.used += count
        if self.used > len(self.total):
            size = max(self.used, len(self.total) * 3 // 2)
            grown = []
            for a, rows in ((self.freq, size), (self.within, size * 16), (self.coarse, size), (self.total, size)):
                b = np.empty((rows, *a.shape[1:]), dtype=a.dtype)
                b[: len(a)] = a
                grown.append(b)
            self.freq, self.within, self.coarse, self.total = grown
        self.freq[new] = 1
        self.within.reshape(-1, 256)[new] = np.tile(np.arange(16, dtype=np.uint16), 16)
        self.coarse[new] = np.arange(0, 256, 16, dtype=np.uint16)
        self.total[new] = 256
        return new

    def range_of(self, model: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each byte's range begins, and its count."""
        at = model * 256 + s
        below = self.coarse.reshape(-1)[at >> 4].astype(np.int64) + self.within.reshape(-1)[at]
        return below, self.freq.reshape(-1)[at].astype(np.int64)

    def find(self, model: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The byte whose range holds each value."""
        value = value.astype(np.uint16)
        coarse = self.coarse[model]
        group = how_many(coarse <= value[:, None]) - 1
        rest = value - coarse[np.arange(len(model)), group]
        return group * 16 + how_many(self.within[model * 16 + group] <= rest[:, None]) - 1

    def seen(self, model: np.ndarray, s: np.ndarray) -> None:
        """Count a byte in each of some different models."""
        at = model * 256 + s
        self.freq.reshape(-1)[at] += np.uint16(STEP)
        self.within[at >> 4] += AFTER[s & 15]
        self.coarse[model] += AFTER[s >> 4]
        total = self.total[model] + STEP
        self.total[model] = total
        full = model[total >= MOST]
        if full.size:
            half = (self.freq[full] + np.uint16(1)) // np.uint16(2)
            self.freq[full] = half
            parts = half.reshape(-1, 16, 16)
            self.within.reshape(-1, 16, 16)[full] = np.cumsum(parts, axis=2, dtype=np.uint16) - parts
            sums = parts.sum(axis=2, dtype=np.uint16)
            self.coarse[full] = np.cumsum(sums, axis=1, dtype=np.uint16) - sums
            self.total[full] = half.sum(axis=1, dtype=np.int64)


class LaneContexts:
    """``entropy.Contexts`` of many lanes."""

    def __init__(self, lanes: int, gate: int | None):
        self.gate, self.models = gate, Models(lanes)
        self.own = np.full(lanes * 256 if gate is not None else 0, -1, dtype=np.int64)
        self.times = np.zeros(len(self.own), dtype=np.int64)
        self.base = np.arange(lanes) * 256

    def after(self, k: int, before: np.ndarray | None) -> np.ndarray:
        """The models of the first k lanes' next bytes; the first ``lanes`` models are the common ones."""
        if self.gate is None or before is None:
            return np.arange(k)
        at = self.base[:k] + before[:k]
        times = self.times[at] + 1
        self.times[at] = times
        model = np.arange(k)
        ready = np.flatnonzero(times > self.gate)
        if ready.size:
            own = self.own[at[ready]]
            new = own < 0
            if new.any():
                own[new] = self.models.more(int(new.sum()))
                self.own[at[ready]] = own
            model[ready] = own
        return model


def encode_lanes(blocks: list[bytes], gate: int | None) -> list[bytes]:
    out = [put_uvar(0) + bytes(4)] * len(blocks)
    some = [i for i, b in enumerate(blocks) if b]
    if not some:
        return out
    lanes = [some[k] for k in by_length([blocks[i] for i in some])]
    x = matrix([blocks[i] for i in lanes])
    counts = active(np.array([len(blocks[i]) for i in lanes]), len(x))
    contexts, before = LaneContexts(len(lanes), gate), None
    low, span = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), MASK, dtype=np.int64)
    width = 2 * len(x) + 16
    written, at = np.zeros(len(lanes) * width, dtype=np.uint8), np.arange(len(lanes)) * width
    for t, k in enumerate(counts):
        s = x[t, :k].astype(np.int64)
        model = contexts.after(k, before)
        below, freq = contexts.models.range_of(model, s)
        part = span[:k] // contexts.models.total[model]
        lo, sp = low[:k] + part * below & MASK, part * freq
        apart = (lo ^ lo + sp) >= TOP
        some = np.flatnonzero(~apart | (sp < BOTTOM))
        while some.size:
            a, b, other = lo[some], sp[some], apart[some]
            b = np.where(other, -a & BOTTOM - 1, b)
            place = at[some]
            written[place] = a >> 24
            at[some] = place + 1
            a, b = a << 8 & MASK, b << 8 & MASK
            lo[some], sp[some] = a, b
            apart[some] = other = (a ^ a + b) >= TOP
            some = some[~other | (b < BOTTOM)]
        low[:k], span[:k] = lo, sp
        contexts.models.seen(model, s)
        before = s
    for lane, i in enumerate(lanes):
        out[i] = put_uvar(len(blocks[i])) + written[lane * width : at[lane]].tobytes() + int(low[lane]).to_bytes(4, "big")
    return out


def claimed(payload: bytes) -> tuple[int, int]:
    """How long a payload says that its text is and where its codes begin; 0 where it says nothing."""
    try:
        return get_uvar(payload, 0)
    except Corrupt:
        return 0, 0


def decode_lanes(payloads: list[bytes], gate: int | None) -> list[bytes]:
    """The blocks; a payload that isn't whole is left to the one-block decoder, which says what is wrong."""
    out: list[bytes | None] = [None] * len(payloads)
    parsed = []
    for i, p in enumerate(payloads):
        n, start = claimed(p)
        if 0 < n <= LONGEST and len(p) >= start + 4:
            parsed.append((n, i, p[start:]))
    parsed.sort(key=lambda r: -r[0])
    if parsed:
        sizes = np.array([len(r[2]) for r in parsed])
        data = np.zeros((len(parsed), int(sizes.max()) + 1), dtype=np.uint8)
        for lane, r in enumerate(parsed):
            data[lane, : len(r[2])] = np.frombuffer(r[2], dtype=np.uint8)
        limit = data.shape[1] - 1
        code = data[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        at = np.full(len(parsed), 4, dtype=np.int64)
        contexts, before = LaneContexts(len(parsed), gate), None
        low, span = np.zeros(len(parsed), dtype=np.int64), np.full(len(parsed), MASK, dtype=np.int64)
        text = np.zeros((parsed[0][0], len(parsed)), dtype=np.uint8)
        for t, k in enumerate(active(np.array([r[0] for r in parsed]), len(text))):
            if t % 1024 == 1023 and (at[:k] > sizes[:k]).all():  # claims only
                break
            model = contexts.after(k, before)
            total = contexts.models.total[model]
            part = np.maximum(span[:k] // total, 1)  # no encoder lets it be 0; such a lane is found out at its end
            s = contexts.models.find(model, np.minimum((code[:k] - low[:k] & MASK) // part, total - 1))
            text[t, :k] = s
            below, freq = contexts.models.range_of(model, s)
            lo, sp, co = low[:k] + part * below & MASK, part * freq, code[:k]
            apart = (lo ^ lo + sp) >= TOP
            some = np.flatnonzero(~apart | (sp < BOTTOM))
            while some.size:
                a, b, other, place = lo[some], sp[some], apart[some], at[some]
                b = np.where(other, -a & BOTTOM - 1, b)
                co[some] = co[some] << 8 & MASK | data[some, np.minimum(place, limit)]
                at[some] = place + 1
                a, b = a << 8 & MASK, b << 8 & MASK
                lo[some], sp[some] = a, b
                apart[some] = other = (a ^ a + b) >= TOP
                some = some[(~other | (b < BOTTOM)) & (place < sizes[some])]
            low[:k], span[:k] = lo, sp
            contexts.models.seen(model, s)
            before = s
        for lane, (n, i, _) in enumerate(parsed):
            if at[lane] == sizes[lane]:
                out[i] = text[:n, lane].tobytes()
    return [arithmetic_decode(p, gate) if b is None else b for b, p in zip(out, payloads, strict=True)]


def by_lanes(run: Callable[[list[bytes], int | None], list[bytes]], items: list[bytes], sizes: list[int], gate: int | None) -> list[bytes]:
    """``run`` over up to ``LANES`` items whose texts are of about one size, and of bounded size in all; results in the items' order."""
    out: list[bytes] = [b""] * len(items)
    order, lo = np.argsort(-np.array(sizes, dtype=np.int64), kind="stable").tolist(), 0
    while lo < len(order):
        lanes = LANES if gate is not None else 4 * LANES  # without contexts a lane has one model
        some = order[lo : lo + max(1, min(lanes, LANE_BYTES // max(1, sizes[order[lo]])))]
        for i, found in zip(some, run([items[i] for i in some], gate), strict=True):
            out[i] = found
        lo += len(some)
    return out


def encode_all(blocks: list[bytes], gate: int | None = None) -> list[bytes]:
    return by_lanes(encode_lanes, blocks, list(map(len, blocks)), gate)


def decode_all(payloads: list[bytes], gate: int | None = None) -> list[bytes]:
    return by_lanes(decode_lanes, payloads, [min(claimed(p)[0], LONGEST + 1) for p in payloads], gate)


def literal_encode_all(blocks: list[bytes]) -> list[bytes]:
    """``entropy.literal_encode`` of each block, a mode at a time."""
    best: list[bytes] | None = None
    for m in sorted(LITERAL_MODES):
        coded = [bytes([m]) + p for p in encode_all(blocks, LITERAL_MODES[m])]
        best = coded if best is None else [min(a, b, key=len) for a, b in zip(best, coded, strict=True)]
    return best


def literal_decode_all(payloads: list[bytes]) -> list[bytes]:
    out: list[bytes] = [b""] * len(payloads)
    if any(not p or p[0] not in LITERAL_MODES for p in payloads):
        raise Corrupt("no such literal mode")
    for m, gate in LITERAL_MODES.items():
        some = [i for i, p in enumerate(payloads) if p[0] == m]
        for i, plain in zip(some, decode_all([payloads[i][1:] for i in some], gate), strict=True):
            out[i] = plain
    return out
