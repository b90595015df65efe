"""Entropy coders: canonical Huffman, static rANS, clustered rANS, and adaptive range coding."""

from __future__ import annotations

import heapq

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar


def code_lengths(counts: np.ndarray, longest: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``longest`` bits; flatter counts are tried until they fit."""
    counts = counts.astype(np.int64)
    while True:
        lengths = np.zeros(256, dtype=np.int64)
        symbols = np.flatnonzero(counts)
        if len(symbols) == 1:
            lengths[symbols] = 1
            return lengths
        heap = [(n, s, s) for s, n in zip(symbols.tolist(), counts[symbols].tolist(), strict=True)]
        heapq.heapify(heap)
        above, node = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            above[a[2]] = above[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), node))
            node += 1
        depth = {node - 1: 0}
        for k in range(node - 2, 255, -1):
            depth[k] = depth[above[k]] + 1
        lengths[symbols] = [depth[above[s]] + 1 for s in symbols.tolist()]
        if lengths.max() <= longest:
            return lengths
        counts = np.where(counts > 0, counts // 2 + 1, 0)


def by_length(lengths: np.ndarray) -> np.ndarray:
    """The symbols that have a code, in order of length, then symbol."""
    order = np.argsort(lengths, kind="stable")
    return order[len(order) - np.count_nonzero(lengths) :]


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(256, dtype=np.int64)
    order = by_length(lengths)
    step = 1 << 15 - lengths[order]
    codes[order] = (np.cumsum(step) - step) >> 15 - lengths[order]
    return codes


def huffman_encode(data: bytes) -> bytes:
    if not data:
        return put_uvar(0)
    x = np.frombuffer(data, dtype=np.uint8)
    lengths = code_lengths(np.bincount(x, minlength=256))
    codes = canonical_codes(lengths)
    n = lengths[x]
    ends = np.cumsum(n)
    place = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    bits = (np.repeat(codes[x], n) >> (np.repeat(n, n) - 1 - place)) & 1
    table = (lengths[::2] | lengths[1::2] << 4).astype(np.uint8).tobytes()
    return put_uvar(len(data)) + table + np.packbits(bits.astype(np.uint8)).tobytes()


def huffman_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    if not n:
        return b""
    table = np.frombuffer(data[at : at + 128], dtype=np.uint8).astype(np.int64)
    if len(table) < 128:
        raise Corrupt("code table is cut short")
    lengths = np.stack([table & 15, table >> 4], axis=1).reshape(-1)
    codes = canonical_codes(lengths)
    symbols = {(int(lengths[s]), int(codes[s])): int(s) for s in np.flatnonzero(lengths)}
    out, code, size = bytearray(), 0, 0
    for bit in np.unpackbits(np.frombuffer(data[at + 128 :], dtype=np.uint8)).tolist():
        code, size = code << 1 | bit, size + 1
        if (s := symbols.get((size, code))) is not None:
            out.append(s)
            code = size = 0
            if len(out) == n:
                return bytes(out)
        elif size > 15:
            break
    raise Corrupt("codes end before the text does")


SCALE = 12
LOW = 1 << 23


def normalised(counts: np.ndarray, total: int = 1 << SCALE) -> np.ndarray:
    """Counts scaled to ``total`` by largest remainders; every symbol that occurs keeps at least 1."""
    some = np.flatnonzero(counts)
    exact = counts[some] * total / counts.sum()
    freq = np.maximum(1, np.floor(exact).astype(np.int64))
    order = np.argsort(-(exact - np.floor(exact)), kind="stable")
    short = total - int(freq.sum())
    for i in order.tolist()[: max(0, short)]:
        freq[i] += 1
    while (over := int(freq.sum()) - total) > 0:
        i = int(np.argmax(freq))
        freq[i] -= min(over, int(freq[i]) - 1)
    while (under := total - int(freq.sum())) > 0:
        freq[int(np.argmax(freq))] += under
    out = np.zeros(256, dtype=np.int64)
    out[some] = freq
    return out


def rans_encode(data: bytes) -> bytes:
    """One state of 32 bits with byte-wise renormalisation; symbols are coded last to first."""
    if not data:
        return put_uvar(0)
    x = np.frombuffer(data, dtype=np.uint8)
    freq = normalised(np.bincount(x, minlength=256))
    start = (np.cumsum(freq) - freq).tolist()
    f = freq.tolist()
    state, out = LOW, bytearray()
    for s in data[::-1]:
        n = f[s]
        most = (LOW >> SCALE << 8) * n
        while state >= most:
            out.append(state & 255)
            state >>= 8
        state = (state // n << SCALE) + state % n + start[s]
    head = b"".join(bytes([s]) + put_uvar(f[s]) for s in np.flatnonzero(freq).tolist())
    return put_uvar(len(data)) + bytes([int((freq > 0).sum()) - 1]) + head + state.to_bytes(4, "big") + bytes(out[::-1])


def rans_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    if not n:
        return b""
    if at >= len(data):
        raise Corrupt("no table")
    kinds, at = data[at] + 1, at + 1
    slot = np.full(1 << SCALE, -1, dtype=np.int64)
    f, start, total = [0] * 256, [0] * 256, 0
    for _ in range(kinds):
        if at >= len(data):
            raise Corrupt("table is cut short")
        s = data[at]
        f[s], at = get_uvar(data, at + 1)
        start[s] = total
        slot[total : total + f[s]] = s
        total += f[s]
    if total != 1 << SCALE or at + 4 > len(data):
        raise Corrupt("table doesn't add up")
    lookup = slot.tolist()
    state, at, out = int.from_bytes(data[at : at + 4], "big"), at + 4, bytearray()
    mask = (1 << SCALE) - 1
    for _ in range(n):
        low = state & mask
        s = lookup[low]
        out.append(s)
        state = f[s] * (state >> SCALE) + low - start[s]
        while state < LOW:
            if at >= len(data):
                raise Corrupt("codes end before the text does")
            state = state << 8 | data[at]
            at += 1
    if state != LOW or at != len(data):
        raise Corrupt("codes go on after the text")
    return bytes(out)


def context_groups(x: np.ndarray, groups: int = 12, rounds: int = 3) -> np.ndarray:
    """A group for each previous byte: contexts whose next bytes are distributed alike, by cosine, in a few Lloyd rounds."""
    hist = np.zeros((256, 256))
    np.add.at(hist, (np.concatenate([[0], x[:-1]]), x), 1)
    weight = hist.sum(axis=1)
    used = np.flatnonzero(weight)
    unit = hist / np.maximum(np.linalg.norm(hist, axis=1, keepdims=True), 1e-12)
    of = np.zeros(256, dtype=np.uint8)
    centre = unit[used[np.argsort(-weight[used], kind="stable")][:groups]]
    for _ in range(rounds):
        of[used] = np.argmax(unit[used] @ centre.T, axis=1)
        sums = np.stack([hist[used][of[used] == g].sum(axis=0) for g in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return of


def clustered_encode(data: bytes, groups: int = 12) -> bytes:
    """A rANS stream per group of contexts of one byte."""
    if len(data) < 2:
        return put_uvar(0) + data
    x = np.frombuffer(data, dtype=np.uint8)
    of = context_groups(x, groups)
    own = of[np.concatenate([[0], x[:-1]])]
    out = put_uvar(int(of.max()) + 1) + of.tobytes()
    for g in range(int(of.max()) + 1):
        stream = rans_encode(x[own == g].tobytes())
        out += put_uvar(len(stream)) + stream
    return out


def clustered_decode(data: bytes) -> bytes:
    groups, at = get_uvar(data, 0)
    if not groups:
        return data[at:]
    of = data[at : at + 256]
    at += 256
    streams = []
    for _ in range(groups):
        n, at = get_uvar(data, at)
        streams.append(iter(rans_decode(data[at : at + n])))
        at += n
    total = sum(s.__length_hint__() for s in streams)
    out, before = bytearray(), 0
    for _ in range(total):
        before = next(streams[of[before]], None)
        if before is None:
            raise Corrupt("a context's stream is too short")
        out.append(before)
    return bytes(out)


class Model:
    """Adaptive frequencies in a Fenwick tree, halved when they reach ``most``."""

    def __init__(self, most: int = 32_768, step: int = 32):
        self.most, self.step = most, step
        self.freq = [1] * 256
        self._build()

    def _build(self) -> None:
        self.total = sum(self.freq)
        self.tree = [0] * 257
        for i, f in enumerate(self.freq, 1):
            self.tree[i] += f
            if (j := i + (i & -i)) <= 256:
                self.tree[j] += self.tree[i]

    def below(self, s: int) -> int:
        total = 0
        while s:
            total += self.tree[s]
            s &= s - 1
        return total

    def find(self, value: int) -> tuple[int, int]:
        """The symbol whose range holds ``value``, and where its range begins."""
        at, low, bit = 0, 0, 256
        while bit:
            if at + bit <= 256 and low + self.tree[at + bit] <= value:
                at += bit
                low += self.tree[at]
            bit >>= 1
        return at, low

    def seen(self, s: int) -> None:
        self.freq[s] += self.step
        self.total += self.step
        i = s + 1
        while i <= 256:
            self.tree[i] += self.step
            i += i & -i
        if self.total >= self.most:
            self.freq = [(f + 1) // 2 for f in self.freq]
            self._build()


TOP, BOTTOM, MASK = 1 << 24, 1 << 16, 0xFFFFFFFF


class Contexts:
    """Which model codes the next byte: one for all, or that of the byte before once it has been seen ``gate`` times.

    No gate is order 0, a gate of 0 is order 1. A first byte has the common model.
    """

    def __init__(self, gate: int | None = None):
        self.gate, self.common = gate, Model()
        self.own: list[Model | None] = [None] * 256
        self.times = [0] * 256

    def after(self, before: int | None) -> Model:
        if self.gate is None or before is None:
            return self.common
        self.times[before] += 1
        if self.times[before] <= self.gate:
            return self.common
        if self.own[before] is None:
            self.own[before] = Model()
        return self.own[before]


def arithmetic_encode(data: bytes, gate: int | None = None) -> bytes:
    """Carry-less range coding under adaptive models, of order 0 unless there is a gate."""
    contexts, before, low, span, out = Contexts(gate), None, 0, MASK, bytearray()
    for s in data:
        model, before = contexts.after(before), s
        span //= model.total
        low = low + span * model.below(s) & MASK
        span *= model.freq[s]
        while (low ^ low + span) < TOP or span < BOTTOM:
            if (low ^ low + span) >= TOP:
                span = -low & BOTTOM - 1
            out.append(low >> 24)
            low, span = low << 8 & MASK, span << 8 & MASK
        model.seen(s)
    return put_uvar(len(data)) + bytes(out) + low.to_bytes(4, "big")


def arithmetic_decode(data: bytes, gate: int | None = None) -> bytes:
    n, at = get_uvar(data, 0)
    if len(data) < at + 4:
        raise Corrupt("no codes")
    contexts, before, low, span, out = Contexts(gate), None, 0, MASK, bytearray()
    code, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(n):
        model = contexts.after(before)
        span //= model.total
        s, start = model.find(min((code - low & MASK) // span, model.total - 1))
        out.append(s)
        before = s
        low = low + span * start & MASK
        span *= model.freq[s]
        while (low ^ low + span) < TOP or span < BOTTOM:
            if (low ^ low + span) >= TOP:
                span = -low & BOTTOM - 1
            if at >= len(data):
                raise Corrupt("codes end before the text does")
            code = code << 8 & MASK | data[at]
            at += 1
            low, span = low << 8 & MASK, span << 8 & MASK
        model.seen(s)
    if at != len(data):
        raise Corrupt("codes go on after the text")
    return bytes(out)


#: The literal modes by number and the times a byte has to be seen before it is a context of its own.
LITERAL_MODES = {1: None, 2: 0, 3: 4, 4: 8, 5: 16}


def literal_encode(data: bytes, mode: int | None = None) -> bytes:
    """A literal mode and the codes under it; without a mode the one of fewest bytes, ties to the lower number."""
    modes = sorted(LITERAL_MODES) if mode is None else [mode]
    return min((bytes([m]) + arithmetic_encode(data, LITERAL_MODES[m]) for m in modes), key=len)


def literal_decode(data: bytes) -> bytes:
    if not data or data[0] not in LITERAL_MODES:
        raise Corrupt("no such literal mode")
    return arithmetic_decode(data[1:], LITERAL_MODES[data[0]])
