"""Richer parses: matches with corrections, words copied with a constant added, and separated token streams."""

from __future__ import annotations

import numpy as np

from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar
from oreline.operators.codecs.matches import LEAST, greedy_tokens, matches_at
from oreline.operators.codecs.parses import greedy_all


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -(n + 1) >> 1


def corrected(data: bytes, i: int, distance: int, length: int, most: int = 4, after: int = 4) -> tuple[int, list[int]]:
    """A match extended over up to ``most`` other bytes, each followed by ``after`` equal ones: its length and their offsets."""
    n, wrong = length, []
    while len(wrong) < most and i + n + after < len(data):
        rest = data[i + n + 1 : i + n + 1 + after]
        if rest != data[i + n + 1 - distance : i + n + 1 - distance + after] or n + 1 + after > distance + n:
            break
        wrong.append(n)
        n += 1
        while i + n < len(data) and data[i + n] == data[i + n - distance]:
            n += 1
    return n, wrong


def sparse_encode(data: bytes, window: int = 1 << 16) -> bytes:
    """Literal runs and matches with sparse corrections."""
    heads: dict[bytes, list[int]] = {}
    out, i, run = bytearray(put_uvar(len(data))), 0, 0

    def literals(to: int) -> None:
        if run < to:
            out.extend(put_uvar(to - run << 1) + data[run:to])

    while i < len(data):
        best: tuple[int, int, list[int]] = (0, 0, [])
        for length, distance in matches_at(data, heads, i, window, 3):
            if length >= LEAST and distance > 8:
                size, wrong = corrected(data, i, distance, length)
                if size - 2 * len(wrong) > best[0] - 2 * len(best[2]):
                    best = (size, distance, wrong)
            elif length > best[0]:
                best = (length, distance, [])
        size, distance, wrong = best
        step = size if size >= LEAST else 1
        if step > 1:
            literals(i)
            out += put_uvar(size << 1 | 1) + put_uvar(distance) + put_uvar(len(wrong))
            before = 0
            for w in wrong:
                out += put_uvar(w - before) + data[i + w : i + w + 1]
                before = w
            run = i + step
        for k in range(i, min(i + step, len(data) - LEAST + 1)):
            heads.setdefault(data[k : k + LEAST], []).append(k)
        i += step
    literals(len(data))
    return bytes(out)


def sparse_decode(data: bytes) -> bytes:
    n, at = get_uvar(data, 0)
    out = bytearray()
    while len(out) < n:
        x, at = get_uvar(data, at)
        size = x >> 1
        if not size:
            raise Corrupt("an empty token")
        if x & 1:
            distance, at = get_uvar(data, at)
            count, at = get_uvar(data, at)
            if not 0 < distance <= len(out) or count > size:
                raise Corrupt("a match reaches before the text")
            start, before, fixes = len(out), 0, {}
            for _ in range(count):
                step, at = get_uvar(data, at)
                before += step
                if at >= len(data):
                    raise Corrupt("a correction is missing")
                fixes[before] = data[at]
                at += 1
            for k in range(size):
                out.append(fixes[k] if k in fixes else out[start + k - distance])
        else:
            out += data[at : at + size]
            at += size
    if len(out) != n or at != len(data):
        raise Corrupt("tokens give another text")
    return bytes(out)


def arithmetic_runs(words: np.ndarray, least: int = 3) -> list[tuple[int, int, int, int]]:
    """Runs (at, length, distance, added) of words that repeat earlier ones with a constant added, longest first found, not overlapping.

    Two neighbouring differences are the key by which earlier places are found.
    """
    d = (words[1:] - words[:-1]) & 0xFFFFFFFF
    seen: dict[tuple[int, int], int] = {}
    diffs, runs, i = d.tolist(), [], 0
    while i < len(diffs) - 1:
        j = seen.get((diffs[i], diffs[i + 1]))
        if j is not None:
            n = 2
            while i + n < len(diffs) and diffs[i + n] == diffs[j + n]:
                n += 1
            if n + 1 >= least:
                runs.append((i, n + 1, i - j, int(words[i] - words[j]) & 0xFFFFFFFF))
                for k in range(i, min(i + n + 1, len(diffs) - 1)):
                    seen[(diffs[k], diffs[k + 1])] = k
                i += n + 1
                continue
        seen[(diffs[i], diffs[i + 1])] = i
        i += 1
    return runs


def reference_encode(data: bytes) -> bytes:
    """Word-aligned references: runs of 32-bit words as an earlier place and what is added, other words and the tail as they are."""
    words = np.frombuffer(data[: len(data) // 4 * 4], dtype="<u4").astype(np.int64)
    runs = arithmetic_runs(words) if len(words) > 2 else []
    out, at = bytearray(put_uvar(len(data)) + put_uvar(len(runs))), 0
    for i, n, distance, added in runs:
        out += put_uvar(i - at) + put_uvar(n) + put_uvar(distance) + put_uvar(added)
        at = i + n
    at = 0
    for i, n, _, _ in runs:
        out += data[4 * at : 4 * i]
        at = i + n
    return bytes(out + data[4 * at :])


def reference_decode(data: bytes) -> bytes:
    total, at = get_uvar(data, 0)
    count, at = get_uvar(data, at)
    if count > len(data):
        raise Corrupt("there can't be that many runs")
    runs = []
    for _ in range(count):
        run = []
        for _ in range(4):
            x, at = get_uvar(data, at)
            run.append(x)
        runs.append(run)
    out: list[int] = []
    for gap, n, distance, added in runs:
        plain = data[at : at + 4 * gap]
        if len(plain) != 4 * gap:
            raise Corrupt("words are cut short")
        out += np.frombuffer(plain, dtype="<u4").tolist()
        at += 4 * gap
        if not 0 < distance <= len(out) or len(out) + n > total // 4:
            raise Corrupt("a run reaches before the text or past its end")
        for _ in range(n):
            out.append(out[-distance] + added & 0xFFFFFFFF)
    result = np.array(out, dtype="<u4").tobytes() + data[at:]
    if len(result) != total:
        raise Corrupt("words give another text")
    return result


def streams_of(data: bytes, parse: list[tuple[int, int, int, int]] | None = None) -> list[bytes]:
    """A parse, the greedy one unless another is given, as five streams: kinds, literal run lengths, match lengths, distances, literals."""
    kinds, runs, lengths, distances, literals = bytearray(), bytearray(), bytearray(), bytearray(), bytearray()
    for match, at, size, distance in greedy_tokens(data) if parse is None else parse:
        kinds.append(match)
        if match:
            lengths += put_uvar(size)
            distances += put_uvar(distance)
        else:
            runs += put_uvar(size)
            literals += data[at : at + size]
    return [bytes(x) for x in (kinds, runs, lengths, distances, literals)]


def streams_encode(data: bytes) -> bytes:
    """Separated streams, each under the smallest of a few codecs, raw on ties."""
    return streams_encode_all([data])[0]


def streams_encode_all(blocks: list[bytes]) -> list[bytes]:
    """``streams_encode`` for each block; all blocks' streams are coded together."""
    from oreline.operators.codecs.registry import choose_all

    streams = [s for b, parse in zip(blocks, greedy_all(blocks), strict=True) for s in streams_of(b, parse)]
    coded = [put_uvar(number) + put_uvar(len(payload)) + payload for number, payload in choose_all(streams, (1, 2, 5))]
    return [put_uvar(len(b)) + b"".join(coded[5 * i : 5 * i + 5]) for i, b in enumerate(blocks)]


def streams_decode(data: bytes) -> bytes:
    return streams_decode_all([data])[0]


def streams_decode_all(payloads: list[bytes]) -> list[bytes]:
    from oreline.operators.codecs.registry import decode_all

    sizes, parts, by_number = [], [], {}
    for data in payloads:
        n, at = get_uvar(data, 0)
        for _ in range(5):
            number, at = get_uvar(data, at)
            size, at = get_uvar(data, at)
            if at + size > len(data):
                raise Corrupt("a stream is cut short")
            by_number.setdefault(number, []).append(len(parts))
            parts.append(data[at : at + size])
            at += size
        if at != len(data):
            raise Corrupt("streams give another text")
        sizes.append(n)
    for number, places in by_number.items():
        for i, plain in zip(places, decode_all(number, [parts[i] for i in places]), strict=True):
            parts[i] = plain
    return [streams_joined(n, *parts[5 * i : 5 * i + 5]) for i, n in enumerate(sizes)]


def streams_joined(n: int, kinds: bytes, runs: bytes, lengths: bytes, distances: bytes, literals: bytes) -> bytes:
    """The text of ``n`` bytes that five streams stand for."""
    out, r, m, d, k = bytearray(), 0, 0, 0, 0
    for kind in kinds:
        if kind:
            size, m = get_uvar(lengths, m)
            distance, d = get_uvar(distances, d)
            if not 0 < distance <= len(out) or len(out) + size > n:
                raise Corrupt("a match reaches before the text or past its end")
            while size:
                step = min(size, distance)
                out += out[-distance : len(out) - distance + step]
                size -= step
        else:
            size, r = get_uvar(runs, r)
            out += literals[k : k + size]
            k += size
    if len(out) != n or (r, m, d, k) != (len(runs), len(lengths), len(distances), len(literals)):
        raise Corrupt("streams give another text")
    return bytes(out)
