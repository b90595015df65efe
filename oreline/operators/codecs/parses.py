"""Parses of many blocks at once: matches of all positions by sorting, least costs with a lane for every block.

The tokens are those of the one-block parses in ``matches``, which define them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from oreline.operators.codecs.matches import CHAIN, LEAST

#: Bytes whose matches are held at once, up to ``CHAIN`` for each, and bytes whose costs are.
MATCHED_BYTES, PRICED_BYTES = 1 << 18, 1 << 21

Tokens = list[tuple[int, int, int, int]]


def grouped(blocks: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Neighbouring blocks of up to ``most`` bytes together, a longer one by itself."""
    group, size = [], 0
    for b in blocks:
        if group and size + len(b) > most:
            yield group
            group, size = [], 0
        group.append(b)
        size += len(b)
    if group:
        yield group


def edges(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each block starts and ends in all of them joined."""
    sizes = np.array(list(map(len, blocks)), dtype=np.int64)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def equal_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the bytes from a and from b agree, up to ``most``; ``words`` has the eight bytes from each place on."""
    n = np.zeros(len(a), dtype=np.int64)
    open_ = np.flatnonzero(most > 0)
    while open_.size:
        x = words[a[open_] + n[open_]] ^ words[b[open_] + n[open_]]
        same = np.zeros(len(x), dtype=np.int64)
        rest = x.copy()
        for bits in (32, 16, 8):
            low = rest & np.uint64((1 << bits) - 1) == 0
            same += np.where(low, bits // 8, 0)
            rest = np.where(low, rest >> np.uint64(bits), rest)
        same[x == 0] = 8
        n[open_] += same
        open_ = open_[(same == 8) & (n[open_] < most[open_])]
    return np.minimum(n, most)


def found_matches(blocks: list[bytes], window: int, lasting: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Place, distance and length of every match with one of the last ``CHAIN`` places of its four bytes, and the number of places.

    ``lasting`` matches are also found at the places that they go on over, whatever else those four bytes match.
    """
    start, ends = edges(blocks)
    total = int(ends[-1])
    raw = np.frombuffer(b"".join(blocks) + bytes(16), dtype=np.uint8)
    words = np.ndarray((total + 8,), dtype="<u8", buffer=raw, strides=(1,))
    number = np.repeat(np.arange(len(blocks)), ends - start)
    end = ends[number]
    at = np.flatnonzero(np.arange(total) + LEAST <= end)
    key = np.sort((words[at] & np.uint64(0xFFFFFFFF)) << np.uint64(32) | at.astype(np.uint64))
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    gram = key >> np.uint64(32)
    own = number[place]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    index = np.arange(len(key))
    earlier = index - np.maximum.accumulate(np.where(first, index, 0))
    pairs, some = [], index
    for k in range(1, CHAIN + 1):
        some = some[earlier[some] >= k]
        if not some.size:
            break
        d = place[some] - place[some - k]
        near = d <= window
        pairs.append((d[near].astype(np.uint64) << np.uint64(32)) | place[some[near]].astype(np.uint64))
    key = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.uint64)
    i, d = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
    # at neighbouring places with one distance it is the same match, so only the last is compared
    last = np.ones(len(key), dtype=bool)
    last[:-1] = key[1:] != key[:-1] + np.uint64(1)
    tail = np.flatnonzero(last)
    length = np.zeros(len(key), dtype=np.int64)
    length[tail] = LEAST + equal_bytes(words, i[tail] + LEAST, i[tail] - d[tail] + LEAST, end[i[tail]] - i[tail] - LEAST)
    until = tail[np.cumsum(last) - last]
    length = length[until] + i[until] - i
    if lasting and len(key):
        more = length[tail] - LEAST
        after = np.minimum(tail + 1, len(key) - 1)
        gap = np.where((tail + 1 < len(key)) & (d[after] == d[tail]), i[after] - i[tail] - 1, more)
        more = np.minimum(more, gap)
        source = np.repeat(tail, more)
        step = np.arange(len(source)) - np.repeat(np.cumsum(more) - more, more) + 1
        i, d, length = np.concatenate([i, i[source] + step]), np.concatenate([d, d[source]]), np.concatenate([length, length[source] - step])
    return i, d, length, total


def longest(blocks: list[bytes], window: int, keep: int, lasting: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``keep`` longest matches of each place, nearest first among equals: lengths and distances, 0 where there is none."""
    i, d, length, total = found_matches(blocks, window, lasting)
    score = length << 32 | (0xFFFFFFFF - d)
    out = []
    for _ in range(keep):
        best = np.zeros(total, dtype=np.int64)
        np.maximum.at(best, i, score)
        out.append((best >> 32, np.where(best > 0, 0xFFFFFFFF - (best & 0xFFFFFFFF), 0)))
        others = score != best[i]
        i, score = i[others], score[others]
    return out


def walk(start: np.ndarray, ends: np.ndarray, size: np.ndarray, distance: np.ndarray) -> list[Tokens]:
    """The tokens of each block, from the match taken at each place, if any."""
    total = len(size)
    match = np.where(distance > 0, np.arange(total), total)
    following = np.minimum.accumulate(match[::-1])[::-1].tolist()
    size, distance = size.tolist(), distance.tolist()
    out = []
    for lo, hi in zip(start.tolist(), ends.tolist(), strict=True):
        tokens, i = [], lo
        while i < hi:
            j = following[i]
            if j >= hi:
                tokens.append((0, i - lo, hi - i, 0))
                break
            if j > i:
                tokens.append((0, i - lo, j - i, 0))
            tokens.append((1, j - lo, size[j], distance[j]))
            i = j + size[j]
        out.append(tokens)
    return out


def greedy_all(blocks: list[bytes], window: int = 1 << 16) -> list[Tokens]:
    out = []
    for group in grouped(blocks, MATCHED_BYTES):
        if any(group):
            ((size, distance),) = longest(group, window, 1, False)
            out += walk(*edges(group), size, distance)
        else:
            out += [[] for _ in group]
    return out


def cheapest_choices(start: np.ndarray, ends: np.ndarray, offers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The size and distance of least cost at each place, ties to the smaller size, then distance; a step is a place of every block, from their ends."""
    total, sizes = len(offers[0][0]), ends - start
    lanes = np.argsort(-sizes, kind="stable")
    counts = np.searchsorted(-sizes[lanes], -np.arange(int(sizes.max())), side="left").tolist()
    extra = np.arange(len(sizes))  # every block has a place past its end
    cost = np.full(total + len(sizes), np.inf)
    cost[ends + extra] = 0.0
    most = max(int(x.max(initial=0)) for pair in offers for x in pair)
    price = np.maximum(1, (np.frexp(np.arange(most + 1))[1] + 6) // 7).astype(np.float64)
    tried = []
    for length, distance in offers:
        for size in (length, np.where(length > 0, np.maximum(LEAST, length // 2), 0)):
            tried.append((size.astype(np.int32), distance.astype(np.int32)))
    chosen_size, chosen_distance = np.ones(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    final, shift = ends[lanes] - 1, extra[lanes]
    for t, k in enumerate(counts):
        at = final[:k] - t
        here = at + shift[:k]
        least, size, distance = cost[here + 1] + 1.02, np.ones(k, dtype=np.int32), np.zeros(k, dtype=np.int32)
        some = np.arange(k)
        for j, (sizes_of, distances_of) in enumerate(tried):
            if j % 2 == 0:  # who has no such match has no further one
                some = some[sizes_of[at[some]] > 0]
                if not some.size:
                    break
                places, spots = at[some], here[some]
                d = distances_of[places]
                far = price[d]
            s = sizes_of[places]
            c = cost[spots + s] + 1 + price[s] + far
            old = least[some]
            better = (c < old) | ((c == old) & ((s < size[some]) | ((s == size[some]) & (d < distance[some]))))
            hit = some[better]
            least[hit], size[hit], distance[hit] = c[better], s[better], d[better]
        cost[here] = least
        chosen_size[at], chosen_distance[at] = size, distance
    return chosen_size, chosen_distance


def cheapest_all(blocks: list[bytes], window: int = 1 << 16) -> list[Tokens]:
    out = []
    for wide in grouped(blocks, PRICED_BYTES):
        if not any(wide):
            out += [[] for _ in wide]
            continue
        parts = [longest(group, window, 3, True) for group in grouped(wide, MATCHED_BYTES) if any(group)]
        offers = [(np.concatenate([p[k][0] for p in parts]), np.concatenate([p[k][1] for p in parts])) for k in range(3)]
        out += walk(*edges(wide), *cheapest_choices(*edges(wide), offers))
    return out


def encoder(parse: Callable[[list[bytes]], list[Tokens]], write: Callable[[bytes, Tokens], bytes]) -> Callable[[list[bytes]], list[bytes]]:
    """Encodes many blocks by a parse of all and a writer of each."""
    return lambda blocks: [write(b, tokens) for b, tokens in zip(blocks, parse(blocks), strict=True)]
