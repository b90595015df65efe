"""Byte-level BPE by corpus-level merge replay (operator 1).

Each task collects the distinct pre-tokens of many documents, lays their bytes
out in one flat array and keeps an inverted index from merge rank to the
positions where that pair stands. Ranks are replayed in ascending order over
all words at once; a merge updates only its two neighbours and puts the pairs
they now form into the index. Words do not depend on each other, so any split
of the corpus into tasks gives the same ids.

Defined cases: a null or empty text has no ids, a repeated row is encoded
again, an empty table gives an empty result, other columns are ignored unless
named in ``keep``. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, groups_of_bytes

NONE = np.int64(1 << 40)

#: A space before white space, or at an end: there a split at spaces is not one between pre-tokens.
ODD_SPACE = re.compile(r" (?=\s)| \Z|\A ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes lists of distinct words with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.vocab = [b""] * self.size
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.decimal = [b"%d " % i for i in range(self.size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]
        # tokens whose appearance may form a pair of a lower rank than their own
        low = np.zeros(self.size, dtype=bool)
        for side in (self.keys // self.size, self.keys % self.size):
            low[side[self.values < side]] = True
        self.spawns_lower = low
        self.first = np.full((256, 256), NONE, dtype=np.int64)
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        for k, v in zip(self.keys, self.values, strict=True):
            a, b = byte_of.get(int(k // self.size)), byte_of.get(int(k % self.size))
            if a is not None and b is not None:
                self.first[a, b] = v

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each word's ids begin (one more entry than words)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = int(starts[-1])
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        token = self.byte_id[raw]
        word = np.repeat(np.arange(len(words)), lengths)
        # position n is a wall on both sides
        nxt = np.arange(1, n + 1)
        nxt[starts[1:][lengths > 0] - 1] = n
        prv = np.arange(-1, n)
        prv[starts[:-1][lengths > 0]] = n
        rank = np.full(n + 1, NONE, dtype=np.int64)
        inner = np.flatnonzero(nxt < n)
        rank[inner] = self.first[raw[inner], raw[inner + 1]]
        inner = inner[rank[inner] < NONE]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Put positions into the index under the ranks they now have."""
            r = rank[positions]
            keep = r < NONE
            if not keep.any():
                return
            positions, r = positions[keep], r[keep]
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                positions, r = positions[order], r[order]
                edges = np.flatnonzero(r[1:] != r[:-1]) + 1
                parts = np.split(positions, edges)
                heads = r[np.concatenate([[0], edges])].tolist()
            else:
                parts, heads = [positions], r.tolist()
            for head, part in zip(heads, parts, strict=True):
                if head in index:
                    index[head].append(part)
                else:
                    index[head] = [part]
                    heapq.heappush(heap, head)

        note(inner)
        token = np.append(token, 0)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if len(at) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            if self.spawns_lower[r]:
                # leftmost of each word only; the others wait until lower pairs are merged
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            elif len(at) > 1:
                touching = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                if touching.any():
                    run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = nxt[at]
            rank[gone] = NONE
            token[at] = r
            after = nxt[gone]
            nxt[at] = after
            inside = after < n
            prv[after[inside]] = at[inside]
            token[gone] = -1
            rank[at] = NONE
            right = at[inside]
            rank[right] = self.pair_ranks(token[right], token[nxt[right]])
            before = prv[at]
            left = before[before < n]
            rank[left] = self.pair_ranks(token[left], token[nxt[left]])
            note(np.concatenate([right, left]))
        live = np.flatnonzero(token[:n] >= 0)
        counts = np.bincount(word[live], minlength=len(words))
        return token[live], np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


class TextEncoder:
    """Encodes whole texts; between calls it remembers chunks of at most ``LONGEST`` characters, ``remember`` bytes of them.

    A chunk is a text's part between single spaces, with the space before it.
    No pre-token spans such a border, so a chunk's ids do not depend on what
    stands around it. Texts with other white space runs are split by the pattern itself.
    """

    LONGEST = 128
    #: About what an entry takes beside its characters and ids.
    ENTRY = 180

    def __init__(self, rank_path: str, pattern: str, remember: int = 256 << 20):
        self.replay = MergeReplay(load_ranks(rank_path))
        self.split = regex.compile(pattern).findall
        self.remember = remember
        self.held = 0  # bytes, estimated
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _learn(self, spaced: list[str], bare: list[str], pieces: set[str]) -> None:
        chunks = [self.split(" " + x) for x in spaced] + [self.split(x) for x in bare]
        words = list(set(itertools.chain.from_iterable(chunks)) | pieces)
        ids, starts = self.replay.encode([w.encode() for w in words])
        packed = ids.astype("<u4").tobytes()
        of = {w: packed[4 * a : 4 * b] for w, a, b in zip(words, starts[:-1].tolist(), starts[1:].tolist(), strict=True)}
        join, get = b"".join, of.__getitem__
        self.spaced.update((x, join(map(get, c))) for x, c in zip(spaced, chunks, strict=False))
        self.bare.update((x, join(map(get, c))) for x, c in zip(bare, chunks[len(spaced) :], strict=True))
        self.bare.update((x, of[x]) for x in pieces)

    def _forget(self, new: list[tuple[dict[str, bytes], list[str]]]) -> None:
        """Drop long chunks, and everything if the chunks held are more than ``remember`` bytes."""
        for known, added in new:
            for x in added:
                if len(x) > self.LONGEST:
                    del known[x]
                else:
                    self.held += self.ENTRY + 2 * len(x) + len(known[x])
        if self.held > self.remember:
            self.spaced.clear()
            self.bare.clear()
            self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut: list[tuple[bool, list[str]]] = []
        spaced: set[str] = set()
        bare: set[str] = set()
        pieces: set[str] = set()
        for t in texts:
            if ODD_SPACE.search(t):
                own = self.split(t)
                cut.append((False, own))
                pieces.update(own)
            else:
                own = t.split(" ")
                cut.append((True, own))
                bare.add(own[0])
                spaced.update(own[1:])
        spaced_new = [x for x in spaced if x not in self.spaced]
        bare_new = [x for x in bare if x not in self.bare]
        pieces = {x for x in pieces if x not in self.bare}
        self._learn(spaced_new, bare_new, pieces)
        join, get_s, get_b = b"".join, self.spaced.__getitem__, self.bare.__getitem__
        out = [join([get_b(own[0]), *map(get_s, own[1:])]) if plain else join(map(get_b, own)) for plain, own in cut]
        self._forget([(self.spaced, spaced_new), (self.bare, list(pieces.union(bare_new)))])
        return out


_encoders: dict[tuple, TextEncoder] = {}


def encoder(rank_path: str, pattern: str) -> TextEncoder:
    """This worker's encoder for a vocabulary."""
    key = (rank_path, pattern)
    if key not in _encoders:
        _encoders[key] = TextEncoder(rank_path, pattern)
    return _encoders[key]


def encode_decode(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """Ids of every text and the bytes they decode to.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    ``with_ids``, ``ids`` (array<int>) and ``decoded`` (binary). Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        decimal = enc.replay.decimal.__getitem__
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in groups_of_bytes(texts, group_bytes):
                counts, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
                for packed in enc.encode(texts[lo:hi]):
                    ids = np.frombuffer(packed, dtype="<u4")
                    plain = enc.replay.decode(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(b"".join(map(decimal, ids.tolist()))[:-1]).hexdigest())
                    text_sha.append(hashlib.sha256(plain).hexdigest())
                    if with_ids:
                        ids_out.append(ids.astype(np.int32))
                        text_out.append(plain)
                columns = [keys.slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded binary"
    return batched(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)
