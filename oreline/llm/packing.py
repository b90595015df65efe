"""Best-fit packing of token sequences with certified bin counts (operator 3).

Documents are tokenized map-side and cut only where they are longer than a
sequence. Full pieces are sequences of their own. All others are dealt to
partitions of bounded size; each partition packs by best-fit decreasing and
computes lower bounds from dual feasible functions over its lengths. A
partition whose bin count meets its bound is certified and keeps its bins, but
for the least filled one; a partition with a gap keeps only its full bins.
What they give up is pooled, dealt anew to fewer partitions and packed again,
until one partition is left or a round settles less than a quarter of its rows; then all
bins stand as they are.

Defined cases: texts of any length are tokenized whole; a null text counts as empty (just the separator); repeated rows
are packed as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, cut, groups_of_bytes


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule:
    printable Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The split of a ByteLevel pre-tokenizer with use_regex, as published, and as it's written with its endings factored out.
BYTE_LEVEL = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)


@functools.cache
def token_encoder(tokenizer_path: str, pattern: str):
    """A function from text to ids as the ``tokenizers`` file defines them.

    Where the file's merges are its vocabulary in order, ``tiktoken`` computes the
    same ids about five times faster; otherwise the ``tokenizers`` library does it.
    Special strings in a text are special tokens, that library's default.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbols, vocab = byte_symbols(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pre = spec["pre_tokenizer"]
    bare = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    in_order = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges))
    plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"] and not model["ignore_merges"]
    if in_order and plain and bare and pattern in BYTE_LEVEL:
        import tiktoken

        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in special}
        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
            return np.array(enc.encode_ordinary(text), dtype="<u4")

        return encode
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces_of(
    docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id_col, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(tokenizer_path, pattern)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in groups_of_bytes(texts, 4 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(lo, hi):
                    own = np.append(encode(texts[i]), np.uint32(end_id)).astype("<u4")
                    n = -(-len(own) // capacity)
                    head = len(own) - capacity * (n - 1)
                    edges = [0, *range(head, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                        if with_ids:
                            ids.append(own[a:b].astype(np.int32))
                columns = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return batched(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0  # bit r of open_rooms: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fits := open_rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            own, room = count, capacity
            count += 1
        bins[i], offsets[i] = own, capacity - room
        if left := room - size:
            by_room[left].append(own)
            open_rooms |= 1 << left
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 24) -> int:
    """The largest of the bounds ceil(sum f(x)) over two families of dual feasible functions.

    One drops items below e and rounds those above capacity - e up to a whole bin; the other
    rounds x to floor((k+1) x / capacity) / k unless (k+1) x / capacity is whole. Also their compositions.
    """
    hist = np.bincount(lengths, minlength=capacity + 1)
    x = np.flatnonzero(hist)
    n = hist[x].astype(object) if len(lengths) > 1 << 40 else hist[x].astype(np.int64)
    if not len(x):
        return 0
    best = -(-int((n * x).sum()) // capacity)
    edges = np.unique(np.concatenate([[0], x[x <= capacity // 2], capacity - x[x > capacity // 2]]))
    if len(edges) > 64:
        edges = edges[np.linspace(0, len(edges) - 1, 64).astype(int)]
    for e in edges.tolist():
        y = np.where(x < e, 0, np.where(x > capacity - e, capacity, x))
        best = max(best, -(-int((n * y).sum()) // capacity))
        for k in range(1, most_k):
            scaled = (k + 1) * y
            whole = scaled % capacity == 0
            # times k * capacity, in whole numbers
            f = np.where(whole, k * y, scaled // capacity * capacity)
            best = max(best, -(-int((n * f).sum()) // (k * capacity)))
    return best


def _repacker(capacity: int, base: int, last: bool):
    """One partition's round: pack, certify, and say which rows it gives up."""

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        given = np.zeros(count, dtype=bool)
        if not last:
            if count > bound:
                given = fill < capacity
            elif count:
                given[np.argmin(fill)] = fill.min() < capacity
        part = int(pdf["part"].iloc[0])
        return pdf.assign(sequence_id=base + (part << 32) + bins, offset=offsets, given_up=given[bins], bins=count, bound=bound)

    return repack


def pack(pieces: DataFrame, *, capacity: int = 2048, per_partition: int = 8192) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` should be materialized. ``per_partition`` bounds what one task packs at once.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    names = [f.name for f in pieces.schema.fields]
    schema = ", ".join([*fields, "part bigint", "sequence_id bigint", "offset bigint", "given_up boolean", "bins bigint", "bound bigint"])
    whole = pieces.where(F.col("length") == capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = [whole]
    pool, before = pieces.where(F.col("length") < capacity), None
    step, last = 0, False
    while not last and (size := pool.count()):
        step += 1
        parts = -(-size // per_partition)
        last = parts == 1 or (before is not None and 4 * size > 3 * before)
        base = -(step << 57)  # whole pieces have the ids from 0, each round its own range below
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInPandas(_repacker(capacity, base, last), schema).coalesce(parts))
        done.append(packed.where(~F.col("given_up")).select(*names, "sequence_id", "offset"))
        pool, before = packed.where("given_up").select(*names), size
    return functools.reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 8192) -> DataFrame:
    """Tokenize, cut and pack; one row per piece."""
    pieces = cut(pieces_of(docs, tokenizer_path, pattern, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col))
    return pack(pieces, capacity=capacity, per_partition=per_partition)
