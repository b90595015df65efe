"""Token counts by a map-side two-tier lookup (operator 8).

First pass: every task counts its chunks (a text's parts between single
spaces, up to 64 characters) and hands on its ``per_task`` most frequent ones, a bounded table and not the texts'; their sums give the most frequent
chunks of the corpus, at most ``frequent`` of them, whose lengths in tokens are
broadcast as one compact table. Second pass: a text's count is the sum over
its chunks, looked up in that table, then in the worker's own cache of
misses, which the tokenizer fills. No chunk is ever shuffled with its document.

The sum is exact because no piece of the vocabulary has a space mark after
another character, so no merge crosses the border before a space. Texts with
repeated, leading or trailing spaces or with the space mark itself are given to
the tokenizer whole.

Caches are bounded in bytes and keep no long chunks, so texts of any length, with or without spaces, are
counted whole in bounded memory.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, groups_of_bytes

SPACE_MARK = "▁"

_processors: dict[str, object] = {}
_misses: dict[str, dict[str, int]] = {}

LONGEST = 64
#: About what a cached chunk takes beside its characters.
ENTRY = 150


def processor(model_path: str):
    """This process's tokenizer; raises if its vocabulary doesn't allow splitting at spaces."""
    if model_path not in _processors:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if SPACE_MARK in p.lstrip(SPACE_MARK):
                raise ValueError(f"piece {i} has a space mark after another character")
        if sp.encode("a") != sp.encode(" a")[-1:] and sp.encode("b a")[-1:] != sp.encode("a")[-1:]:
            raise ValueError("the tokenizer adds no space mark before a text")
        _processors[model_path] = sp
    return _processors[model_path]


def plain(text: str) -> bool:
    """Whether the text's parts between spaces can be counted one by one."""
    return not (not text or text[0] == " " or text[-1] == " " or "  " in text or SPACE_MARK in text)


def frequent_lengths(docs: DataFrame, model_path: str, text_col: str, frequent: int, per_task: int, held: int) -> tuple[bytes, bytes]:
    """The corpus's most frequent chunks, joined by spaces, and their token counts (uint16)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and plain(t):
                    own = t.split(" ")
                    seen.update(own if max(map(len, own)) <= LONGEST else [x for x in own if len(x) <= LONGEST])
                    if len(seen) > held:  # forget the rarest; this can only cost speed
                        seen = Counter(dict(seen.most_common(held // 4)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    top = (
        batched(docs.select(text_col))
        .mapInArrow(count, "chunk string, n bigint")
        .where(F.octet_length("chunk") <= 64)
        .groupBy("chunk")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "chunk")
        .limit(frequent)
        .collect()
    )
    chunks = [r["chunk"] for r in top]
    lengths = [len(x) for x in processor(model_path).encode(chunks, num_threads=1)] if chunks else []
    return " ".join(chunks).encode(), np.array(lengths, dtype="<u2").tobytes()


def count_tokens(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    frequent: int = 32_768,
    per_task: int = 4_096,
    remember: int = 96 << 20,
    group_bytes: int = 4 << 20,
) -> DataFrame:
    """Return ``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The broadcast table holds ``frequent`` chunks of at most 64 bytes, so at
    most about 2 MB. ``remember`` bounds the bytes of each worker's cache of misses.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path, text_col, frequent, per_task, remember // (ENTRY + LONGEST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        keys, sizes = table.value
        first = dict(zip(keys.decode().split(" "), np.frombuffer(sizes, dtype="<u2").tolist(), strict=True)) if sizes else {}
        misses = _misses.setdefault(model_path, {})
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in groups_of_bytes(texts, group_bytes):
                own = texts[lo:hi]
                parts = [t.split(" ") if plain(t) else None for t in own]
                new: set[str] = set()
                for p in parts:
                    if p:
                        new.update(p)
                new.difference_update(first)
                missing = [x for x in new if x not in misses]
                counted = dict(zip(missing, map(len, sp.encode(missing, num_threads=1)), strict=True)) if missing else {}
                lengths = first | {x: misses[x] for x in new if x in misses} | counted
                short = {x: n for x, n in counted.items() if len(x) <= LONGEST}
                if (len(misses) + len(short)) * (ENTRY + LONGEST) > remember:
                    misses.clear()
                misses.update(short)
                get = lengths.__getitem__
                counts = [sum(map(get, p)) if p else len(sp.encode(t)) for p, t in zip(parts, own, strict=True)]
                n_bytes = [len(t.encode()) for t in own]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
