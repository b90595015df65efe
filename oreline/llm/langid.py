"""Language identification by a byte convolutional network (operator 4).

A window of ``WINDOW`` bytes goes through a byte embedding, filters two, three and
four bytes wide, max pooling over the window, and softmax; all trained here in
numpy on labelled text. A text is every one of its windows, ASCII
lower-cased; its log-probabilities are the windows' means, weighted by their bytes.

For prediction, embedding and filters are multiplied out to two tables of
byte pairs, so a position costs two look-ups in place of a product.

Training takes at most ``sample`` windows, from documents picked at a rate for
each language; that is the only thing sampled. Every window of a text counts in its prediction, however long it is.

Defined cases: null text or text without a letter is ``und`` with score 0; with no
labelled rows everything is ``und``; repeated rows are predicted as often as they
occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, groups_of_bytes, unused

WINDOW, WIDEST = 128, 4
STEP = WINDOW - WIDEST + 1
#: The class of shuffled bytes; no label has a NUL.
NOISE = "\0noise"
LETTER = regex.compile(r"\p{L}")


class ByteCNN:
    """Weights and training; ``table`` gives the multiplied-out form."""

    def __init__(self, classes: list[str], embed: int = 8, per_width: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        f = per_width * (WIDEST - 1)
        self.mask = np.zeros((WIDEST, embed, f), dtype=np.float32)
        for i, width in enumerate(range(2, WIDEST + 1)):
            self.mask[:width, :, i * per_width : (i + 1) * per_width] = 1
        self.mask = self.mask.reshape(WIDEST * embed, f)
        self.w = {
            "emb": rng.normal(0, 0.5, (256, embed)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(f, dtype=np.float32),
            "out": rng.normal(0, 0.2, (f, len(classes))).astype(np.float32),
            "out_bias": np.zeros(len(classes), dtype=np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.w["emb"][x]
        view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), WIDEST * e.shape[2], axis=1)[:, :: e.shape[2]]
        return np.ascontiguousarray(view)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, n = self.w, len(x)
        cols = self._columns(x)
        a = cols @ w["conv"] + w["bias"]
        at = a.argmax(axis=1)
        top = np.take_along_axis(a, at[:, None, :], axis=1)[:, 0]
        hidden = np.maximum(top, 0)
        logits = hidden @ w["out"] + w["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ w["out"].T) * (top > 0)
        picked = cols[np.arange(n)[:, None], at]  # n, filters, columns
        conv = np.einsum("nfk,nf->kf", picked, back, optimize=True) * self.mask
        embed = w["emb"].shape[1]
        down = (w["conv"].T[None] * back[:, :, None]).reshape(-1, embed)
        bytes_ = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDEST)].reshape(-1)
        emb = np.stack([np.bincount(bytes_, weights=down[:, k], minlength=256) for k in range(embed)], axis=1)
        return loss, {"emb": emb.astype(np.float32), "conv": conv, "bias": back.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 4e-3, seed: int = 0) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        t, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                t += 1
                _, g = self.gradients(x[order[lo : lo + batch]], y[order[lo : lo + batch]])
                now = rate * (1 - t / (steps + 1))
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.w[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
        return self

    def table(self) -> Predictor:
        return Predictor(self.classes, self.w)


class Predictor:
    def __init__(self, classes: list[str], w: dict[str, np.ndarray]):
        embed = w["emb"].shape[1]
        conv = w["conv"].reshape(WIDEST, embed, -1)
        single = [w["emb"] @ conv[o] for o in range(WIDEST)]
        self.classes = classes
        self.near = (single[0][:, None, :] + single[1][None, :, :] + w["bias"]).reshape(65536, -1).astype(np.float32)
        self.far = (single[2][:, None, :] + single[3][None, :, :]).reshape(65536, -1).astype(np.float32)
        self.out, self.out_bias = w["out"], w["out_bias"]

    def log_probabilities(self, windows: np.ndarray, at_once: int = 128) -> np.ndarray:
        """Of each row of ``windows`` (uint8, WINDOW bytes)."""
        f = self.near.shape[1]
        hidden = np.empty((len(windows), f), dtype=np.float32)
        a = np.empty((at_once * STEP, f), dtype=np.float32)
        b = np.empty_like(a)
        for lo in range(0, len(windows), at_once):
            x = windows[lo : lo + at_once].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            n = len(x) * STEP
            np.take(self.near, pairs[:, :STEP].reshape(-1), axis=0, out=a[:n], mode="clip")
            np.take(self.far, pairs[:, 2:].reshape(-1), axis=0, out=b[:n], mode="clip")
            np.add(a[:n], b[:n], out=a[:n])
            hidden[lo : lo + at_once] = a[:n].reshape(len(x), STEP, f).max(axis=1)
        logits = np.maximum(hidden, 0) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and probability of each text."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts) + bytes(WINDOW), dtype=np.uint8)
        n = np.maximum(1, -(-(sizes - WIDEST + 1) // STEP))
        doc = np.repeat(np.arange(len(texts)), n)
        order = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = (ends - sizes)[doc] + order * STEP
        weight = np.minimum(WINDOW, ends[doc] - start).astype(np.float64)
        total = np.zeros((len(texts), len(self.classes)))
        for lo in range(0, len(doc), 2048):
            s = start[lo : lo + 2048, None] + np.arange(WINDOW)
            d = doc[lo : lo + 2048]
            inside = s < ends[d][:, None]
            x = np.where(inside, raw[np.minimum(s, len(raw) - 1)], 0).astype(np.uint8)
            part = self.log_probabilities(x) * weight[lo : lo + 2048, None]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(d, weights=part[:, k], minlength=len(texts))
        mean = total / np.maximum(np.bincount(doc, weights=weight, minlength=len(texts)), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def training_windows(labelled: DataFrame, *, text_col: str, label_col: str, sample: int, id_col: str | None = None, per_document: int = 4) -> tuple[np.ndarray, list[str]]:
    """At most ``sample`` windows, or a document's for each label if those are more, with their labels: whole windows and shorter ones, from anywhere in a text.

    Documents are picked by a hash of id and text, at a rate for each label and at least one, so the sample doesn't
    depend on how the table is dealt out. Every label is learned.
    """
    key = F.xxhash64(*([F.col(id_col).cast("string")] if id_col else []), F.col(text_col))
    own = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), key.alias("key"))
    labels = own.select("label", "key").distinct().groupBy("label").agg(F.count("*").alias("n"), F.min("key").alias("least")).collect()
    if not labels:
        return np.zeros((0, WINDOW), dtype=np.uint8), []
    sample = max(sample, per_document * len(labels))
    each = sample // per_document // len(labels)
    # a row for each class of the network
    rates = own.sparkSession.createDataFrame([(r["label"], min(1.0, each / r["n"]), r["least"]) for r in labels], "label string, rate double, least bigint")
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    picked = own.join(F.broadcast(rates), "label").where((spread < F.col("rate")) | (F.col("key") == F.col("least"))).select("text", "label")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not LETTER.search(text):
                    continue
                raw = text.encode().lower()
                rng = np.random.default_rng(zlib.crc32(raw))
                for k in range(min(per_document, 1 + len(raw) // 64)):
                    at = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                    size = WINDOW if k % 2 == 0 else int(rng.integers(8, WINDOW))
                    windows.append(raw[at : at + size].ljust(WINDOW, b"\0"))
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(labels, pa.string())], names=["window", "label"])

    # copies of a text give one window each
    found = batched(picked).mapInArrow(cut_out, "window binary, label string").distinct().orderBy(F.xxhash64("window", "label"), "window", "label").limit(2 * sample).toArrow()
    rows, seen = [], Counter()
    for window, label in zip(found.column("window").to_pylist(), found.column("label").to_pylist(), strict=True):
        rows.append((seen[label], len(rows), window, label))
        seen[label] += 1
    rows = sorted(rows)[:sample]  # labels in turn
    return np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, WINDOW), [r[3] for r in rows]


def noise_windows(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Windows of no language: ``count`` of the windows (again from the first, if there are fewer), the bytes of each or its characters in random order."""
    rng = np.random.default_rng(seed)
    out = x[np.resize(rng.permutation(len(x)), count)].copy()
    for i, row in enumerate(out):
        size = int(np.flatnonzero(row).max(initial=-1)) + 1
        if i % 2:
            row[:size] = rng.permutation(row[:size])
        else:
            mixed = "".join(rng.permutation(list(row[:size].tobytes().decode(errors="ignore")))).encode()
            row[:size] = 0
            row[: len(mixed)] = np.frombuffer(mixed, dtype=np.uint8)
    return out


def learn(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str | None = None, sample: int = 12_000, epochs: int = 10, noise: bool = False) -> ByteCNN | None:
    """A network trained on ``labelled``, or None if it has no labelled text; with ``noise`` it has a class ``NOISE``, trained on shuffled windows, as well."""
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    x, labels = training_windows(known, text_col=text_col, label_col=label_col, id_col=id_col, sample=sample)
    if not labels:
        return None
    classes = sorted(set(labels))
    if noise:
        extra = noise_windows(x, 2 * -(-len(x) // len(classes)))
        x, labels, classes = np.concatenate([x, extra]), labels + [NOISE] * len(extra), [*classes, NOISE]
    number = {c: i for i, c in enumerate(classes)}
    return ByteCNN(classes).train(x, np.array([number[v] for v in labels]), epochs=epochs)


_predictors: dict[str, Predictor] = {}


def predictions(docs: DataFrame, model: ByteCNN | None, *, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"), group_bytes: int = 1 << 20) -> DataFrame:
    """All columns of ``docs``, then the language and its score as ``out``, names that ``docs`` must not have."""
    weights = docs.sparkSession.sparkContext.broadcast((model.classes, model.w) if model else None)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if weights.value is None:
            own = None
        else:
            if name not in _predictors:
                _predictors.clear()
                _predictors[name] = Predictor(*weights.value)
            own = _predictors[name]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for lo, hi in groups_of_bytes(texts, group_bytes, lambda t: len(t or "")):
                lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                some = [i for i in range(lo, hi) if texts[i] and LETTER.search(texts[i])] if own else []
                if some:
                    best, p = own.predict([texts[i].encode().lower() for i in some])
                    for i, k, s in zip(some, best.tolist(), p.tolist(), strict=True):
                        lang[i - lo], score[i - lo] = own.classes[k], s
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names, *out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return batched(docs).mapInArrow(run, f"{fields}, `{out[0]}` string, `{out[1]}` double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out=None, sample: int = 12_000) -> DataFrame:
    """id_col, held_out, lang_pred, score; learned from the rows where ``held_out`` (a column) is false."""
    held = F.lit(False) if held_out is None else held_out
    model = learn(docs.where(~held), text_col=text_col, label_col=label_col, id_col=id_col, sample=sample)
    return predictions(docs.select(id_col, text_col, held.alias("held_out")), model, text_col=text_col).drop(text_col)


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = 12_000, sure: float = 0.99) -> DataFrame:
    """The documents that have a language; columns as they were.

    Rejected are null texts, texts without a letter and those that the network holds for shuffled bytes with probability ``sure`` or more, which
    doesn't depend on the number of languages. Without labelled rows nothing is known of any language and everything is rejected.
    Null ids and repeated rows are judged by their text like any other.
    """
    lang, score = unused(docs, "lang_pred", "score")
    model = learn(docs, text_col=text_col, label_col=label_col, id_col=id_col, sample=sample, noise=True)
    found = predictions(docs, model, text_col=text_col, out=(lang, score))
    return found.where((F.col(lang) != "und") & ((F.col(lang) != NOISE) | (F.col(score) < sure))).select(*docs.columns)
