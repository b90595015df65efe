"""Quality by hierarchical empirical Bayes (operator 7).

A logistic classifier over byte-class statistics of the whole text, trained on a
bounded sample of labelled documents, gives each document a log-likelihood
ratio of good against bad. Grouped sums of its probabilities give
each site's share of good documents: a host's share is drawn to the
corpus's, a path's to its host's, by Beta priors whose strengths come from
the spread between hosts and between paths (method of moments). A document's
posterior joins its own evidence with the prior of its path, from which the document itself is left out.

Only the classifier is sampled (``sample`` rows); shares and strengths
are sums over all documents.

Defined cases: texts of any length are read whole; a null or empty text has no evidence of its own (ratio 0); null hosts
and paths are groups of their own; without labels of both kinds every ratio
is 0 and everything is kept; repeated rows count as often as they occur; an empty
table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, cut, unused

#: Byte classes: lower, upper, digit, space, line end, sentence mark, bracket or quote, other ASCII mark, control, not ASCII.
CLASSES = 10


def _byte_classes() -> np.ndarray:
    of = np.full(256, 9, dtype=np.uint8)
    of[:32], of[127] = 8, 8
    of[33:127] = 7
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?", b"()[]{}<>\"'`-/")):
        of[list(members)] = k
    return of


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES * CLASSES + 7


def features(text: str) -> np.ndarray:
    """Shares of byte-class transitions, and word and line statistics, of a whole text."""
    raw = text.encode()
    out = np.zeros(FEATURES)
    c = BYTE_CLASS[np.frombuffer(raw, dtype=np.uint8)]
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * np.uint8(CLASSES) + c[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(c) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    out[-7:] = (
        np.log1p(len(raw)) / 10,
        np.log1p(len(raw) / max(1, n)),
        len(set(words)) / max(1, n),
        len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)) / 10,
        1.0 / (1 + n),
        sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
    )
    return out


@dataclasses.dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float  # for classes of equal size

    def ratio(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 2e-2) -> Evidence | None:
    """Logistic regression by Newton steps, both classes weighted alike."""
    if not 0 < y.sum() < len(y):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (share * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8_000) -> tuple[Evidence | None, float]:
    """A classifier from at most ``sample`` labelled documents, and the labels' share of good ones."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    counts = {r["_label"]: r["count"] for r in labels.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None, 0.5
    bucket = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000))
    picked = F.lit(False)
    for value, n in counts.items():
        picked |= (F.col("_label") == value) & (bucket < int(min(1.0, sample / 2 / n) * 900_000))
    chosen = F.broadcast(labels.where(picked).orderBy(F.xxhash64(id_col), id_col).limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "label"])

    found = batched(docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(chosen, id_col).select(text_col, F.col("_label").cast("int"))).mapInArrow(run, "x binary, label int").limit(2 * sample).toArrow()
    if not len(found):
        return None, 0.5
    order = sorted(zip(found.column("x").to_pylist(), found.column("label").to_pylist(), strict=True))[: 2 * sample]
    x = np.frombuffer(b"".join(r[0] for r in order), dtype=np.float64).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in order])), counts[1] / (counts[0] + counts[1])


def ratios(docs: DataFrame, evidence: Evidence | None, *, text_col: str = "text", out: str = "_ratio", group: int = 256, keep_text: bool = True) -> DataFrame:
    """``docs`` with each text's log-likelihood ratio as ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            found = np.zeros(len(texts))
            for lo in range(0, len(texts) if own else 0, group):
                part = texts[lo : lo + group]
                r = own.ratio(np.stack([features(t or "") for t in part]))
                found[lo : lo + group] = np.where([bool(t) for t in part], r, 0.0)
            names, columns = list(batch.schema.names), list(batch.columns)
            if not keep_text:
                del names[at], columns[at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != text_col)
    return batched(docs).mapInArrow(run, f"{fields}, `{out}` double")


def _strength(prior: Column) -> Column:
    """A Beta prior's strength from the spread of groups (n, good) around ``prior``, less what chance gives."""
    share = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (share - prior) * (share - prior)) / F.sum("n")
    chance = F.sum(prior * (1 - prior)) / F.sum("n")
    level = F.sum(F.col("n") * prior * (1 - prior)) / F.sum("n")
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), level / F.greatest(spread - chance, F.lit(1e-9)) - 1))


def site_sums(scored: DataFrame, prior: float) -> tuple[DataFrame, float, float, float]:
    """host, path and the documents and summed probabilities of each path and its host; the corpus's share, and the strengths of hosts and paths."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_probability(F.col("ratio"), prior)).alias("good")))
    size = paths.count()
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), size)
    rate = hosts.agg((F.sum("good") / F.sum("n")).alias("rate")).first()["rate"]
    if rate is None:
        return paths.select("host", "path", "n", "good", F.col("n").alias("host_n"), F.col("good").alias("host_good")), prior, 1.0, 1.0
    k_host = hosts.agg(_strength(F.lit(rate)).alias("k")).first()["k"]
    joined = cut(paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host"), size)
    drawn = (F.col("host_good") + rate * k_host) / (F.col("host_n") + k_host)
    k_path = joined.withColumn("rate", drawn).agg(_strength(F.col("rate")).alias("k")).first()["k"]
    return joined, rate, k_host, k_path


def _probability(ratio: Column, prior: float) -> Column:
    return 1 / (1 + F.exp(-(ratio + F.lit(float(np.log(prior / (1 - prior)))))))


RESULTS = ("host_rate", "path_rate", "evidence", "quality_score", "keep")


def scored(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: str = "source",
    path: str = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
    sample: int = 8_000,
    keep_text: bool = True,
    broadcast_sites: int = 50_000,
    out: tuple[str, ...] = RESULTS,
) -> DataFrame:
    """``docs`` (without the text if not asked for) and its results, named ``out``, names that ``docs`` must not have.

    ``host`` and ``path`` are SQL expressions over ``docs``. A document is kept
    if its posterior of being good is at least ``threshold``. The rates it is given are those of the other documents
    of its host and path, so its own evidence counts once.
    """
    evidence, share = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    site = lambda x: F.coalesce(F.expr(x).cast("string"), F.lit("\0"))
    h, p, *sums = unused(docs, "_host", "_path", "_n", "_good", "_host_n", "_host_good")
    keyed = ratios(docs.withColumn(h, site(host)).withColumn(p, site(path)), evidence, text_col=text_col, out=out[2], keep_text=keep_text)
    if keep_text:  # texts are read again rather than written
        sites = ratios(docs.select(F.col(text_col).alias("text"), site(host).alias("host"), site(path).alias("path")), evidence, out="ratio", keep_text=False)
    else:
        keyed = cut(keyed)
        sites = keyed.select(F.col(h).alias("host"), F.col(p).alias("path"), F.col(out[2]).alias("ratio"))
    sites, rate, k_host, k_path = site_sums(sites, share)
    sites = cut(sites.select(F.col("host").alias(h), F.col("path").alias(p), *[F.col(c).alias(s) for c, s in zip(("n", "good", "host_n", "host_good"), sums, strict=True)]))
    # a site table beyond the bound is joined by a shuffle, whose hot keys the engine splits
    joined = keyed.join(F.broadcast(sites) if sites.count() <= broadcast_sites else sites, [h, p])
    n, good, host_n, host_good = map(F.col, sums)
    own = _probability(F.col(out[2]), share)
    # sums less the own document may fall below 0 by rounding
    host_rate = (F.greatest(host_good - own, F.lit(0.0)) + rate * k_host) / (host_n - 1 + k_host)
    path_rate = (F.greatest(good - own, F.lit(0.0)) + F.col(out[0]) * k_path) / (n - 1 + k_path)
    joined = joined.withColumn(out[0], host_rate).withColumn(out[1], path_rate)
    logit = F.col(out[2]) + F.log(F.col(out[1]) / (1 - F.col(out[1])))
    score = F.lit(1.0) if evidence is None else 1 / (1 + F.exp(-logit))
    columns = [c for c in docs.columns if keep_text or c != text_col]
    return joined.select(*columns, *out[:3], score.alias(out[3])).withColumn(out[4], F.col(out[3]) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", **options) -> DataFrame:
    """id_col, host_rate, path_rate, evidence, quality_score and keep of every document."""
    own = docs.select(F.col(id_col), F.col(text_col), F.expr(host).cast("string").alias("_h"), F.expr(path).cast("string").alias("_p"))
    return scored(own, labels, id_col=id_col, text_col=text_col, host="_h", path="_p", keep_text=False, **options).select(id_col, *RESULTS)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept; columns as they were."""
    out = tuple(unused(docs, *RESULTS))
    return scored(docs, labels, out=out, **options).where(F.col(out[4])).select(*docs.columns)
