"""Operators 4, 7 and 10: held-out accuracy, sums by hand, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.llm import classlm, langid, quality
from oreline.llm.common import held_out


def docs_of(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_languages_held_out(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    out = langid.identify(docs, held_out=held_out("doc_id", 5), sample=3000)
    hit = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())


def test_languages_of_odd_rows(odd_docs, no_docs):
    out = langid.identify(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert {by[i]["lang_pred"] for i in (3, 4, 5)} == {"und"} and {by[i]["score"] for i in (3, 4, 5)} == {0.0}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in out)
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_kept(odd_docs):
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not {3, 4, 5} & set(ids) and ids[8] in (0, 2) and ids[1] == ids[2] == 1


def test_shuffled_text_is_rejected(spark):
    """A language of its own is kept, its shuffled bytes are not; good documents stay."""
    docs, labels = docs_of(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rng = np.random.default_rng(2)
    texts = [r["text"] for r in docs.where("length(text) > 1500").orderBy("doc_id").limit(20).collect()]
    mixed = ["".join(rng.permutation(list(t.lower()))) for t in texts]
    more = spark.createDataFrame([(10**9 + i, t, None, None, len(t)) for i, t in enumerate(mixed)], docs.schema)
    kept = langid.keep_identified(docs.unionByName(more), sure=0.8).select("doc_id").cache()
    assert kept.where(f"doc_id >= {10**9}").count() <= 2
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() == 0
    kept = langid.keep_identified(docs)
    assert good.join(kept, "doc_id", "left_anti").count() == 0


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} text of its own " * 3, f"l{i}") for i in range(60)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    x, labels = langid.training_windows(docs, text_col="text", label_col="lang", id_col="doc_id", sample=8)
    assert set(labels) == {f"l{i}" for i in range(60)} and len(labels) <= 240
    again, _ = langid.training_windows(docs.repartition(7), text_col="text", label_col="lang", id_col="doc_id", sample=8)
    assert np.array_equal(x, again)  # whatever the partitions


def test_whole_texts_by_the_network_itself():
    """Predictions of whole texts against the network, window by window, without tables or batches."""
    net = langid.ByteCNN(["a", "b", "c"], seed=5)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 3, 4, 127, 128, 129, 400, 5_000)]
    want = []
    for t in texts:
        total, weight, lo = np.zeros(3), 0, 0
        while lo == 0 or lo + langid.WIDEST - 1 < len(t):
            part = t[lo : lo + langid.WINDOW]
            x = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), dtype=np.uint8)[None]
            logits = np.maximum((net._columns(x) @ net.w["conv"] + net.w["bias"]).max(axis=1), 0)[0] @ net.w["out"] + net.w["out_bias"]
            total += len(part) * (logits - np.log(np.exp(logits).sum()))
            weight += len(part)
            lo += langid.STEP
        p = np.exp(total / weight)
        want.append((int(p.argmax()), float(p.max() / p.sum())))
    best, score = net.table().predict(texts)
    assert best.tolist() == [k for k, _ in want] and np.allclose(score, [s for _, s in want], atol=1e-4)


def test_pair_tables_are_the_network():
    """The multiplied-out tables give what the network gives, window by window."""
    net = langid.ByteCNN(["a", "b", "c"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    a = net._columns(x) @ net.w["conv"] + net.w["bias"]
    logits = np.maximum(a.max(axis=1), 0) @ net.w["out"] + net.w["out_bias"]
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(net.table().log_probabilities(x), want, atol=1e-3)


def test_gradients():
    net = langid.ByteCNN(["a", "b"], embed=3, per_width=2, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (6, langid.WINDOW), dtype=np.uint8), rng.integers(0, 2, 6)
    loss, g = net.gradients(x, y)
    for k in net.w:
        i = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        before = net.w[k][i]
        net.w[k][i] = before + 1e-5
        up = net.gradients(x, y)[0]
        net.w[k][i] = before
        assert (up - loss) / 1e-5 == pytest.approx(float(g[k][i]), rel=0.05, abs=1e-4)


def test_whole_texts_count():
    """A text's every window takes part: its end changes the result."""
    net = langid.ByteCNN(["a", "b"], seed=2).table()
    head = b"x" * 5000
    _, p = net.predict([head, head + b"completely different bytes at the end"])
    assert p[0] != p[1]


def test_quality_accuracy(spark):
    docs, labels = docs_of(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    # labels of four folds teach, the fifth tests
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = quality.classify(docs, labels.where(fold != 0)).join(labels.where(fold == 0), "doc_id")
    right = {q: out.where(F.col("quality") == q).agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0] for q in (0, 1)}
    assert right[1] > 0.98 and right[0] > 0.8


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "t"), (1, 1, "t"), (5, 0, "t"), (7, 1, None), (None, 0, "t"), (99, 0, "t"), (10, None, "t")], "doc_id bigint, quality int, text string")
    out = quality.classify(odd_docs, labels)
    assert out.columns == ["doc_id", *quality.RESULTS] and out.count() == odd_docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[3]["evidence"] == 0 and rows[4]["evidence"] == 0
    assert all(0 < r["path_rate"] < 1 and 0 <= r["quality_score"] <= 1 for r in rows.values())
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and 1 in {r["doc_id"] for r in kept.collect()}
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()


def posteriors(rows, share):
    """Rows (host, path, ratio) to (host_rate, path_rate, score), document by document."""
    p = [1 / (1 + math.exp(-(r + math.log(share / (1 - share))))) for _, _, r in rows]

    def strength(groups):  # (n, good, prior)
        total = sum(n for n, _, _ in groups)
        spread = sum(n * (g / n - q) ** 2 for n, g, q in groups) / total
        chance = sum(q * (1 - q) for _, _, q in groups) / total
        level = sum(n * q * (1 - q) for n, _, q in groups) / total
        return min(1e4, max(1.0, level / max(spread - chance, 1e-9) - 1))

    rate = sum(p) / len(p)
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    k_host = strength([(len(x), sum(x), rate) for x in hosts.values()])
    k_path = strength([(len(x), sum(x), (sum(hosts[h]) + rate * k_host) / (len(hosts[h]) + k_host)) for (h, _), x in paths.items()])
    out = []
    for (h, q, r), x in zip(rows, p, strict=True):
        host = (sum(hosts[h]) - x + rate * k_host) / (len(hosts[h]) - 1 + k_host)
        path = (sum(paths[h, q]) - x + host * k_path) / (len(paths[h, q]) - 1 + k_path)
        out.append((host, path, 1 / (1 + math.exp(-(r + math.log(path / (1 - path)))))))
    return out


def test_posteriors_by_hand(spark):
    docs, labels = docs_of(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    taught = docs_of(spark, "/root/testdata/sf0.01")
    evidence, share = quality.learn(taught, labels)
    rows = docs.withColumn("path", F.expr("concat(lang, doc_id % 7)")).collect()
    ratio = [float(evidence.ratio(quality.features(r["text"])[None])[0]) if r["text"] else 0.0 for r in rows]
    want = posteriors([(r["source"], r["path"], x) for r, x in zip(rows, ratio, strict=True)], share)
    real = quality.learn
    quality.learn = lambda *_, **__: (evidence, share)
    try:
        got = {r["doc_id"]: r for r in quality.classify(docs, labels, path="concat(lang, doc_id % 7)").collect()}
        kept = {r["doc_id"] for r in quality.keep_good(docs, labels, path="concat(lang, doc_id % 7)").collect()}
    finally:
        quality.learn = real
    for r, x, (host, path, score) in zip(rows, ratio, want, strict=True):
        own = got[r["doc_id"]]
        assert np.allclose([own["evidence"], own["host_rate"], own["path_rate"], own["quality_score"]], [x, host, path, score], atol=1e-9)
        assert own["keep"] == (score >= 0.5) == (r["doc_id"] in kept)


def test_sparse_sites_are_drawn_to_their_hosts():
    rows = [("big", "p", 3.0)] * 400 + [("bad", "p", -3.0)] * 400 + [("big", "rare", -3.0), ("bad", "rare", 3.0)]
    rates = dict(zip([r[:2] for r in rows], [x[1] for x in posteriors(rows, 0.5)], strict=True))
    assert rates["big", "p"] > 0.9 > 0.1 > rates["bad", "p"]
    assert rates["big", "rare"] > rates["bad", "rare"]  # its own evidence isn't in it


def words(text):
    lower = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return [*lower.split(), b""]


def check_lm(rows, out):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(x in counts for x in w), n, round(base, 5))] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out)
    assert got == want


def scored(docs, **options):
    docs = docs.select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    return classlm.score(docs, classlm.learn(docs.where("not held_out"), **options))


@pytest.mark.parametrize("frequent", [131_072, 50, 0])
def test_scores_by_hand(spark, data, frequent):
    docs = docs_of(spark, data)
    out = scored(docs, frequent=frequent, core=64, classes=12).collect()
    check_lm([(r["doc_id"], r["text"]) for r in docs.collect()], out)


def test_scores_of_odd_rows(odd_docs, no_docs):
    out = scored(odd_docs, frequent=10, core=4, classes=4).collect()
    check_lm([(r["doc_id"], r["text"]) for r in odd_docs.collect()], out)
    assert all(math.isfinite(r["score"]) for r in out)
    assert scored(no_docs).count() == 0


def test_nothing_to_learn_from(odd_docs):
    docs = odd_docs.select("doc_id", "text").withColumn("held_out", F.lit(True))
    out = classlm.score(docs, classlm.learn(docs.where("not held_out"))).collect()
    assert {r["train_tokens"] for r in out} == {0} and {r["n_known"] for r in out} == {0}


def test_probabilities_add_up(spark):
    """After any word, the probabilities of all words and of each class's unseen word are at most 1, and nearly 1."""
    texts = [(i, "a b a b c d " * 5 + "e" * (i % 7)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    m = classlm.learn(docs, core=3, classes=3)
    all_words = [bytes(r["word"]) for r in m.counts.collect()]
    c = np.array([r["c"] for r in m.counts.collect()])
    cls = m.class_of[classlm._units(all_words, m.frequent)[1]]
    for before in sorted(set(cls.tolist())):
        total = ((c + 0.1) * 10 ** m.pair[before, cls]).sum()
        assert 0.9 < total <= 1.0 + 1e-9


def test_class_scores_by_hand(spark, data):
    """The score of every text from plain counts of classes, class pairs and words, given which words are in which class."""
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark, data).collect()]
    docs = docs_of(spark, data).select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    m = classlm.learn(docs.where("not held_out"), frequent=2_000, core=100, classes=12)
    of = lambda w: int(m.class_of[m.frequent[w] if w in m.frequent else len(m.frequent) + int(classlm.shapes_of([w])[0])])
    c, pairs, mass, kinds = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            own = words(t)
            c.update(own)
            pairs.update(zip(map(of, [b"", *own]), map(of, own), strict=False))
    for w, x in c.items():
        mass[of(w)] += x
        kinds[of(w)] += 1
    n, v, k = sum(c.values()), len(c), len(m.pair)
    after = Counter()
    for (a, _), x in pairs.items():
        after[a] += x
    got = {r["doc_id"]: r["score"] for r in classlm.score(docs, m).collect()}
    for i, t in rows:
        total, before = 0.0, of(b"")
        for w in words(t):
            x = of(w)
            step = (pairs[before, x] + 0.5) / (after[before] + 0.5 * k) * (c[w] + 0.1) / (mass[x] + 0.1 * (kinds[x] + 1))
            total += math.log10(0.9 * step + 0.1 * (c[w] + 0.1) / (n + 0.1 * (v + 1)))
            before = x
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_rounds_raise_the_likelihood(spark):
    """Words of two kinds that take turns: all of them, far beyond the core, come out by kind; gains are exact."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'ab'[j % 2]}{int(rng.zipf(1.3)) % 400}" for j in range(60)) for _ in range(500)]
    m = classlm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), core=4, classes=3)
    kinds = {kind: Counter(int(m.class_of[u]) for w, u in m.frequent.items() if w[:1] == kind) for kind in (b"a", b"b")}
    top = {kind: x.most_common(1)[0] for kind, x in kinds.items()}
    assert top[b"a"][0] != top[b"b"][0]
    assert all(n >= 0.95 * sum(kinds[kind].values()) for kind, (_, n) in top.items())


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(7)
    b = rng.poisson(0.4, (30, 30)).astype(float)
    of = np.concatenate([[0], rng.integers(1, 5, 29)])
    of[rng.choice(np.arange(1, 30), 4, replace=False)] = -1

    def likelihood(of):
        known = of >= 0
        z = np.eye(5)[np.where(known, of, 0)] * known[:, None]
        n = z.T @ b @ z
        return classlm._h(n).sum() - classlm._h(n.sum(axis=0)).sum() - classlm._h(n.sum(axis=1)).sum()

    known = of >= 0
    z = np.eye(5)[np.where(known, of, 0)] * known[:, None]
    best, more = classlm.best_classes(z.T @ b @ z, of, b @ z, b.T @ z, np.diag(b).copy(), at_once=60)
    for u in range(1, 30):
        all_ = []
        for k in range(1, 5):
            to = of.copy()
            to[u] = k
            all_.append(likelihood(to))
        assert max(all_) == pytest.approx(all_[best[u] - 1], abs=1e-6)
        if of[u] >= 0:
            assert more[u] == pytest.approx(max(all_) - likelihood(of), abs=1e-6)


def test_classes_beat_words_alone(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    r = scored(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_exchange_finds_the_classes():
    """Words that follow each other in turn by class come out in their classes."""
    rng = np.random.default_rng(0)
    of = np.array([0, 1, 1, 1, 1, 2, 2, 2, 2])
    b = np.zeros((9, 9), dtype=np.int64)
    before = 0
    for _ in range(20_000):
        after = {0: 1, 1: 2, 2: 1 if rng.random() < 0.8 else 0}[int(of[before])]
        word = int(rng.choice(np.flatnonzero(of == after)))
        b[before, word] += 1
        before = word
    got = classlm.Exchange(b, 3).run()
    assert len(set(got[1:5])) == 1 and len(set(got[5:])) == 1 and got[1] != got[5] and got[0] == 0
