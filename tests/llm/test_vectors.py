"""Operators 5 and 9 against brute force."""

import numpy as np
import pytest

from oreline.llm import ann, topk

FIELDS = "vec_id bigint, embedding array<float>, label int, id int, vec string, d int"


def odd_vectors(rng):
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1400)]  # one vector of many rows, queries among them
    rows += [(2000, None), (2050, [0.0] * 8), (2051, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2150, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (7, [0.5] * 8), (50, [-1.0] * 8)]
    rows += [(3000, [-x for x in rows[3][1]]), (3001, [x * 2 for x in rows[3][1]]), (4000, []), (4050, [1e30] * 8), (4051, [1e-30] * 8)]
    return [(i, v, 1, 2, "x", 3) for i, v in rows]


def brute(rows, measure, k, zero):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v, key=lambda x: x.tolist())
    return {q: sorted(((measure(x, v), i) for i, v in ok if i != q), key=lambda p: (-p[0], p[1]))[:k] for q, x in queries.items()}


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9)


def product(a, b):
    s = sum(int(x) * int(y) for x, y in zip(np.floor(256 * a), np.floor(256 * b), strict=True))
    return min(max(s, -(1 << 63)), (1 << 63) - 1)


def by_query(out, digits=None):
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        own = got.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((round(r["score"], digits) if digits else r["score"], r["vec_id"]))
    return got


def test_exact_search_of_odd_rows(spark):
    rows = odd_vectors(np.random.default_rng(1))
    out = topk.best(spark.createDataFrame(rows, FIELDS)).collect()
    assert by_query(out) == brute(rows, product, 5, True)


def test_nearest_of_odd_rows(spark):
    rows = odd_vectors(np.random.default_rng(2))
    out = ann.nearest(spark.createDataFrame(rows, FIELDS), recall=1.0).collect()
    want = brute(rows, cosine, 5, False)
    got = by_query(out, 9)
    assert {q: [s for s, _ in r] for q, r in got.items()} == {q: [s for s, _ in r] for q, r in want.items()}
    assert all(i != q for q, r in got.items() for _, i in r)
    # parallel and equal vectors have equal cosines here and stand in order of their ids
    assert [i for _, i in got[1000]] == [7, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize(("run", "measure", "zero"), [(ann.nearest, cosine, False), (topk.best, product, True)])
def test_repeats_of_a_query_row_take_no_places(spark, run, measure, zero):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 400)]
    rows += [(50, rows[49][1])] * 9 + [(i, rows[49][1]) for i in (700, 701)]  # more copies than places, and others of that vector
    rows += [(100, rows[99][1])] + [(703, rows[2][1])] * 8  # one copy; a candidate that is repeated
    out = run(spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], FIELDS), **({"recall": 1.0} if run is ann.nearest else {})).collect()
    digits = 9 if run is ann.nearest else None
    assert by_query(out, digits) == brute(rows, measure, 5, zero)


@pytest.mark.parametrize("few", [8, 64])
def test_own_rows_are_left_out_of_the_proof(few):
    rng = np.random.default_rng(few)
    v = np.floor(rng.normal(size=(700, 16)) * 60)
    q = v[:30] * 3
    own = np.zeros((700, 30), dtype=bool)
    own[np.arange(30), np.arange(30)] = own[np.arange(30) + 300, np.arange(30)] = True
    own[:, 29] = np.arange(700) > 2  # fewer others than places
    for i, may in enumerate(topk.ImpactIndex(v).possible(q, 5, few, own)):
        s = np.where(own[:, i], -np.inf, v @ q[i])
        best = np.argsort(-s, kind="stable")[: min(5, int((~own[:, i]).sum()))]
        assert set(best.tolist()) <= set(may.tolist())


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64))
    v = (centres[rng.integers(0, 20, 9000)] + rng.normal(size=(9000, 64)) * 1.5).astype(np.float32)
    out = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    got = by_query(out)
    for q in range(0, 9000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for _, i in got[q]})
        total += 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("few", [8, 64, 10_000])
def test_stopping_on_proof_loses_nothing(few):
    rng = np.random.default_rng(few)
    v = np.floor(rng.normal(size=(700, 16)) * 60)
    v[100:200] = v[99]
    q = np.floor(rng.normal(size=(30, 16)) * 60)
    rows = topk.ImpactIndex(v).possible(q, 6, few)
    for x, may in zip(q, rows, strict=True):
        s = v @ x
        assert set(np.flatnonzero(s >= np.sort(s)[-6]).tolist()) <= set(may.tolist()) or few == 10_000


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("few", [8, 64])
def test_sparse_vectors_use_posting_segments(few):
    """Mostly zeros: levels are segments, not arrays, and the proof holds."""
    rng = np.random.default_rng(few)
    v = np.floor(rng.normal(size=(900, 64)) * 60) * (rng.random((900, 64)) < 0.03)
    q = np.floor(rng.normal(size=(20, 64)) * 60)
    index = topk.ImpactIndex(v)
    assert any(isinstance(segments, list) and segments for segments, _ in index.levels)
    for x, may in zip(q, index.possible(q, 6, few), strict=True):
        s = v @ x
        assert set(np.flatnonzero(s > np.sort(s)[-6]).tolist()) <= set(may.tolist())


def test_forest_gathers_what_it_is_asked_for():
    rng = np.random.default_rng(0)
    v = unit(rng.normal(size=(500, 16)))
    f = ann.Forest(v, 4)
    for least in (1, 50, 5_000):
        for i, rows in enumerate(f.candidates(v[:20], least)):
            assert i in rows
            assert len(rows) == 500 or len(rows) * 4 >= least


def figures(v, queries, least_recall=0.97):
    """Recall of the five nearest other rows, and the share of rows that are scored."""
    f = ann.Forest(v, 192)
    rows = f.candidates(v[queries], f.fitted(v, 5, least_recall))
    hits = 0
    for q, own in zip(queries, rows, strict=True):
        s = v @ v[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(own.tolist()))
    return hits / 5 / len(queries), float(np.mean([len(own) for own in rows])) / len(v)


def test_recall_and_work_on_the_tables(spark, capsys):
    """Both figures, taken together, on the test tables' own vectors, which have no structure: an index can't leave out most of so few."""
    for sf, most in (("0.01", 0.75), ("0.1", 0.6)):
        table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").orderBy("vec_id").collect()
        v = unit(np.array([r["embedding"] for r in table], dtype=np.float64))
        recall, share = figures(v, [i for i, r in enumerate(table) if r["vec_id"] % 50 == 0])
        with capsys.disabled():
            print(f" sf{sf}: recall {recall:.3f}, share of rows scored {share:.3f}")
        assert recall >= 0.9 and share <= most


def test_little_work_where_vectors_have_groups():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 64))
    v = unit(centres[rng.integers(0, 200, 8000)] + rng.normal(size=(8000, 64)) * 0.4)
    recall, share = figures(v, list(range(0, 8000, 50)))
    assert recall >= 0.9 and share <= 0.05


def test_blocks_do_not_depend_on_the_cluster(spark):
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(6000, 16)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    a, b = (sorted(map(tuple, ann.nearest(t, recall=0.5).collect())) for t in (table.coalesce(1), table.repartition(5)))
    assert a == b


@pytest.mark.parametrize("run", [ann.nearest, topk.best])
def test_few_and_none(spark, run):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert run(empty).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in run(three).collect()] == [1]  # other lengths aren't compared
