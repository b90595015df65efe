"""Operators on small cases with known answers."""

import json
import random
from statistics import median

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreline.functions import scalars
from oreline.operators import dedup, govern, layout, leaves, select, series, shapes, skyline, stats
from oreline.operators.codecs import bits


def one(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in columns.items()]).collect()]


def test_scalars_agree_with_bytes(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**61]
    for r in one(spark, [(v,) for v in values], "v bigint", n=scalars.uvar_len("v"), z=scalars.zigzag("v"), m=scalars.zigzag(-F.col("v")), b=scalars.unzigzag(scalars.zigzag(-F.col("v"))), w=scalars.bit_width("v")):
        v = r["v"]
        assert r["n"] == len(bits.put_uvar(v)) and r["w"] == v.bit_length() and r["z"] == 2 * v and r["b"] == -v and r["m"] == max(0, 2 * v - 1)


def test_rings(spark):
    got = one(spark, [(v,) for v in (0, 127, 128, 255, 256, -1, -129)], "v bigint", r=scalars.signed_ring("v", 1))
    assert [r["r"] for r in got] == [0, 127, -128, -1, 0, -1, 127]
    with pytest.raises(ValueError):
        scalars.signed_ring("v", 8)


def test_tokens_that_only_look_like_numbers(spark):
    tokens = ["0", "-0", "01", "+1", "1.0", "-7", "9223372036854775807", "9223372036854775808", "", " 1", "1\n", None]
    got = one(spark, [(t,) for t in tokens], "t string", v=scalars.canonical_int("t"))
    assert [r["v"] for r in got] == [0, None, None, None, None, -7, 9223372036854775807, None, None, None, None, None]


def leaf_bytes(tokens):
    """Sizes of five encodings by writing them."""
    put, zz = bits.put_uvar, lambda v: 2 * v if v >= 0 else -2 * v - 1
    pack = lambda x: bits.pack(np.array(x, dtype=np.uint64), max(x, default=0).bit_length())
    framed = lambda ts: b"".join(put(len(t)) + t.encode() for t in ts)
    kinds = list(dict.fromkeys(tokens))
    out = {"raw": len(framed(tokens)), "dict": len(put(len(kinds)) + framed(kinds)) + 1 + len(bits.pack(np.array([kinds.index(t) for t in tokens], dtype=np.uint64), (len(kinds) - 1).bit_length() if len(kinds) > 1 else 0))}
    if all(t == str(int(t)) if t.lstrip("-").isdigit() else False for t in tokens):
        v = [int(t) for t in tokens]
        d = [b - a for a, b in zip(v, v[1:])]  # noqa: B905
        dd = [b - a for a, b in zip(d, d[1:])]  # noqa: B905
        offsets = lambda x: [a - min(x) for a in x]
        out["for"] = len(put(zz(min(v)))) + 1 + len(pack(offsets(v)))
        if len(v) >= 2:
            out["delta"] = len(put(zz(v[0])) + put(zz(min(d)))) + 1 + len(pack(offsets(d)))
        if len(v) >= 3:
            out["dod"] = len(put(zz(v[0])) + put(zz(d[0])) + put(zz(min(dd)))) + 1 + len(pack(offsets(dd)))
    return out


def test_leaf_sizes_are_what_would_be_written(spark):
    rng = random.Random(4)
    columns = [["5"], ["5", "5"], ["1", "2", "3"], ["-0", "1"], ["x", "é", "x"], ["7"] * 9, [str(rng.randint(-1000, 1000)) for _ in range(40)], [str(10**15 + 3 * i) for i in range(20)]]
    columns += [[str(rng.randint(0, 3)) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    rows = [(c, i, t) for c, tokens in enumerate(columns) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "c int, i int, t string")
    for r in leaves.select_leaf(df, ["c"], ["i"], "t").collect():
        want = leaf_bytes(columns[r["c"]])
        assert {k: r[f"{k}_size"] for k in ("raw", "dict", "for", "delta", "dod") if r[f"{k}_size"] is not None} == want
        names = [leaf.name for leaf in leaves.leaf_registry()]
        n = len(columns[r["c"]])
        whole = {names.index(k): 1 + len(bits.put_uvar(n)) + len(bits.put_uvar(p)) + p for k, p in want.items()}
        assert (r["size"], r["leaf_id"]) == min((s, k) for k, s in whole.items())


def test_cheapest_of_candidates_is_the_selected_leaf(spark):
    df = spark.createDataFrame([(c, i, str(c * i % 7)) for c in range(5) for i in range(20)], "c int, i int, t string")
    found = leaves.cheapest(leaves.leaf_candidates(leaves.leaf_sizes(leaves.column_profile(df, ["c"], ["i"], "t")), ["c"]), ["c"])
    chosen = leaves.select_leaf(df, ["c"], ["i"], "t")
    assert {(r["c"], r["leaf_id"], r["size"]) for r in found.collect()} == {(r["c"], r["leaf_id"], r["size"]) for r in chosen.collect()}


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8)), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(max_size=5), x, max_size=4)), max_leaves=12)


def scalars_of(v):
    if isinstance(v, dict):
        return [x for k in v.values() for x in scalars_of(k)]
    return [x for k in v for x in scalars_of(k)] if isinstance(v, list) else [v]


@settings(max_examples=150, deadline=None)
@given(JSON, st.sampled_from([None, 1]))
def test_spans_are_the_scalar_values(value, indent):
    text = json.dumps(value, indent=indent)
    spans = shapes.scalar_spans(text)
    assert [json.loads(text[a:b]) for a, b in spans] == scalars_of(value)


@pytest.mark.parametrize("text", ["", " ", "{", "{]", '{"a"}', '{"a":}', "[1,]", "[1 2]", "{,}", '{"a":1,}', "01", "tru", '"\t"', "1 1", "[}", "nul", "'a'", '{"a":1]', "[", "]", ":", "{1:2}"])
def test_texts_that_are_not_json(text):
    assert shapes.scalar_spans(text) is None


def test_shapes_keep_white_space_and_key_order(spark):
    rows = [(0, '{"a":1,"b":2}'), (1, '{"a": 1,"b":2}'), (2, '{"b":2,"a":1}'), (3, '{"a":"x","b":null}'), (4, "oops"), (5, None)]
    p = shapes.parse_records(spark.createDataFrame(rows, "i int, t string"), ["i"], "t")
    found = {r["template"]: (r["shape_id"], r["members"], r["slots"]) for r in shapes.shape_dictionary(p, "i").collect()}
    assert found == {'{"a":?,"b":?}': (0, 2, 2), '{"a": ?,"b":?}': (1, 1, 2), '{"b":?,"a":?}': (2, 1, 2)}
    for r in p.where("valid").collect():
        assert "".join(a + b for a, b in zip(r["parts"], [*r["values"], ""], strict=True)) == rows[r["i"]][1]


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), i) for i in range(500)]
    got = {(r["a"], r["b"]): r["rank"] for r in shapes.global_rank(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()}
    assert got == {r: k for k, r in enumerate(sorted(rows))}
    assert shapes.global_rank(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_fronts_and_ties(spark):
    points = [("f", "a", 1, 9), ("f", "b", 1, 9), ("f", "c", 2, 9), ("f", "d", 2, 12), ("f", "e", 3, 11), ("g", "only", 5, 5)]
    df = spark.createDataFrame(points, "f string, n string, cost int, gain int")
    want = {"a", "b", "d", "only"}
    assert {r["n"] for r in df.withColumn("on", skyline.on_front(["f"], "cost", "gain")).where("on").collect()} == want
    assert {r["n"] for r in skyline.undominated(df, ["f"], ["cost"], ["gain"]).collect()} == want
    first = {r["n"]: r["dominator"] for r in skyline.dominated_by(df, df, ["f"], ["cost"], ["gain"], "n").collect()}
    assert first == {"a": None, "b": None, "c": "a", "d": None, "e": "d", "only": None}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=25))
def test_sorted_skyline_is_the_theta_join(spark, points):
    df = spark.createDataFrame([("f", i, *p) for i, p in enumerate(points)], "f string, n int, cost int, gain int")
    a = {r["n"] for r in df.withColumn("on", skyline.on_front(["f"], "cost", "gain")).where("on").collect()}
    assert a == {i for i, p in enumerate(points) if not any(q[0] <= p[0] and q[1] >= p[1] and q != p for q in points)}


def test_curve_and_budget_agree(spark):
    rng = random.Random(8)
    points = [("f", rng.randint(1, 40), rng.randint(1, 30)) for _ in range(30)]
    df = spark.createDataFrame(points, "f string, cost int, gain int")
    curve = skyline.budget_curve(df, ["f"], "cost", "gain").collect()
    for level in range(1, 31):
        want = min((c for _, c, g in points if g >= level), default=None)
        assert next((r["budget"] for r in sorted(curve, key=lambda r: r["high"]) if r["high"] >= level), None) == want


def test_robust_statistics(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("z", 0.0), ("z", 0.0), ("s", 7.0)]
    got = {r["k"]: r for r in stats.robust_cv(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["a"]["med"] == 3 and got["a"]["mad"] == 1 and got["a"]["robust_cv"] == pytest.approx(1.4826 / 3)
    assert got["z"]["robust_cv"] == float("inf") and got["s"]["robust_cv"] == 0
    n = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(*[c.alias(k) for k, c in stats.noise("v").items()]).collect()
    assert {r["k"]: r["stddev"] for r in n}["s"] == 0 and {r["k"]: r["cv_pct"] for r in n}["z"] == 0


def test_bootstrap():
    ratio, low, high = stats.bootstrap_ratio([0.0, 0.1, -0.1, 0.05], 7, 400)
    assert low <= ratio <= high and ratio == pytest.approx(np.exp(median([0.0, 0.1, -0.1, 0.05])))
    assert stats.bootstrap_ratio([0.0] * 5, 1, 50) == (1.0, 1.0, 1.0)
    assert stats.bootstrap_ratio([0.1, 0.2, 0.4], 3, 99) == stats.bootstrap_ratio([0.1, 0.2, 0.4], 3, 99)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 255, 256, 300])
def test_bootstrap_draws_as_python_does(n):
    logs = np.random.default_rng(n).normal(size=n).tolist()
    draw = random.Random(5)
    medians = sorted(np.exp(median([logs[draw.randrange(n)] for _ in range(n)])) for _ in range(1500))
    assert stats.bootstrap_ratio(logs, 5, 1500)[1:] == pytest.approx((medians[37], medians[1462]), rel=1e-14)


def test_bootstrap_of_enough_samples(spark):
    pairs = spark.createDataFrame([("s", i, 1.0, 1.0 + i % 13 / 7) for i in range(40)], "k string, i int, a double, b double")
    with pytest.raises(ValueError):
        stats.paired_bootstrap(pairs, ["k"], "i", "a", "b", samples=999)
    got = stats.paired_bootstrap(pairs, ["k"], "i", "a", "b").first()
    assert (got["ratio"], got["ci_low"], got["ci_high"]) == stats.bootstrap_ratio([np.log(1.0 + i % 13 / 7) for i in range(40)], 1, 20_000)


def test_bootstrap_draws_once_for_groups_of_one_size(monkeypatch):
    times, draws = [], stats.stream_draws
    monkeypatch.setattr(stats, "stream_draws", lambda *a: times.append(a) or draws(*a))
    rng = np.random.default_rng(8)
    for n in (41, 42):
        groups = [rng.normal(size=n), rng.integers(0, 3, n) / 2.0, np.exp(4 * rng.normal(size=n))]
        got = [stats.bootstrap_ratio(g.tolist(), 9, 2000)[1:] for g in groups]
        draw = random.Random(9)
        rows = np.array([[draw.randrange(n) for _ in range(n)] for _ in range(2000)])
        for g, found in zip(groups, got, strict=True):
            medians = np.sort(np.median(g[rows], axis=1))
            assert found == pytest.approx((np.exp(medians[50]), np.exp(medians[1950])), rel=1e-14)
    assert len(times) == 2
    monkeypatch.setattr(stats, "SHARED_DRAWS", 0)
    assert stats.bootstrap_ratio(groups[0].tolist(), 9, 2000)[1:] == got[0]


def test_bootstrap_sorts_null_places_last(spark):
    pairs = spark.createDataFrame([("s", i if i else None, 1.0, 1.0 + i) for i in range(5)] + [("u", 1, 2.0, 3.0)], "k string, i int, a double, b double")
    got = {r["k"]: (r["n"], r["ratio"], r["ci_low"], r["ci_high"]) for r in stats.paired_bootstrap(pairs, ["k"], "i", "a", "b").collect()}
    assert got["s"] == (5, *stats.bootstrap_ratio([np.log(1.0 + i) for i in (1, 2, 3, 4, 0)], 1, 20_000))
    assert got["u"] == (1, *stats.bootstrap_ratio([np.log(1.5)], 1, 20_000))


def test_argmin_takes_the_smaller_id(spark):
    df = spark.createDataFrame([("k", 5, 2, "b"), ("k", 5, 1, "a"), ("k", 7, 0, "c")], "k string, cost int, id int, x string")
    assert [tuple(r) for r in select.argmin(df, ["k"], ["cost", "id"]).collect()] == [("k", 5, 1, "a")]


def test_ladders(spark):
    rows = [(True, 0.0, 0.5), (False, 0.2, 0.5), (False, 0.0, 0.98), (False, 0.0, 0.99), (False, 0.0, 1.2)]
    got = one(spark, rows, "b boolean, cv double, hi double", s=select.timing_status(F.col("b"), F.col("cv"), F.col("cv"), F.col("hi"), 0.1, 0.01))
    assert [r["s"] for r in got] == ["BLOCKED_AMBIENT", "BLOCKED_NOISE", "PASS_SPEED_GATE", "NO_SPEED_GATE", "NO_SPEED_GATE"]


def test_block_models():
    line = np.arange(200, dtype=np.int64) * 3 + 17
    m = series.block_models(line)
    assert m["step"] == 3 and m["base"] == 17 and m["median_bits"] == 0 and m["exceptions"] == 0 and m["model"] != "raw" and m["regular"]
    bent = line.copy()
    bent[[20, 90]] += 1000
    m = series.block_models(bent)
    assert (m["modal_step"], m["modal_base"], m["exceptions"]) == (3, 17, 2)
    noise = np.random.default_rng(0).integers(0, 2**32, 300)
    m = series.block_models(noise)
    assert m["model"] == "raw" and not m["regular"] and m["modal_size"] if "modal_size" in m else m["model"] == "raw"
    assert series.block_models(np.zeros(0, dtype=np.int64))["model"] == "raw"
    down = (-np.arange(100, dtype=np.int64) * 5) % series.RING
    assert series.block_models(down)["step"] == -5
    assert all(series.block_models(x)["model_size"] <= min(v for k, v in series.block_models(x).items() if k.endswith("_size") and v is not None) for x in (line, bent, noise, down))


def test_differences(spark):
    v = [3, 8, -2, 7, 7, 100]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v bigint")
    for k in (1, 2, 3):
        got = [r["d"] for r in df.withColumn("d", series.difference("v", ["k"], ["i"], k)).orderBy("i").collect()]
        assert got == [None] * k + np.diff(v, n=k).tolist()


def test_periods_and_fields():
    rng = np.random.default_rng(1)
    records = np.zeros((60, 6), dtype=np.uint8)
    records[:, 0] = 7
    records[:, 1] = np.arange(60) % 256
    records[:, 2] = rng.integers(0, 256, 60)
    records[:, 3:] = 9
    b = records.reshape(-1)
    assert layout.discover_period(b, 40)[0] % 6 == 0
    fields = layout.partition_record(b, 6)
    assert sum(w for _, w, _, _ in fields) == 6 and [o for o, *_ in fields] == sorted(o for o, *_ in fields)
    assert fields[-1][2] == "const" and fields[0][2] in ("const", "posmod", "delta")
    assert layout.tiling_cost(b, 6, 4, 0) is None and layout.tiling_cost(b[:7], 1, 1, 0) is None
    assert layout.discover_period(b[:3], 40) is None


def brute_period(b, most):
    fraction = {p: sum(x == y for x, y in zip(b[p:], b, strict=False)) / (len(b) - p) for p in range(1, min(most, len(b) - 1) + 1)}
    tried = [p for p in sorted(fraction, key=lambda p: (-fraction[p], p)) if p >= 2][:12]
    for p in tried[:4]:
        tried += [q for q in range(2, p) if p % q == 0 and q not in tried][: max(0, 24 - len(tried))]
    costs = {}
    for p in tried:
        n = len(b) // p
        if n >= 4:
            columns = [[(b[r * p + j] - b[r * p - p + j]) % 256 for r in range(1, n)] for j in range(p)]
            costs[p] = sum(d.count(x) * np.log2((n - 1) / d.count(x)) for d in columns for x in set(d)) + 64 * p + 8 * (len(b) - n * p)
    return min(((c, p) for p, c in costs.items()), default=None)


@pytest.mark.parametrize("period", [5, 65, 300, 1024])
def test_long_periods(period):
    rng = np.random.default_rng(period)
    rows = np.tile(rng.integers(0, 256, period, dtype=np.uint8), (48, 1))  # few records are dearer than those of half their length
    rows[:, 0] = np.arange(48)
    b = np.concatenate([rows.reshape(-1), rng.integers(0, 256, 3, dtype=np.uint8)])
    cost, want = brute_period(b.tolist(), 1024)
    assert layout.discover_period(b) == (want, pytest.approx(cost))
    assert want == period


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1500, 70_000])
@pytest.mark.parametrize("values", [1, 255, 256])
def test_match_counts(n, values):
    b = np.random.default_rng(n).integers(0, values, n, dtype=np.uint16).astype(np.uint8)
    assert layout.match_counts(b, 200).tolist() == [int((b[p:] == b[:-p]).sum()) for p in range(1, min(200, n - 1) + 1)]


def test_period_spectrum(spark, data):
    from oreline.plans.catalog import QUERIES

    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").where("text <> ''").limit(3).collect()}
    got = QUERIES["period_spectrum"](spark, data).where(F.col("doc_id").isin(list(texts))).collect()
    want = {(i, p, sum(x == y for x, y in zip(b[p:], b, strict=False)), len(b) - p) for i, b in texts.items() for p in range(1, min(1024, len(b) - 1) + 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def brute_lanes(b, most):
    found = []
    for w in (1, 2, 4, 8):
        for o in range(w):
            for stride in range(w, 65):
                v = [int.from_bytes(b[i : i + w], "little", signed=w == 8) for i in range(o, len(b) - w + 1, stride)]
                for k in range(3 if len(v) >= 64 else 0):
                    d = v if not k else [(y - x + 2**63) % 2**64 - 2**63 for x, y in zip(d, d[1:], strict=False)]
                    h = sum(d.count(x) * np.log2(len(d) / d.count(x)) for x in set(d)) if len(set(d)) < len(d) else len(d) * np.log2(len(d))
                    found.append((round(h / (len(v) * stride), 9) + 0.0, w, o, stride, k, len(v)))
    return [(*x[1:], x[0]) for x in sorted(found)[:most]]


def lane_cases():
    rng = np.random.default_rng(8)
    words = lambda v, kind: np.asarray(v).astype(kind).tobytes()
    yield words(np.arange(200) * 70_001, "<u4")
    yield words(rng.integers(0, 2**63, 3) [rng.integers(0, 3, 90)], "<u8")
    yield rng.integers(0, 256, 700, dtype=np.uint8).tobytes()
    yield words(np.cumsum(rng.integers(0, 2, 400)) * 257, "<u2")[1:]
    yield b"x" * 500
    yield b"y" * 70 + b"z"
    yield b"short"


@pytest.mark.parametrize("b", list(lane_cases()))
def test_best_lanes(b):
    got = layout.best_lanes(np.frombuffer(b, dtype=np.uint8), 4)
    want = brute_lanes(b, 4)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], abs=2e-9)


def test_lane_sweep_full(spark, data):
    from oreline.plans.catalog import QUERIES

    texts = {r["doc_id"]: np.frombuffer(r["text"].encode(), dtype=np.uint8) for r in spark.read.parquet(f"{data}/documents.parquet").where("text <> ''").limit(40).collect()}
    got = sorted((r["doc_id"], r["rank"], r["width"], r["offset"], r["stride"], r["diff_order"], r["words"], r["rate"]) for r in QUERIES["lane_sweep_full"](spark, data).where(F.col("doc_id").isin(list(texts))).collect())
    order = lambda x: (x[5], *x[:4])
    assert got == sorted((i, r, *x) for i, b in texts.items() for r, x in enumerate(sorted(layout.lane_rates(b, range(1, 65), (1, 2, 4, 8)), key=order)[:4], 1))
    assert {x[2] for x in got} - {1} or {x[4] for x in got} - {1, 2, 3, 4}


def test_violations(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 0), (3, "y", None)], "i int, s string, n int")
    got = {tuple(r) for r in govern.violations(df, ["i"], {"named": F.col("s").isNotNull(), "positive": F.col("n") > 0}).collect()}
    assert got == {(2, "named"), (2, "positive"), (3, "positive")}
    assert {r["i"]: r["authorised"] for r in govern.admission(df, "i", {"a": F.col("n") > 0}).collect()} == {1: False, 2: False, 3: False}


def test_dates_and_urls(spark):
    dates = ["2024-02-29", "2023-02-29", "24-1-1", "2024-1-01", None, "2024-13-01"]
    assert [r["d"] for r in one(spark, [(d,) for d in dates], "t string", d=govern.valid_date(F.col("t")))] == [True, False, False, False, False, False]
    urls = ["https://a.b/c?d", "http://a.b", "https://u:p@a.b/", "https://a.b/#x", "https://", None, "https://a.b"]
    assert [r["u"] for r in one(spark, [(u,) for u in urls], "t string", u=scalars.url_allowed("t"))] == [True, False, False, False, False, False, True]


def test_schemas_and_identities():
    spec = {"kind": "object", "fields": {"id": {"kind": "string", "pattern": "[a-z]+"}, "n": {"kind": "int", "least": 1, "most": 9}, "tags": {"kind": "array", "items": {"kind": "string", "enum": ["a", "b"]}, "optional": True}}}
    assert govern.schema_errors({"id": "x", "n": 3, "tags": ["a"]}, spec) == []
    assert len(govern.schema_errors({"id": "X", "n": 0, "tags": ["c"], "more": 1}, spec)) == 4
    assert govern.schema_errors({"n": True}, spec) == ["$.id: missing", "$.n: not int"]
    assert govern.identity({"b_set": [2, 1], "a": 1}) == govern.identity({"a": 1, "b_set": [1, 2]}) != govern.identity({"a": 1, "b_set": [1, 3]})
    assert govern.identity({"a": [1, 2]}) != govern.identity({"a": [2, 1]})


def test_components_and_units(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (4, 4)], "a bigint, b bigint")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11)], "id bigint")
    rooted = dedup.with_roots(ids, "id", links)
    assert {r["id"]: r["root"] for r in rooted.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 10: 10, 11: 10}
    units = {r["root"]: r for r in dedup.unit_ids(rooted, "id").collect()}
    assert units[1]["size"] == 3 and units[1]["unit"].startswith("iu-") and len({u["unit"] for u in units.values()}) == 3
    for largest in (0, 1, 2):
        assert {r["root"]: r for r in dedup.unit_ids(rooted, "id", largest=largest).collect()} == units
    assert dedup.unit_ids(rooted.where("id < 0"), "id", largest=0).collect() == []


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))] if i % 3 == 0 else list(rows[i - 1][1].split())
        if base and i % 3:
            base[rng.randrange(len(base))] = f"z{rng.randint(0, 3)}"
        rows.append((i, " ".join(base)))
    sets = dedup.shingle_sets(spark.createDataFrame([*rows, (99, None), (98, "")], "id bigint, t string"), "id", "t", 2)
    own = {}
    for r in sets.collect():
        if r["s"]:
            own.setdefault(tuple(r["s"]), r["id"])
            own[tuple(r["s"])] = min(own[tuple(r["s"])], r["id"])
    kinds = sorted((i, set(s)) for s, i in own.items())
    want = {(a, b) for k, (a, x) in enumerate(kinds) for b, y in kinds[k + 1 :] if len(x & y) * 5 >= len(x | y) * 4}
    for split in (1, 3, 1024):
        found = [(r["a"], r["b"]) for r in dedup.similar_sets(sets, "id", split=split).collect()]
        assert len(found) == len(set(found)) and set(found) == want and want
    counted = {r["id"]: (r["class_id"], r["links"]) for r in dedup.link_counts(sets, "id", dedup.set_key("s"), dedup.similar_sets(sets, "id")).collect()}
    for r in sets.collect():
        i = own.get(tuple(r["s"]), r["id"])
        assert counted[r["id"]] == (i, sum(i in p for p in want))
    assert dedup.similar_sets(sets.where("id < 0"), "id").collect() == []


def test_partners_of_a_frequent_key(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i // 6}") for i in range(300)], "id bigint, key string")
    by = {}
    for r in rows.collect():
        by.setdefault(r["key"], []).append(r["id"])
    want = sorted((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    assert sorted((r["a"], r["b"]) for r in dedup.partners(rows, "id", "key", split=16).collect()) == want


def test_minhash_arithmetic():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2**61 - 1, 500, dtype=np.uint64), rng.integers(0, 2**61 - 1, 500, dtype=np.uint64)
    assert dedup.mulmod(x, y).tolist() == [int(a) * int(b) % (2**61 - 1) for a, b in zip(x, y, strict=True)]


def test_containment_in_chunks(spark):
    docs = spark.createDataFrame([(1, "xx needle yy"), (2, "nothing"), (3, None), (4, "needle and thread")], "d bigint, t string")
    items = spark.createDataFrame([(7, "needle"), (8, "thread"), (9, ""), (10, None), (11, "needle")], "i bigint, x string")
    want = {(1, 7), (1, 11), (4, 7), (4, 11), (4, 8)}
    for chunk in (1 << 20, 7):
        assert {tuple(r) for r in dedup.contained(docs, items, "d", "t", "i", "x", chunk).collect()} == want


def test_probe_step_by_step():
    """The strided computation against plain loops over lanes."""
    from oreline.operators import series

    rng = np.random.default_rng(3)

    def plain(v):
        for stride in range(1, 13):
            for lane in range(min(stride, 4)):
                own = [int(x) for x in v[lane::stride]]
                if len(v) > lane + 24 * stride:
                    moves = [(b - a) % (1 << 32) for a, b in zip(own, own[1:], strict=False)][:32]
                    if 8 * sum(m <= 4096 or m >= (1 << 32) - 4096 for m in moves) >= 7 * len(moves):
                        return True
        return False

    for n in (127, 128, 129, 200, 300, 512):
        for stride in (1, 3, 7, 12):
            v = rng.integers(0, 1 << 32, n)
            assert series.numeric_probe(v) == (n >= 128 and plain(v))
            lane = int(rng.integers(0, stride))
            v[lane::stride] = np.cumsum(rng.integers(-4000, 4000, len(v[lane::stride]))) % (1 << 32)
            assert series.numeric_probe(v) == (n >= 128 and plain(v))


def test_manifest_rules_at_their_edges(spark):
    good = dict(doc_id=0, ident="abc", origin="org-1", family="fam_1", split="discovery", digest="a" * 64, n_bytes=1, url="https://h/x", publisher="p", release="r", license="l", preprocess="none", representation="raw-bytes", reconstructible=True, recipe=None, retrieved="2024-01-15")
    bad = [
        *[("ident", x) for x in ("ab", "a" * 65, "1ab", "a.b", "Abc", "abc\n", None, "")],
        ("origin", "a b"), ("family", "é"), ("split", "external"), ("sha256", "A" * 64), ("sha256", "a" * 63), ("positive", 0), ("positive", None),
        *[("url", x) for x in ("http://h/", "https://u@h/", "https://h/#x", "https:///x", "https://h/ x", None)],
        ("publisher", " "), ("release", ""), ("license", None), ("preprocess", "  "), ("representation", "uint9"), ("reconstructible", None), ("date", "2023-02-29"), ("date", "2024-1-5"), ("date", None), ("future", "2999-01-01"),
    ]
    column = {"sha256": "digest", "positive": "n_bytes", "date": "retrieved", "future": "retrieved"}
    rows, want = [good, {**good, "doc_id": 1, "ident": "a" * 64}, {**good, "doc_id": 2, "ident": "a_b-1"}, {**good, "doc_id": 3, "representation": "uint8", "recipe": "x"}, {**good, "doc_id": 4, "representation": "uint8", "reconstructible": False}], []
    for k, (rule, value) in enumerate([*bad, ("recipe", " ")]):
        rows.append({**good, "doc_id": 100 + k, column.get(rule, rule): value, **({"representation": "uint8"} if rule == "recipe" else {}), **({"recipe": "x"} if rule == "representation" else {})})
        want.append((100 + k, rule))
    schema = "doc_id int, ident string, origin string, family string, split string, digest string, n_bytes bigint, url string, publisher string, release string, license string, preprocess string, representation string, reconstructible boolean, recipe string, retrieved string"
    found = govern.violations(spark.createDataFrame([tuple(r.values()) for r in rows], schema), ["doc_id"], govern.manifest_rules())
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_more_schema_kinds():
    spec = {"kind": "object", "fields": {"v": {"kind": "int", "const": 1}, "name": {"kind": "string", "nonempty": True}, "ids": {"kind": "array", "nonempty": True, "sorted_unique": True, "items": {"kind": "string"}}}}
    assert govern.schema_errors({"v": 1, "name": "x", "ids": ["a", "b"]}, spec) == []
    assert govern.schema_errors({"v": 2, "name": " ", "ids": ["b", "a"]}, spec) == ["$.v: not 1", "$.name: empty", "$.ids: not sorted and distinct"]
    assert govern.schema_errors({"v": 1, "name": "x", "ids": ["a", "a"]}, spec) == ["$.ids: not sorted and distinct"]
    assert govern.schema_errors({"v": 1, "name": "x", "ids": []}, spec) == ["$.ids: empty"]


def test_rosters_are_bounded(spark):
    rows = spark.range(30).selectExpr("id % 7 AS a")
    assert sorted(govern.roster(rows, "a", 7)) == list(range(7))
    with pytest.raises(ValueError):
        govern.roster(rows, "a", 6)


def test_minhash_recall(spark, data):
    """Estimated pairs against the exact ones."""
    rng = np.random.default_rng(9)
    sets = []
    for k in range(60):
        base = rng.integers(-(1 << 62), 1 << 62, 200)
        sets += [(2 * k, sorted(base.tolist())), (2 * k + 1, sorted([*base[: 200 - int(rng.integers(2, 14))].tolist(), int(rng.integers(1 << 62))]))]
    rows = spark.createDataFrame(sets, "id bigint, s array<bigint>")
    exact = {(r["a"], r["b"]) for r in dedup.similar_sets(rows, "id").collect()}
    sigs = dedup.minhash_signatures(rows, "id")
    found = {(r["a"], r["b"]) for r in dedup.minhash_pairs(sigs, "id").collect()}
    of = {r["id"]: r["sig"] for r in sigs.collect()}
    # equal signatures are one class and so no pair
    assert len(exact) >= 55 and sum(p in found or of[p[0]] == of[p[1]] for p in exact) >= 0.95 * len(exact)


def test_code_thresholds():
    source = "PI = 3.14\nLIMIT = 0.8\nNAME = 'x'\nFLAG = True\n\ndef f(x, cut=0.5, name='a', *, most=3, flag=False):\n    y = 7\n    return y\n"
    assert govern.code_thresholds(source, {"PI": 3.14}) == ["LIMIT", "f.cut", "f.most"]
    assert govern.code_thresholds("def f(x, cut):\n    return x > cut\n") == []
