"""Queries over measurement grids made from lineitem: a supplier stands for a file, flag, status and line number for a codec."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oreline.operators import select, skyline, stats
from oreline.plans.registry import query, uv
from oreline.session import cut

GRID = """grid AS (SELECT l_suppkey AS file, l_returnflag || l_linestatus || '-q' || l_linenumber AS codec, (100000 + l_suppkey * 1000)::BIGINT AS input_bytes,
    (sum(l_partkey) % 90000 + 1000)::BIGINT AS bytes, (sum(l_quantity::BIGINT) % 500 + 1)::DOUBLE / 4 AS enc, (sum(l_partkey + l_linenumber * 7) % 2000 + 1)::DOUBLE / 8 AS dec,
    (sum(l_orderkey) % 100000 + 1000)::BIGINT AS rss, bool_and(l_quantity > 0) AS roundtrip FROM lineitem GROUP BY ALL)"""


def _leaf_sql() -> str:
    from oreline.plans.leaves import LINEITEM_ORDER, profile_sql

    return profile_sql("lineitem", "l_suppkey", LINEITEM_ORDER, "l_partkey")


IS_REF, IS_CAND = "codec[1] IN ('A', 'N')", "codec[1] = 'R'"


def grid(t):
    n = lambda x: F.sum(F.expr(x))
    return t("lineitem").groupBy(F.col("l_suppkey").alias("file"), F.concat("l_returnflag", "l_linestatus", F.lit("-q"), "l_linenumber").alias("codec")).agg(
        (100000 + F.first("l_suppkey") * 1000).alias("input_bytes"),
        (n("l_partkey") % 90000 + 1000).alias("bytes"),
        ((n("cast(l_quantity as bigint)") % 500 + 1) / 4.0).cast("double").alias("enc"),
        ((n("l_partkey + l_linenumber * 7") % 2000 + 1) / 8.0).cast("double").alias("dec"),
        (n("l_orderkey") % 100000 + 1000).alias("rss"),
        F.bool_and(F.col("l_quantity") > 0).alias("roundtrip"),
    )


def refs(g):
    return g.where(F.substring("codec", 1, 1).isin("A", "N"))


def candidates(g):
    return g.where(F.startswith("codec", F.lit("R")))


def label_sql(table: str, label: str) -> str:
    planes = [f"""SELECT {label} AS label, '{p}' AS plane, codec, CASE WHEN d IS NULL THEN 'EXTENDS_FRONT' ELSE 'DOMINATED' END AS status, d AS dominated_by FROM (
        SELECT a.*, (SELECT min(q.codec) FROM {table} q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes AND q.{p} >= a.{p} AND (q.bytes < a.bytes OR q.{p} > a.{p})) AS d FROM {table} a WHERE a.{IS_CAND})
        UNION ALL SELECT {label}, '{p}', codec, 'FRONT', NULL FROM {table} a WHERE a.{IS_REF} AND NOT EXISTS (SELECT 1 FROM {table} q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes AND q.{p} >= a.{p} AND (q.bytes < a.bytes OR q.{p} > a.{p}))"""
        for p in ("enc", "dec")]
    return " UNION ALL ".join(planes)


def labels(g, cost="bytes"):
    g = cut(g)  # small beside its source, and read for each side of each plane
    planes = []
    for p in ("enc", "dec"):
        own = skyline.dominated_by(candidates(g), refs(g), ["file"], [cost], [p], "codec")
        planes.append(own.select(F.col("file").alias("label"), F.lit(p).alias("plane"), "codec", F.when(F.col("dominator").isNull(), "EXTENDS_FRONT").otherwise("DOMINATED").alias("status"), F.col("dominator").alias("dominated_by")))
        front = refs(g).withColumn("_on", skyline.on_front(["file"], cost, p)).where("_on")
        planes.append(front.select(F.col("file").alias("label"), F.lit(p).alias("plane"), "codec", F.lit("FRONT").alias("status"), F.lit(None).cast("string").alias("dominated_by")))
    out = planes[0]
    for p in planes[1:]:
        out = out.unionByName(p)
    return out


@query("pareto_2d", f"WITH {GRID} {label_sql('grid', 'file')}")
def pareto_2d(t):
    """Fronts of references and how candidates stand to them, on both speed planes."""
    return labels(grid(t))


@query("pareto_3d", f"""WITH {GRID} SELECT a.file, a.codec, a.bytes, a.dec, a.rss FROM grid a WHERE NOT EXISTS (SELECT 1 FROM grid b WHERE b.file = a.file AND b.bytes <= a.bytes AND b.rss <= a.rss AND b.dec >= a.dec
    AND (b.bytes < a.bytes OR b.rss < a.rss OR b.dec > a.dec))""")  # fmt: skip
def pareto_3d(t):
    """Points that no other beats in bytes, decoding speed and memory."""
    return skyline.undominated(grid(t).select("file", "codec", "bytes", "dec", "rss"), ["file"], ["bytes", "rss"], ["dec"])


@query("rss_front", f"""WITH {GRID} SELECT a.file, a.codec, a.bytes, a.rss FROM grid a WHERE NOT EXISTS (SELECT 1 FROM grid b WHERE b.file = a.file AND b.bytes <= a.bytes AND b.rss <= a.rss AND (b.bytes < a.bytes OR b.rss < a.rss))""")
def rss_front(t):
    """The front of bytes and memory, both better if lower, by one sort."""
    g = grid(t).withColumn("less", -F.col("rss"))
    return g.withColumn("_on", skyline.on_front(["file"], "bytes", "less")).where("_on").select("file", "codec", "bytes", "rss")


TOTALS = f"""{GRID}, totals AS (SELECT 'AGGREGATE' AS file, codec, count(*) AS files, sum(input_bytes)::BIGINT AS input_bytes, sum(bytes)::BIGINT AS total_bytes, round(sum(bytes) / sum(input_bytes), 6) AS bytes,
    round((sum(input_bytes) / 1e6) / sum(input_bytes / 1e6 / greatest(enc, 1e-12)), 3) AS enc, round((sum(input_bytes) / 1e6) / sum(input_bytes / 1e6 / greatest(dec, 1e-12)), 3) AS dec, bool_and(roundtrip) AS roundtrip FROM grid GROUP BY codec)"""


def totals(t):
    return grid(t).groupBy("codec").agg(
        F.count("*").alias("files"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("bytes").alias("total_bytes"),
        F.round(F.sum("bytes") / F.sum("input_bytes"), 6).alias("ratio"),
        F.round(stats.harmonic_rate("input_bytes", "enc"), 3).alias("enc"),
        F.round(stats.harmonic_rate("input_bytes", "dec"), 3).alias("dec"),
        F.bool_and("roundtrip").alias("roundtrip"),
    )


@query("codec_totals", f"WITH {TOTALS} SELECT codec, files::BIGINT AS files, input_bytes, total_bytes, bytes AS ratio, enc, dec, roundtrip FROM totals")
def codec_totals(t):
    """Totals of each codec; speeds are weighted by time."""
    return totals(t)


@query("pareto_aggregate_rollup", f"WITH {TOTALS} {label_sql('totals', 'file')}")
def pareto_aggregate_rollup(t):
    """The fronts over all files together."""
    g = totals(t).withColumn("file", F.lit("AGGREGATE")).withColumn("bytes", F.col("ratio"))
    return labels(g)


@query("verdict_vs_best", f"""WITH {GRID}, r AS (SELECT * FROM grid WHERE codec[1] = 'A'), best AS (SELECT file, min(bytes) AS best FROM r GROUP BY file),
    b AS (SELECT a.file, a.codec, string_agg(r.codec, ';' ORDER BY r.bytes, r.codec) AS beats FROM grid a JOIN r ON r.file = a.file AND a.bytes <= r.bytes WHERE a.{IS_CAND} GROUP BY ALL),
    d AS (SELECT a.file, a.codec, a.bytes, EXISTS (SELECT 1 FROM grid q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes AND q.enc >= a.enc AND (q.bytes < a.bytes OR q.enc > a.enc)) AS de,
        EXISTS (SELECT 1 FROM grid q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes AND q.dec >= a.dec AND (q.bytes < a.bytes OR q.dec > a.dec)) AS dd FROM grid a WHERE a.{IS_CAND})
    SELECT d.file, d.codec, best AS best_bytes, round((d.bytes::DOUBLE / best - 1) * 100, 6) AS delta_pct, beats,
        CASE WHEN NOT de AND NOT dd THEN 'PARETO-WIN' WHEN NOT de OR NOT dd THEN 'EXTENDS-ONE-PLANE' WHEN d.bytes < best THEN 'RATIO-BEATS' WHEN beats IS NOT NULL THEN 'RATIO-BEATS-SOME' ELSE 'NO-BEAT' END AS verdict
    FROM d LEFT JOIN best USING (file) LEFT JOIN b USING (file, codec)""")  # fmt: skip
def verdict_vs_best(t):
    """Each candidate against the best rival and the fronts."""
    g = cut(grid(t))
    rivals = g.where(F.startswith("codec", F.lit("A")))
    cand = candidates(g).select("file", "codec", "bytes", "enc", "dec")
    beaten = cand.join(rivals.select("file", F.col("codec").alias("rival"), F.col("bytes").alias("rb")), "file").groupBy("file", "codec").agg(
        F.min("rb").alias("best_bytes"), F.array_sort(F.collect_list(F.when(F.col("bytes") <= F.col("rb"), F.struct("rb", "rival")))).alias("_b")
    )
    d = skyline.dominated_by(cand, refs(g), ["file"], ["bytes"], ["enc"], "codec").withColumnRenamed("dominator", "de")
    d = skyline.dominated_by(d, refs(g), ["file"], ["bytes"], ["dec"], "codec").withColumnRenamed("dominator", "dd").join(beaten, ["file", "codec"], "left")
    beats = F.when(F.size("_b") > 0, F.array_join("_b.rival", ";"))
    verdict = select.ladder(
        (F.col("de").isNull() & F.col("dd").isNull(), "PARETO-WIN"),
        (F.col("de").isNull() | F.col("dd").isNull(), "EXTENDS-ONE-PLANE"),
        (F.col("bytes") < F.col("best_bytes"), "RATIO-BEATS"),
        (F.size("_b") > 0, "RATIO-BEATS-SOME"),
        otherwise="NO-BEAT",
    )
    return d.select("file", "codec", "best_bytes", F.round((F.col("bytes") / F.col("best_bytes") - 1) * 100, 6).alias("delta_pct"), beats.alias("beats"), verdict.alias("verdict"))


@query("byte_budget_at_speed", f"""WITH {GRID}, l AS (SELECT unnest([10.0, 50.0, 100.0, 200.0])::DOUBLE AS level), f AS (SELECT DISTINCT file FROM grid WHERE {IS_REF})
    SELECT file, level, (SELECT min(bytes) FROM grid g WHERE g.file = f.file AND {IS_REF} AND dec >= level) AS budget FROM f, l""")  # fmt: skip
def byte_budget_at_speed(t):
    """How few bytes a point needs to have at a speed."""
    return skyline.budget_at(refs(grid(t)), ["file"], "bytes", "dec", [10, 50, 100, 200])


@query("budget_segments", f"""WITH {GRID}, p AS (SELECT file, dec, min(bytes) AS b FROM grid WHERE {IS_REF} GROUP BY ALL), c AS (SELECT file, dec, min(b) OVER (PARTITION BY file ORDER BY dec DESC) AS budget FROM p),
    m AS (SELECT *, CASE WHEN budget IS DISTINCT FROM lag(budget) OVER (PARTITION BY file ORDER BY dec) THEN 1 ELSE 0 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY dec) AS s FROM m)
    SELECT file, budget, min(dec) AS low, max(dec) AS high FROM s GROUP BY file, s, budget""")  # fmt: skip
def budget_segments(t):
    """The budget as a step function, equal steps joined."""
    return skyline.budget_curve(refs(grid(t)), ["file"], "bytes", "dec")


@query("critical_throughput", f"""WITH {GRID} SELECT a.file, a.codec, a.bytes, round(c * 1.02, 9) AS critical, CASE WHEN c IS NULL THEN 'RATIO-WIN' ELSE 'GENUINE-CROSSING' END AS kind
    FROM (SELECT *, (SELECT max(dec) FROM grid q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes) AS c FROM grid a WHERE {IS_CAND}) a""")  # fmt: skip
def critical_throughput(t):
    """The speed a candidate needs at its size."""
    g = cut(grid(t))
    c = skyline.critical_gain(candidates(g), refs(g), ["file"], "codec", "bytes", "dec")
    return c.select("file", "codec", "bytes", F.round(F.col("critical") * 1.02, 9).alias("critical"), F.when(F.col("critical").isNull(), "RATIO-WIN").otherwise("GENUINE-CROSSING").alias("kind"))


FRONT = f"""{GRID}, front AS (SELECT * FROM grid a WHERE {IS_REF} AND NOT EXISTS (SELECT 1 FROM grid q WHERE q.file = a.file AND q.{IS_REF} AND q.bytes <= a.bytes AND q.dec >= a.dec AND (q.bytes < a.bytes OR q.dec > a.dec))),
    sec AS (SELECT file, lead(bytes) OVER w - bytes AS dc, lead(dec) OVER w - dec AS dg FROM front WINDOW w AS (PARTITION BY file ORDER BY dec, bytes))"""


@query("lambda_secants", f"""WITH {FRONT}, s AS (SELECT file, dc / dg AS slope, row_number() OVER (PARTITION BY file ORDER BY dc / dg) AS r, count(*) OVER (PARTITION BY file) AS n FROM sec WHERE dc > 0 AND dg > 0)
    SELECT file, count(*)::BIGINT AS steps, round(min(slope), 6) AS least, round(max(CASE WHEN r = n // 2 + 1 THEN slope END), 6) AS upper_median, round(max(slope), 6) AS most FROM s GROUP BY file""")  # fmt: skip
def lambda_secants(t):
    """Bytes given up per speed along each front, and their upper median."""
    r = refs(grid(t))
    front = r.withColumn("_on", skyline.on_front(["file"], "bytes", "dec")).where("_on")
    s = stats.with_places(skyline.secants(front, ["file"], "bytes", "dec"), ["file"], "slope")
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("slope")))
    return s.groupBy("file").agg(F.count("*").alias("steps"), F.round(F.min("slope"), 6).alias("least"), F.round(middle, 6).alias("upper_median"), F.round(F.max("slope"), 6).alias("most"))


@query("binding_reference", f"""WITH {GRID}, c AS (SELECT file, min(bytes) AS cb FROM grid WHERE {IS_CAND} GROUP BY file), p AS (SELECT g.*, cb, bytes <= cb AS fits FROM grid g JOIN c USING (file) WHERE {IS_REF} AND dec > 0),
    q AS (SELECT *, bool_or(fits) OVER (PARTITION BY file) AS has FROM p), b AS (SELECT file, codec, row_number() OVER (PARTITION BY file ORDER BY dec DESC, codec) AS r FROM q WHERE fits OR NOT has),
    m AS (SELECT file, codec, row_number() OVER (PARTITION BY file ORDER BY bytes, codec) AS r FROM p)
    SELECT b.file, b.codec AS binding, m.codec AS min_bytes FROM b JOIN m USING (file) WHERE b.r = 1 AND m.r = 1""")  # fmt: skip
def binding_reference(t):
    """The strictest reference among those as small as the candidate, else among all; and the smallest."""
    g = grid(t)
    least = candidates(g).groupBy("file").agg(F.min("bytes").alias("cb"))
    pool = refs(g).where("dec > 0").join(least, "file")
    key = F.struct((F.col("bytes") > F.col("cb")).cast("int").alias("misfit"), (-F.col("dec")).alias("slow"), "codec")
    return pool.groupBy("file").agg(F.min(key).alias("_b"), F.min(F.struct("bytes", "codec")).alias("_m")).select("file", F.col("_b.codec").alias("binding"), F.col("_m.codec").alias("min_bytes"))


PIVOT = f"""{GRID}, pv AS (SELECT file, input_bytes, max(CASE WHEN codec = 'AF-q1' THEN bytes END) AS control, max(CASE WHEN codec = 'AF-q2' THEN bytes END) AS aux, max(CASE WHEN codec = 'NO-q1' THEN bytes END) AS control_alt,
    max(CASE WHEN codec = 'NO-q2' THEN bytes END) AS aux_alt FROM grid GROUP BY ALL)"""


@query("paired_pivot_route_change", f"""WITH {PIVOT}, r AS (SELECT *, CASE WHEN control < control_alt THEN 'direct' ELSE 'alt' END AS control_route, CASE WHEN aux < aux_alt THEN 'direct' ELSE 'alt' END AS aux_route FROM pv
    WHERE control IS NOT NULL AND aux IS NOT NULL AND control_alt IS NOT NULL AND aux_alt IS NOT NULL)
    SELECT file % 5 AS corpus, count(*)::BIGINT AS files, sum(input_bytes)::BIGINT AS input_bytes, sum(aux - control)::BIGINT AS delta, (count(*) FILTER (WHERE control_route <> aux_route))::BIGINT AS route_changes,
        round(sum(aux - control)::DOUBLE / sum(input_bytes), 9) AS delta_share FROM r GROUP BY 1""")  # fmt: skip
def paired_pivot_route_change(t):
    """Codecs side by side per file, and how often the chosen route changes, by corpus."""
    names = {"control": "AF-q1", "aux": "AF-q2", "control_alt": "NO-q1", "aux_alt": "NO-q2"}
    wide = grid(t).groupBy("file", "input_bytes").agg(*[F.max(F.when(F.col("codec") == c, F.col("bytes"))).alias(n) for n, c in names.items()]).dropna(subset=list(names))
    changed = (F.col("control") < F.col("control_alt")) != (F.col("aux") < F.col("aux_alt"))
    delta = F.sum(F.col("aux") - F.col("control"))
    return wide.groupBy((F.col("file") % 5).alias("corpus")).agg(
        F.count("*").alias("files"), F.sum("input_bytes").alias("input_bytes"), delta.alias("delta"), F.count_if(changed).alias("route_changes"), F.round(delta / F.sum("input_bytes"), 9).alias("delta_share")
    )


EXPECTED = "expected AS (SELECT file, codec, CASE WHEN file % 7 = 3 THEN bytes + 1 ELSE bytes END AS want FROM grid WHERE codec <> 'AF-q3')"


@query("frozen_expectation_diff", f"""WITH {GRID}, {EXPECTED}, g AS (SELECT * FROM grid WHERE codec <> 'RF-q5')
    SELECT coalesce(g.file, e.file) AS file, coalesce(g.codec, e.codec) AS codec, bytes, want, CASE WHEN e.file IS NULL THEN 'EXTRA' WHEN g.file IS NULL THEN 'MISSING' ELSE 'MISMATCH' END AS verdict
    FROM g FULL JOIN expected e ON g.file = e.file AND g.codec = e.codec WHERE bytes IS DISTINCT FROM want""")  # fmt: skip
def frozen_expectation_diff(t):
    """Cells that differ from a frozen expectation."""
    g = grid(t).select("file", "codec", "bytes")
    want = g.where("codec <> 'AF-q3'").select("file", "codec", F.when(F.col("file") % 7 == 3, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("want"))
    both = g.where("codec <> 'RF-q5'").join(want, ["file", "codec"], "full")
    return both.where(~F.col("bytes").eqNullSafe(F.col("want"))).withColumn("verdict", F.when(F.col("want").isNull(), "EXTRA").when(F.col("bytes").isNull(), "MISSING").otherwise("MISMATCH"))


@query("missing_cells_anti", f"WITH {GRID} SELECT f.file, c.codec FROM (SELECT DISTINCT file FROM grid) f, (SELECT DISTINCT codec FROM grid) c WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.file = f.file AND g.codec = c.codec)")
def missing_cells_anti(t):
    """Files and codecs of the full grid that weren't measured."""
    from oreline.operators import govern

    g = grid(t)
    full = govern.with_every(g.select("file").distinct(), "codec", govern.roster(g, "codec"))
    return full.join(g, ["file", "codec"], "left_anti")


@query("codec_set_ops", f"""WITH {GRID}, a AS (SELECT DISTINCT codec FROM grid WHERE file % 2 = 0 AND dec > 100), b AS (SELECT DISTINCT codec FROM grid WHERE file % 2 = 1 AND enc > 100)
    SELECT codec, 'both' AS side FROM (SELECT codec FROM a INTERSECT SELECT codec FROM b) UNION ALL SELECT codec, 'left' FROM (SELECT codec FROM a EXCEPT SELECT codec FROM b) UNION ALL SELECT codec, 'right' FROM (SELECT codec FROM b EXCEPT SELECT codec FROM a)""")  # fmt: skip
def codec_set_ops(t):
    """Codecs of two builds: shared, and in one only."""
    g = grid(t)
    a, b = g.where("file % 2 = 0 AND dec > 100").select("codec"), g.where("file % 2 = 1 AND enc > 100").select("codec")
    side = lambda d, s: d.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(b.subtract(a), "right"))


@query("byte_identity", f"""WITH {GRID} SELECT a.file, a.codec, a.bytes = b.bytes AS same FROM grid a JOIN grid b ON b.file = a.file + 1 AND b.codec = a.codec""")
def byte_identity(t):
    """Cells that two builds share, and whether their bytes are the same."""
    g = grid(t).select("file", "codec", "bytes")
    return g.join(g.select((F.col("file") - 1).alias("file"), "codec", F.col("bytes").alias("other")), ["file", "codec"]).select("file", "codec", (F.col("bytes") == F.col("other")).alias("same"))


@query("rep_determinism", """WITH r AS (SELECT l_suppkey AS file, l_returnflag AS codec, l_linenumber AS rep, count(*) AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
    SELECT file, codec, count(*)::BIGINT AS reps, count(DISTINCT q)::BIGINT AS outcomes, sum(n)::BIGINT AS rows FROM r GROUP BY file, codec HAVING count(DISTINCT q) <> 1""")  # fmt: skip
def rep_determinism(t):
    """Cells whose repetitions disagree: repetitions are rolled up, then compared."""
    reps = t("lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("codec"), "l_linenumber").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q"))
    return reps.groupBy("file", "codec").agg(F.count("*").alias("reps"), F.countDistinct("q").alias("outcomes"), F.sum("n").alias("rows")).where("outcomes <> 1")


@query("robust_cv", """WITH v AS (SELECT l_suppkey, l_returnflag, l_quantity AS v FROM lineitem), m AS (SELECT l_suppkey, l_returnflag, median(v) AS med FROM v GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n, med, median(abs(v - med)) AS mad, round(CASE WHEN med > 0 THEN 1.4826::DOUBLE * median(abs(v - med)) / med ELSE 'inf'::DOUBLE END, 9) AS robust_cv FROM v JOIN m USING (l_suppkey, l_returnflag) GROUP BY l_suppkey, l_returnflag, med""")  # fmt: skip
def robust_cv(t):
    """Median, median deviation and robust CV of each cell."""
    return stats.robust_cv(t("lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity").withColumn("robust_cv", F.round("robust_cv", 9))


NOISE = "n AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS sd FROM lineitem GROUP BY ALL)"


@query("noise_floor", f"WITH {NOISE} SELECT l_suppkey, l_returnflag, round(mean, 9) AS mean, round(sd, 9) AS stddev, round(100 * sd / mean, 9) AS cv_pct FROM n")
def noise_floor(t):
    """Mean, sample deviation and CV."""
    agg = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(*[c.alias(n) for n, c in stats.noise("l_quantity").items()])
    return agg.select("l_suppkey", "l_returnflag", *[F.round(c, 9).alias(c) for c in ("mean", "stddev", "cv_pct")])


@query("worst_noise", f"WITH {NOISE} SELECT l_suppkey, l_returnflag, round(100 * sd / mean, 9) AS cv_pct FROM n ORDER BY round(100 * sd / mean, 9) DESC, l_suppkey, l_returnflag LIMIT 5")
def worst_noise(t):
    """The five cells of the largest CV."""
    return noise_floor(t).select("l_suppkey", "l_returnflag", "cv_pct").orderBy(F.desc("cv_pct"), "l_suppkey", "l_returnflag").limit(5)


STATUS = """s AS (SELECT l_suppkey, median(l_quantity) AS med, max(l_tax) AS tax, round(avg(l_discount), 6) AS hi, min(l_linenumber) AS ambient, max(l_partkey) % 5 AS blocked, stddev_pop(l_quantity) / avg(l_quantity) AS cv FROM lineitem GROUP BY l_suppkey)"""


@query("status_ladder", f"""WITH {STATUS} SELECT l_suppkey, CASE WHEN blocked = 0 THEN 'BLOCKED_AMBIENT' WHEN NOT (cv <= 0.57 AND cv / 2 <= 0.57) THEN 'BLOCKED_NOISE' WHEN hi * 20 < 0.99 THEN 'PASS_SPEED_GATE' ELSE 'NO_SPEED_GATE' END AS status FROM s""")
def status_ladder(t):
    """Whether a timing is blocked, noisy, fast enough or not."""
    s = t("lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("hi"), (F.max("l_partkey") % 5).alias("blocked"), (F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cv"))
    return s.select("l_suppkey", select.timing_status(F.col("blocked") == 0, F.col("cv"), F.col("cv") / 2, F.col("hi") * 20, 0.57, 0.01).alias("status"))


@query("cost_gate_ruling", f"""WITH {PIVOT}, m AS (SELECT file, min(dec) AS slow, max(dec) AS fast, min(rss)::DOUBLE AS low, max(rss)::DOUBLE AS high FROM grid GROUP BY file)
    SELECT file, CASE WHEN file % 6 = 0 THEN 'TIMING_BLOCKED' WHEN NOT (aux < control) THEN 'NO_BINDING_BYTE_WIN' WHEN NOT (fast / (slow + 100) <= 2 AND high / (low + 60000) <= 2) THEN 'FRONT-GAP_COST' ELSE 'COST_GAP_CLOSED_PENDING_ENCODE_DECSIZE' END AS ruling
    FROM pv JOIN m USING (file) WHERE aux IS NOT NULL AND control IS NOT NULL""")  # fmt: skip
def cost_gate_ruling(t):
    """The ruling of the reference-cost gate."""
    g = grid(t)
    cell = lambda c: F.max(F.when(F.col("codec") == c, F.col("bytes")))
    m = g.groupBy("file").agg(cell("AF-q1").alias("control"), cell("AF-q2").alias("aux"), F.min("dec").alias("slow"), F.max("dec").alias("fast"), F.min("rss").alias("low"), F.max("rss").alias("high")).dropna(subset=["control", "aux"])
    ruling = select.cost_ruling(F.col("file") % 6 != 0, F.col("aux") < F.col("control"), [F.col("fast") / (F.col("slow") + 100)], [F.col("high") / (F.col("low") + 60000)])
    return m.select("file", ruling.alias("ruling"))


@query("gate_table", f"""WITH {PIVOT}, g AS (SELECT file, aux > 20000 AS h1, aux < control AS h2, aux < control_alt AS h3, aux_alt > control_alt AS h4 FROM pv WHERE control IS NOT NULL AND aux IS NOT NULL AND control_alt IS NOT NULL AND aux_alt IS NOT NULL)
    SELECT *, CASE WHEN NOT h1 THEN 'KILL-DIFF' WHEN NOT h2 THEN 'NO-INCREMENTAL-BYTE-WIN' WHEN NOT (h3 AND h4) THEN 'SPECIALIZED-TRADEOFF' ELSE 'SPECIALIZED-DISCOVERY-ADVANCE' END AS ruling FROM g""")  # fmt: skip
def gate_table(t):
    """Four gates per file and the ruling they give."""
    names = {"control": "AF-q1", "aux": "AF-q2", "control_alt": "NO-q1", "aux_alt": "NO-q2"}
    w = grid(t).groupBy("file").agg(*[F.max(F.when(F.col("codec") == c, F.col("bytes"))).alias(n) for n, c in names.items()]).dropna(subset=list(names))
    g = w.select("file", F.expr("aux > 20000").alias("h1"), F.expr("aux < control").alias("h2"), F.expr("aux < control_alt").alias("h3"), F.expr("aux_alt > control_alt").alias("h4"))
    return g.withColumn("ruling", select.discovery_ruling(*[F.col(h) for h in ("h1", "h2", "h3", "h4")]))


@query("complete_size_oracle", f"""WITH {GRID}, e AS (SELECT file, codec, bytes, (1 + {uv('input_bytes')} + bytes)::BIGINT AS complete, bytes + 3 + (bytes % 2) AS claimed FROM grid)
    SELECT file, count(*)::BIGINT AS cells, (count(*) FILTER (WHERE complete <> claimed))::BIGINT AS wrong, min(complete)::BIGINT AS least FROM e GROUP BY file""")  # fmt: skip
def complete_size_oracle(t):
    """Complete sizes derived anew and compared with claimed ones."""
    from oreline.functions.scalars import uvar_len

    e = grid(t).select("file", (F.lit(1) + uvar_len("input_bytes") + F.col("bytes")).alias("complete"), (F.col("bytes") + 3 + F.col("bytes") % 2).alias("claimed"))
    return e.groupBy("file").agg(F.count("*").alias("cells"), F.count_if(F.col("complete") != F.col("claimed")).alias("wrong"), F.min("complete").alias("least"))


@query("router_ranking", f"""WITH {GRID}, j AS (SELECT file, codec, bytes + (input_bytes / 1e6 / dec) * 900.0 + 2 * 16.0 + (input_bytes / 1e6 / dec) * 50.0 AS cost FROM grid),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(cost, 6), codec) AS k FROM j) SELECT file, codec, round(cost, 6) AS cost FROM r WHERE k = 1""")  # fmt: skip
def router_ranking(t):
    """The codec of least additive cost of each file."""
    seconds = F.col("input_bytes") / 1e6 / F.col("dec")
    j = grid(t).select("file", "codec", F.round(select.additive_cost(F.col("bytes"), seconds, 900.0, 16.0, 50.0), 6).alias("cost"))
    return select.argmin(j, ["file"], ["cost", "codec"])


BLOCKS = f"""{GRID}, bl AS (SELECT file, codec, bytes AS a, rss AS b, input_bytes % 3 = 0 AS raw, 20000 + bytes % 50000 AS blen FROM grid),
    fr AS (SELECT *, 7 + {uv('a')} + a AS fa, 7 + {uv('b')} + b AS fb, 5 + {uv('blen')} + blen AS fraw FROM bl),
    o AS (SELECT *, CASE WHEN raw THEN fa ELSE least(fa, fb) END AS best, CASE WHEN raw THEN 'raw' WHEN a < b THEN 'a' ELSE 'b' END AS winner, CASE WHEN raw THEN abs(fraw - fa) ELSE abs(a - b) END AS margin FROM fr),
    p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY margin) AS r, count(*) OVER (PARTITION BY file) AS n FROM o)"""


@query("block_oracle_regret", f"""WITH {BLOCKS} SELECT file, count(*)::BIGINT AS blocks, (count(*) FILTER (WHERE winner = 'a'))::BIGINT AS wins_a, (count(*) FILTER (WHERE winner = 'b'))::BIGINT AS wins_b, (count(*) FILTER (WHERE winner = 'raw'))::BIGINT AS wins_raw,
    floor(median(margin))::BIGINT AS median_margin, max(CASE WHEN r = ceil(95 * n / 100) THEN margin END)::BIGINT AS p95_margin, sum(best)::BIGINT AS oracle_coded, sum(least(best, fraw))::BIGINT AS oracle_any, (least(sum(fa), sum(fb)) - sum(best))::BIGINT AS regret FROM p GROUP BY file""")  # fmt: skip
def block_oracle_regret(t):
    """Which of two backends wins each block, by how much, and what one for all would lose."""
    from oreline.functions.scalars import uvar_len

    framed = lambda c: F.lit(7) + uvar_len(c) + F.col(c)
    b = grid(t).select("file", F.col("bytes").alias("a"), F.col("rss").alias("b"), (F.col("input_bytes") % 3 == 0).alias("raw"), (20000 + F.col("bytes") % 50000).alias("blen"))
    b = b.withColumn("fa", framed("a")).withColumn("fb", framed("b")).withColumn("fraw", F.lit(5) + uvar_len("blen") + F.col("blen"))
    b = b.withColumn("best", F.when(F.col("raw"), F.col("fa")).otherwise(F.least("fa", "fb"))).withColumn("margin", F.when(F.col("raw"), F.abs(F.col("fraw") - F.col("fa"))).otherwise(F.abs(F.col("a") - F.col("b"))))
    p = stats.with_places(b, ["file"], "margin")
    live = ~F.col("raw")
    return p.groupBy("file").agg(
        F.count("*").alias("blocks"),
        F.count_if(live & (F.col("a") < F.col("b"))).alias("wins_a"),
        F.count_if(live & (F.col("a") >= F.col("b"))).alias("wins_b"),
        F.count_if("raw").alias("wins_raw"),
        F.floor(F.median("margin")).alias("median_margin"),
        F.max(F.when(F.col("_r") == F.ceil(F.lit(95) * F.col("_n") / 100), F.col("margin"))).alias("p95_margin"),
        F.sum("best").alias("oracle_coded"),
        F.sum(F.least("best", "fraw")).alias("oracle_any"),
        (F.least(F.sum("fa"), F.sum("fb")) - F.sum("best")).alias("regret"),
    )


@query("stage_shares", """WITH s AS (SELECT l_suppkey AS file, l_linenumber AS stage, sum(l_quantity::BIGINT) AS ms FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(ms) OVER (PARTITION BY file) AS total FROM s)
    SELECT file, stage, ms::BIGINT AS ms, round(ms / total, 9) AS share, CASE WHEN ms < total THEN round(1 / (1 - ms / total), 9) END AS cap FROM t""")  # fmt: skip
def stage_shares(t):
    """Each stage's share of the time and the speed-up of removing it."""
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("stage")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("ms"))
    share = F.col("ms") / F.sum("ms").over(Window.partitionBy("file"))
    return s.select("file", "stage", "ms", F.round(share, 9).alias("share"), F.when(share < 1, F.round(1 / (1 - share), 9)).alias("cap"))


@query("weighted_agreement", f"""WITH {GRID}, s AS (SELECT file, codec, bytes < rss AS a, enc < dec AS b, abs(bytes - rss) <= 5000 AS near, input_bytes // 1000 AS w FROM grid)
    SELECT file, count(*)::BIGINT AS slots, (count(*) FILTER (WHERE a = b))::BIGINT AS agree, (count(*) FILTER (WHERE near))::BIGINT AS near_ties, (count(*) FILTER (WHERE a = b AND NOT near))::BIGINT AS clear_agree, sum(w)::BIGINT AS weight,
        coalesce(sum(w) FILTER (WHERE a = b), 0)::BIGINT AS weight_agree, coalesce(sum(w) FILTER (WHERE NOT near), 0)::BIGINT AS clear_weight, coalesce(sum(w) FILTER (WHERE a = b AND NOT near), 0)::BIGINT AS clear_weight_agree FROM s GROUP BY file""")  # fmt: skip
def weighted_agreement(t):
    """How far a proxy's choices agree with the oracle's, by weight."""
    g = grid(t).withColumn("w", F.floor(F.col("input_bytes") / 1000))
    return select.agreement(g, ["file"], (F.col("bytes") < F.col("rss")) == (F.col("enc") < F.col("dec")), "w", F.abs(F.col("bytes") - F.col("rss")) <= 5000)


@query("wire_partition", """WITH p AS (SELECT l_suppkey AS file, l_linestatus AS category, sum(l_quantity::BIGINT) AS n FROM lineitem GROUP BY ALL)
    SELECT file, category, n::BIGINT AS n_bytes, (sum(n) OVER (PARTITION BY file))::BIGINT AS total FROM p""")  # fmt: skip
def wire_partition(t):
    """Bytes by category, and the total that they must add up to."""
    p = t("lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_linestatus").alias("category")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n_bytes"))
    return p.withColumn("total", F.sum("n_bytes").over(Window.partitionBy("file")))


@query("full_grid_cross", f"""WITH {GRID} SELECT c.codec, r.rep::INT AS rep, count(*)::BIGINT AS cells FROM (SELECT DISTINCT file FROM grid) f, (SELECT DISTINCT codec FROM grid) c, (SELECT unnest(range(0, 3)) AS rep) r GROUP BY ALL""")
def full_grid_cross(t):
    """The grid of files, codecs and repetitions that a run has to fill."""
    from oreline.operators import govern

    g = grid(t)
    cells = govern.with_every(govern.with_every(g.select("file").distinct(), "codec", govern.roster(g, "codec")), "rep", [0, 1, 2], "int")
    return cells.groupBy("codec", "rep").agg(F.count("*").alias("cells"))


@query("positional_pairs", f"""WITH {GRID}, a AS (SELECT file, bytes, row_number() OVER (PARTITION BY file ORDER BY codec) AS k FROM grid WHERE codec[1] = 'A'), b AS (SELECT file, bytes, row_number() OVER (PARTITION BY file ORDER BY codec) AS k FROM grid WHERE codec[1] = 'R')
    SELECT file, count(*)::BIGINT AS pairs, sum(b.bytes - a.bytes)::BIGINT AS delta FROM a JOIN b USING (file, k) GROUP BY file""")  # fmt: skip
def positional_pairs(t):
    """Control and candidate rows of each file joined by position."""
    side = lambda p, n: grid(t).where(F.startswith("codec", F.lit(p))).select("file", F.col("bytes").alias(n), F.row_number().over(Window.partitionBy("file").orderBy("codec")).alias("k"))
    return side("A", "a").join(side("R", "b"), ["file", "k"]).groupBy("file").agg(F.count("*").alias("pairs"), F.sum(F.col("b") - F.col("a")).alias("delta"))


@query("bootstrap_ci")
def bootstrap_ci(t):
    """Paired bootstrap intervals of each supplier's ratios, of 20,000 samples each."""
    pairs = t("lineitem").select("l_suppkey", F.concat_ws("-", F.lpad("l_orderkey", 12, "0"), "l_linenumber", "l_partkey").alias("pair"), (F.col("l_extendedprice") + 1).alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1).alias("b"))
    return stats.paired_bootstrap(pairs, ["l_suppkey"], "pair", "a", "b", samples=20_000)


#: Runs of seven files each: 1 arithmetic, 2 time series, 3 repeated JSON, the others negative controls.
RUNS = """run AS (SELECT l_suppkey AS run, l_linenumber AS file, (sum(l_partkey) % 5)::BIGINT AS mode, (sum(l_partkey) % 4 <> 0) AS models, (sum(l_orderkey) % 40000 + 20000)::BIGINT AS own, (sum(l_orderkey) % 40000 + 20000 - sum(l_partkey) % 3)::BIGINT AS whole,
    (sum(l_partkey) % 60000 + 10000)::BIGINT AS q5, (sum(l_partkey * 3) % 60000 + 10000)::BIGINT AS q11, (sum(l_partkey + 1) % 300 + 1)::BIGINT AS enc, (sum(l_orderkey + 1) % 300 + 1)::BIGINT AS whole_enc, (sum(l_partkey + 2) % 300 + 1)::BIGINT AS "dec", (sum(l_orderkey + 2) % 300 + 1)::BIGINT AS q5_dec, (sum(l_orderkey + 3) % 300 + 1)::BIGINT AS q11_dec
    FROM lineitem GROUP BY ALL),
    one AS (SELECT run, count(*) AS files, count(*) FILTER (WHERE file > 2 AND NOT models) AS skips, """ + ", ".join(
    f'max(CASE WHEN file = {k} THEN "{c}" END) AS {name}_{c}'.replace('max(CASE WHEN file = %d THEN "models"' % k, 'bool_or(CASE WHEN file = %d THEN models' % k) for k, name in ((1, "a"), (2, "t"), (3, "r")) for c in ("mode", "models", "own", "whole", "q5", "q11", "enc", "whole_enc", "dec", "q5_dec", "q11_dec")
) + " FROM run GROUP BY run)"


def runs(t):
    n = lambda x: F.sum(F.expr(x))
    r = t("lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("file")).agg(
        (n("l_partkey") % 5).alias("mode"),
        (n("l_partkey") % 4 != 0).alias("models"),
        (n("l_orderkey") % 40000 + 20000).alias("own"),
        (n("l_orderkey") % 40000 + 20000 - n("l_partkey") % 3).alias("whole"),
        (n("l_partkey") % 60000 + 10000).alias("q5"),
        (n("l_partkey * 3") % 60000 + 10000).alias("q11"),
        (n("l_partkey + 1") % 300 + 1).alias("enc"),
        (n("l_orderkey + 1") % 300 + 1).alias("whole_enc"),
        (n("l_partkey + 2") % 300 + 1).alias("dec"),
        (n("l_orderkey + 2") % 300 + 1).alias("q5_dec"),
        (n("l_orderkey + 3") % 300 + 1).alias("q11_dec"),
    )
    columns = [c for c in r.columns if c not in ("run", "file")]
    at = [F.max(F.when(F.col("file") == k, F.col(c))).alias(f"{name}_{c}") for k, name in ((1, "a"), (2, "t"), (3, "r")) for c in columns]
    return r.groupBy("run").agg(F.count("*").alias("files"), F.count_if((F.col("file") > 2) & ~F.col("models")).alias("skips"), *at)


GATE_SQL = {
    "hybrid": (["a_mode = 1 AND a_models", "r_mode IN (2, 3)", "t_mode = 2", "a_own < a_q11", "a_dec > a_q11_dec", "true"],
        "CASE WHEN NOT (h1 AND h2 AND h6) THEN 'INVALID_ENVELOPE_SELECTION' WHEN h1 AND h2 AND h3 AND h4 AND h5 AND h6 THEN 'HYBRID_ARCHITECTURE_VALIDATED_DISCOVERY' ELSE 'HYBRID_ARCHITECTURE_PARTIAL_DISCOVERY' END"),
    "fast": (["a_mode = 1 AND a_models AND a_own = a_whole AND a_own < a_q5 AND a_dec > a_q5_dec", "true", "a_enc > a_whole_enc AND t_enc > t_whole_enc", "t_mode = 2 AND t_own = t_whole", "files = 7", "true"],
        "CASE WHEN h1 AND h2 AND h3 AND h4 AND h5 AND h6 THEN 'FAST-ENCODE-TRADEOFF-DISCOVERY' ELSE 'FAST-SEARCH-NO-THROUGHPUT-RETURN' END"),
    "budget": (["a_mode = 4 AND a_own < 33204", "t_mode = 2 AND t_own <= 120602", "skips >= 4", "a_enc > a_whole_enc AND t_enc > t_whole_enc", "a_own >= 0 AND a_q5 >= 0 AND a_q11 >= 0", "a_mode = 4 AND a_dec > a_q5_dec AND a_dec > a_q11_dec"],
        "CASE WHEN h1 AND h2 AND h3 AND h4 AND h5 AND h6 THEN 'PASS' ELSE 'FAIL' END"),
}


def gates_sql(name: str) -> str:
    gates, ruling = GATE_SQL[name]
    return f"SELECT '{name}' AS gate_table, run, h1, h2, h3, h4, h5, h6, {ruling} AS ruling FROM (SELECT run, {', '.join(f'coalesce({g}, false) AS h{i + 1}' for i, g in enumerate(gates))} FROM one)"


@query("gate_tables", f"WITH {RUNS} " + " UNION ALL ".join(map(gates_sql, GATE_SQL)))
def gate_tables(t):
    """The six gates and the ruling of each run under the hybrid, the fast and the budgeted protocol."""
    r = cut(runs(t))
    out = None
    for name, rule in (("hybrid", select.hybrid_gates), ("fast", select.fast_gates), ("budget", select.budget_gates)):
        gates, ruling = rule(F.col)
        gates = [F.coalesce(g, F.lit(False)) for g in gates]
        own = r.select(F.lit(name).alias("gate_table"), "run", *[g.alias(f"h{i + 1}") for i, g in enumerate(gates)], ruling(gates).alias("ruling"))
        out = own if out is None else out.unionByName(own)
    return out


SIZED = f"""blk AS (SELECT l_suppkey % 5 AS file, 4096 * (1 << (2 * (l_linenumber % 3))) AS block_size, (l_partkey * 3 + 50)::BIGINT AS a, (l_orderkey % 6000 + 60)::BIGINT AS b, l_quantity = 50 AS raw, (4096 * (1 << (2 * (l_linenumber % 3))))::BIGINT AS blen FROM lineitem),
    fr AS (SELECT *, 1 + {uv("2 + " + uv("blen") + " + a")} + 4 + 2 + {uv("blen")} + a AS fa, 1 + {uv("2 + " + uv("blen") + " + b")} + 4 + 2 + {uv("blen")} + b AS fb, 1 + {uv("blen")} + 4 + blen AS fraw FROM blk),
    whole AS (SELECT file, block_size, sum(a) * 97 // 100 AS wa, sum(b) * 96 // 100 AS wb FROM blk WHERE NOT raw GROUP BY ALL),
    su AS (SELECT file, block_size, count(*) AS blocks, count(*) FILTER (WHERE NOT raw AND a < b) AS wins_a, count(*) FILTER (WHERE NOT raw AND a >= b) AS wins_b, count(*) FILTER (WHERE raw) AS wins_raw, sum(CASE WHEN raw THEN fa ELSE least(fa, fb) END) AS oracle, sum(least(CASE WHEN raw THEN fa ELSE least(fa, fb) END, fraw)) AS oracle_any,
        sum(fa) AS sum_a, sum(CASE WHEN raw THEN 0 ELSE fb END) AS sum_b FROM fr GROUP BY ALL),
    wh AS (SELECT *, least(wa, wb) AS w, wb <= wa AS is_b FROM whole JOIN su USING (file, block_size)),
    fw AS (SELECT *, 1 + {uv("2 + " + uv("w") + " + w")} + 4 + 2 + {uv("w")} + w AS framed FROM wh)"""


@query("block_size_rollup", f"""WITH {SIZED} SELECT block_size::BIGINT AS block_size, sum(blocks)::BIGINT AS blocks, sum(wins_a)::BIGINT AS wins_a, sum(wins_b)::BIGINT AS wins_b, sum(wins_raw)::BIGINT AS wins_raw, sum(oracle)::BIGINT AS oracle, sum(oracle_any)::BIGINT AS oracle_any, sum(framed)::BIGINT AS whole_framed,
    sum(oracle - framed)::BIGINT AS regret, sum(CASE WHEN is_b THEN sum_b ELSE sum_a END - framed)::BIGINT AS warm_up FROM fw GROUP BY block_size""")  # fmt: skip
def block_size_rollup(t):
    """For each block size: the best backend block by block against one stream per file, and what starting anew costs."""
    size = F.lit(4096).cast("bigint") * F.pow(F.lit(4), F.col("l_linenumber") % 3).cast("bigint")
    b = t("lineitem").select((F.col("l_suppkey") % 5).alias("file"), size.alias("block_size"), (F.col("l_partkey") * 3 + 50).cast("bigint").alias("a"), (F.col("l_orderkey") % 6000 + 60).cast("bigint").alias("b"), (F.col("l_quantity") == 50).alias("raw"))
    b = b.withColumn("blen", F.col("block_size"))
    whole = b.where("not raw").groupBy("file", "block_size").agg((F.floor(F.sum("a") * 97 / 100)).cast("bigint").alias("wa"), (F.floor(F.sum("b") * 96 / 100)).cast("bigint").alias("wb"))
    return select.block_sizes(b, whole)


@query("proxy_regret", "WITH" + _leaf_sql() + """, p AS (SELECT l_suppkey, leaf_id, size, payload, row_number() OVER (PARTITION BY l_suppkey ORDER BY payload, leaf_id) AS proxy, row_number() OVER (PARTITION BY l_suppkey ORDER BY size, leaf_id) AS oracle FROM c),
    y AS (SELECT l_suppkey % 10 AS file, sum(size) FILTER (WHERE proxy = 1) AS chosen, sum(size) FILTER (WHERE oracle = 1) AS least FROM p GROUP BY 1)
    SELECT file, chosen::BIGINT AS chosen, least::BIGINT AS least, (chosen - least)::BIGINT AS regret, round(100.0 * (chosen - least) / least, 9) AS regret_pct FROM y
    UNION ALL SELECT -1, sum(chosen)::BIGINT, sum(least)::BIGINT, sum(chosen - least)::BIGINT, round(100.0 * sum(chosen - least) / sum(least), 9) FROM y
    UNION ALL SELECT -2, NULL, NULL, max(chosen - least)::BIGINT, max(round(100.0 * (chosen - least) / least, 9)) FROM y""")  # fmt: skip
def proxy_regret(t):
    """What choosing encodings by the cheap proxy costs in each file, in all (-1) and at worst (-2)."""
    from oreline.operators import leaves

    rows = t("lineitem").withColumn("tok", F.col("l_partkey"))
    found = leaves.leaf_candidates(leaves.leaf_sizes(leaves.column_profile(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "tok")), ["l_suppkey"])
    least = lambda c: F.min(F.struct(c, "leaf_id", "size"))["size"]
    each = found.groupBy("l_suppkey").agg(least("payload").alias("chosen"), F.min("size").alias("least"))
    files = cut(each.groupBy((F.col("l_suppkey") % 10).alias("file")).agg(F.sum("chosen").alias("chosen"), F.sum("least").alias("least")))
    return select.regret(files, "file")
