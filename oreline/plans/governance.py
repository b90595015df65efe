"""Queries over manifests, dates, URLs and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.functions.scalars import exact_fixed_point, url_allowed
from oreline.operators import govern
from oreline.plans.registry import query

#: Documents as a corpus manifest.
MANIFEST = """man AS (SELECT doc_id, sha256(text) AS digest, source AS family, CASE doc_id % 10 WHEN 0 THEN 'heldout' WHEN 1 THEN 'external' ELSE 'discovery' END AS split,
    CASE WHEN doc_id % 17 = 0 THEN '2024-02-30' WHEN doc_id % 19 = 0 THEN '24-1-1' ELSE '2024-01-15' END AS retrieved, n_chars, CASE WHEN doc_id % 23 = 0 THEN 'Src ' || source ELSE source END AS ident, lang FROM documents)"""


def manifest(t):
    i = F.col("doc_id")
    return t("documents").select(
        "doc_id",
        F.sha2("text", 256).alias("digest"),
        F.col("source").alias("family"),
        F.when(i % 10 == 0, "heldout").when(i % 10 == 1, "external").otherwise("discovery").alias("split"),
        F.when(i % 17 == 0, "2024-02-30").when(i % 19 == 0, "24-1-1").otherwise("2024-01-15").alias("retrieved"),
        "n_chars",
        F.when(i % 23 == 0, F.concat(F.lit("Src "), "source")).otherwise(F.col("source")).alias("ident"),
        "lang",
    )


#: Documents as sources of a corpus, with ids at the edges of what is allowed, and one thing or another missing.
SOURCES = """src AS (SELECT doc_id,
    CASE doc_id % 29 WHEN 0 THEN 'ab' WHEN 1 THEN 'abc' WHEN 2 THEN repeat('a', 64) WHEN 3 THEN repeat('a', 65) WHEN 4 THEN '1abc' WHEN 5 THEN 'a.bc' WHEN 6 THEN 'Abc' WHEN 7 THEN 'a_b-1' WHEN 8 THEN NULL ELSE 'doc-' || doc_id END AS ident,
    'org-' || (doc_id % 11) AS origin, 'fam_' || coalesce(source, '?') AS family, CASE WHEN doc_id % 10 = 0 THEN 'heldout' WHEN doc_id % 10 = 1 THEN 'external' WHEN doc_id % 10 < 4 THEN 'validation' ELSE 'discovery' END AS split,
    CASE WHEN doc_id % 31 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS digest, strlen(text)::BIGINT AS n_bytes,
    CASE doc_id % 37 WHEN 0 THEN 'http://h/' WHEN 1 THEN 'https://u:p@h/' WHEN 2 THEN 'https://h/#f' WHEN 3 THEN 'https:///x' WHEN 4 THEN NULL ELSE 'https://h.example/' || doc_id END AS url,
    CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE source END AS publisher, CASE WHEN doc_id % 43 = 0 THEN '' ELSE 'r1' END AS release, CASE WHEN doc_id % 47 <> 0 THEN 'cc0' END AS license, 'none' AS preprocess,
    CASE doc_id % 7 WHEN 0 THEN 'uint16le' WHEN 1 THEN 'text' ELSE 'raw-bytes' END AS representation, CASE WHEN doc_id % 53 <> 0 THEN doc_id % 2 = 0 END AS reconstructible, CASE WHEN doc_id % 3 = 0 THEN 'shift' END AS recipe,
    CASE doc_id % 59 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '24-1-1' WHEN 2 THEN '2999-01-01' WHEN 3 THEN NULL ELSE '2024-01-15' END AS retrieved, lang FROM documents)"""


def sources(t):
    i = F.col("doc_id")

    def cases(modulus, values, otherwise):
        out = None
        for k, v in values.items():
            v = v if hasattr(v, "alias") else F.lit(v)
            out = F.when(i % modulus == k, v) if out is None else out.when(i % modulus == k, v)
        return out.otherwise(otherwise)

    edge = {0: "ab", 1: "abc", 2: "a" * 64, 3: "a" * 65, 4: "1abc", 5: "a.bc", 6: "Abc", 7: "a_b-1", 8: None}
    return t("documents").select(
        "doc_id",
        cases(29, edge, F.concat(F.lit("doc-"), i.cast("string"))).alias("ident"),
        F.concat(F.lit("org-"), (i % 11).cast("string")).alias("origin"),
        F.concat(F.lit("fam_"), F.coalesce("source", F.lit("?"))).alias("family"),
        F.when(i % 10 == 0, "heldout").when(i % 10 == 1, "external").when(i % 10 < 4, "validation").otherwise("discovery").alias("split"),
        F.when(i % 31 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        cases(37, {0: "http://h/", 1: "https://u:p@h/", 2: "https://h/#f", 3: "https:///x", 4: None}, F.concat(F.lit("https://h.example/"), i.cast("string"))).alias("url"),
        F.when(i % 41 == 0, " ").otherwise(F.col("source")).alias("publisher"),
        F.when(i % 43 == 0, "").otherwise("r1").alias("release"),
        F.when(i % 47 != 0, "cc0").alias("license"),
        F.lit("none").alias("preprocess"),
        cases(7, {0: "uint16le", 1: "text"}, F.lit("raw-bytes")).alias("representation"),
        F.when(i % 53 != 0, i % 2 == 0).alias("reconstructible"),
        F.when(i % 3 == 0, "shift").alias("recipe"),
        cases(59, {0: "2024-02-30", 1: "24-1-1", 2: "2999-01-01", 3: None}, F.lit("2024-01-15")).alias("retrieved"),
        "lang",
    )


IDENT_SQL = "regexp_matches({}, '^[a-z][a-z0-9_-]{{2,63}}$')"
DATE_SQL = "coalesce(regexp_matches(retrieved, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(retrieved AS DATE) IS NOT NULL, false)"
RULES = {
    "ident": IDENT_SQL.format("ident"),
    "origin": IDENT_SQL.format("origin"),
    "family": IDENT_SQL.format("family"),
    "split": "split IN ('discovery', 'validation', 'heldout')",
    "sha256": "regexp_matches(digest, '^[0-9a-f]{64}$')",
    "positive": "n_bytes > 0",
    "url": "regexp_matches(url, '^https://[^/@#?\\s]+([/?][^#\\s]*)?$')",
    **{c: f"trim({c}) <> ''" for c in ("publisher", "release", "license", "preprocess")},
    "representation": "representation IN ('raw-bytes', 'uint8', 'uint16le', 'uint32le', 'uint64le', 'int16le', 'int32le', 'int64le', 'float32-bitcast-le', 'float64-bitcast-le')",
    "reconstructible": "reconstructible IS NOT NULL",
    "recipe": "NOT coalesce(representation <> 'raw-bytes' AND reconstructible, false) OR coalesce(trim(recipe) <> '', false)",
    "date": DATE_SQL,
    "future": f"NOT {DATE_SQL} OR try_cast(retrieved AS DATE) <= current_date",
}


@query("manifest_violations", f"WITH {SOURCES} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM src WHERE NOT coalesce({v}, false)" for k, v in RULES.items()))
def manifest_violations(t):
    """One row per source and rule of the manifest that it breaks."""
    return govern.violations(sources(t), ["doc_id"], govern.manifest_rules())


@query("manifest_structure", f"""WITH {SOURCES} SELECT count(*)::BIGINT AS sources, count(DISTINCT origin)::BIGINT AS origins, (count(*) FILTER (WHERE split = 'discovery'))::BIGINT AS discovery, (count(*) FILTER (WHERE split = 'validation'))::BIGINT AS validation,
    (count(*) FILTER (WHERE split = 'heldout'))::BIGINT AS heldout, count(DISTINCT origin) >= 3 AND bool_or(split = 'discovery') AND bool_or(split = 'validation') AND bool_or(split = 'heldout') AS complete FROM src""")  # fmt: skip
def manifest_structure(t):
    """Whether a manifest has origins and splits enough."""
    return govern.manifest_structure(sources(t))


ENTRIES = """ent AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'git-raw' WHEN 1 THEN 'https-file' WHEN 2 THEN 'archive-extract' WHEN 3 THEN 'host-installed' ELSE 'generate' END AS kind,
    CASE WHEN doc_id % 5 = 0 AND doc_id % 15 <> 0 THEN coalesce(source, 'none') || '/repo' END AS repository, CASE WHEN doc_id % 4 <> 0 THEN 'c1' END AS "commit", 'p' AS path, CASE WHEN doc_id % 6 <> 0 THEN 'https://h/' END AS url, CASE WHEN doc_id % 8 <> 2 THEN 'a.zip' END AS archive,
    CASE WHEN doc_id % 9 <> 3 THEN 'pkg' END AS host_install, CASE WHEN doc_id % 17 <> 0 THEN true END AS git_tracked, doc_id % 13 = 0 AS executable, CASE WHEN doc_id % 26 = 0 THEN 't' END AS toolchain, CASE WHEN doc_id % 5 = 4 AND doc_id % 20 <> 4 OR doc_id % 35 = 0 THEN 's' || (doc_id % 3) END AS synthetic,
    doc_id % 2 = 0 AS counted, CASE WHEN doc_id % 14 <> 0 THEN 'd' END AS counts_digest, CASE WHEN doc_id % 10 = 0 THEN 'heldout' WHEN doc_id % 10 = 1 THEN 'external' WHEN doc_id % 10 = 2 THEN NULL ELSE 'discovery' END AS role,
    'pub' || (doc_id % 97) AS publisher, 'prj' || (doc_id % 150) AS project, 'rel' || doc_id AS release, lang, CASE doc_id % 4 WHEN 0 THEN 'unknown-no-redistribution' WHEN 1 THEN 'permissive' ELSE 'attribution' END AS status,
    CASE WHEN doc_id % 12 <> 0 THEN doc_id % 4 <> 0 END AS redistribution, doc_id % 4 >= 2 AS attribution, CASE WHEN doc_id % 18 <> 2 THEN 'by' END AS attribution_text FROM documents)"""


def entries(t):
    i = F.col("doc_id")
    some = lambda when, value: F.when(when, F.lit(value) if isinstance(value, (str, bool)) else value)
    kind = F.when(i % 5 == 0, "git-raw").when(i % 5 == 1, "https-file").when(i % 5 == 2, "archive-extract").when(i % 5 == 3, "host-installed").otherwise("generate")
    return t("documents").select(
        "doc_id",
        kind.alias("kind"),
        some((i % 5 == 0) & (i % 15 != 0), F.concat(F.coalesce("source", F.lit("none")), F.lit("/repo"))).alias("repository"),
        some(i % 4 != 0, "c1").alias("commit"),
        F.lit("p").alias("path"),
        some(i % 6 != 0, "https://h/").alias("url"),
        some(i % 8 != 2, "a.zip").alias("archive"),
        some(i % 9 != 3, "pkg").alias("host_install"),
        some(i % 17 != 0, True).alias("git_tracked"),
        (i % 13 == 0).alias("executable"),
        some(i % 26 == 0, "t").alias("toolchain"),
        some(((i % 5 == 4) & (i % 20 != 4)) | (i % 35 == 0), F.concat(F.lit("s"), (i % 3).cast("string"))).alias("synthetic"),
        (i % 2 == 0).alias("counted"),
        some(i % 14 != 0, "d").alias("counts_digest"),
        F.when(i % 10 == 0, "heldout").when(i % 10 == 1, "external").when(i % 10 == 2, F.lit(None)).otherwise("discovery").alias("role"),
        F.concat(F.lit("pub"), (i % 97).cast("string")).alias("publisher"),
        F.concat(F.lit("prj"), (i % 150).cast("string")).alias("project"),
        F.concat(F.lit("rel"), i.cast("string")).alias("release"),
        "lang",
        F.when(i % 4 == 0, "unknown-no-redistribution").when(i % 4 == 1, "permissive").otherwise("attribution").alias("status"),
        some(i % 12 != 0, i % 4 != 0).alias("redistribution"),
        (i % 4 >= 2).alias("attribution"),
        some(i % 18 != 2, "by").alias("attribution_text"),
    )


#: What a source of each kind must have: (kind, column) by rule.
NEEDED = {"archive": ("archive-extract", "archive"), "commit": ("git-raw", "commit"), "host_install": ("host-installed", "host_install"), "path": ("git-raw", "path"), "repository": ("git-raw", "repository")}
PROVENANCE = {k: f"kind <> '{kind}' OR {c} IS NOT NULL" for k, (kind, c) in NEEDED.items()} | {
    "commit": "kind <> 'git-raw' OR \"commit\" IS NOT NULL",
    "url": "kind NOT IN ('https-file', 'archive-extract') OR url IS NOT NULL",
    "git_tracked": "git_tracked IS NOT NULL",
    "toolchain": "NOT executable OR toolchain IS NOT NULL",
    "synthetic": "(kind = 'generate') = (synthetic IS NOT NULL)",
    "counts_digest": "NOT counted OR counts_digest IS NOT NULL",
}
MISSING_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in sorted(PROVENANCE.items())) + "], lambda x: x IS NOT NULL), ';')"


@query("provenance_completeness", f"WITH {ENTRIES}, m AS (SELECT doc_id, kind, {MISSING_SQL} AS missing FROM ent) SELECT doc_id, kind, missing, missing = '' AS complete FROM m")
def provenance_completeness(t):
    """What each entry's provenance lacks for its kind of source."""
    rules = {k: (F.col("kind") != kind) | F.col(c).isNotNull() for k, (kind, c) in NEEDED.items()} | {
        "url": ~F.col("kind").isin("https-file", "archive-extract") | F.col("url").isNotNull(),
        "git_tracked": F.col("git_tracked").isNotNull(),
        "toolchain": ~F.col("executable") | F.col("toolchain").isNotNull(),
        "synthetic": (F.col("kind") == "generate") == F.col("synthetic").isNotNull(),
        "counts_digest": ~F.col("counted") | F.col("counts_digest").isNotNull(),
    }
    return govern.provenance(entries(t), "doc_id", "kind", rules)


@query("publisher_isolation", f"""WITH {ENTRIES}, l AS (SELECT doc_id, coalesce(role IN ('heldout', 'external'), false) AS sealed, unnest(['publisher', 'project', 'release', 'lang', 'repository']) AS d, unnest([publisher, project, release, lang, repository]) AS v FROM ent),
    o AS (SELECT DISTINCT d, v FROM l WHERE NOT sealed AND v IS NOT NULL), p AS (SELECT doc_id, coalesce(string_agg(d, ';' ORDER BY d) FILTER (WHERE o.v IS NOT NULL), '') AS problems FROM l LEFT JOIN o USING (d, v) WHERE sealed GROUP BY doc_id)
    SELECT doc_id, problems, problems = '' AS isolated FROM p""")  # fmt: skip
def publisher_isolation(t):
    """What sealed entries share with open ones."""
    return govern.isolation(entries(t), "doc_id", "role", ["heldout", "external"], ["publisher", "project", "release", "lang", "repository"])


@query("lineage_clusters", f"""WITH {ENTRIES} SELECT kind, value, count(*)::BIGINT AS members, min(doc_id) AS first FROM (SELECT doc_id, unnest(['generator', 'publisher', 'producer']) AS kind, unnest([synthetic, publisher, repository]) AS value FROM ent) WHERE value IS NOT NULL GROUP BY ALL""")
def lineage_clusters(t):
    """Entries by shared generator, publisher and producer, whatever their role."""
    return govern.lineages(entries(t).withColumnRenamed("doc_id", "id"), {"generator": "synthetic", "publisher": "publisher", "producer": "repository"})


LICENCE = {"attribution": "NOT attribution OR attribution_text IS NOT NULL", "redistribution": "status <> 'unknown-no-redistribution' OR coalesce(NOT redistribution, false)"}


@query("licence_completeness", f"""WITH {ENTRIES}, m AS (SELECT doc_id, status, status <> 'unknown-no-redistribution' OR coalesce(redistribution, false) AS admissible,
    array_to_string(list_filter([{", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in LICENCE.items())}], lambda x: x IS NOT NULL), ';') AS missing FROM ent) SELECT doc_id, status, missing, missing = '' AS complete, admissible FROM m""")  # fmt: skip
def licence_completeness(t):
    """What each entry's licence lacks, and whether it may be handed on."""
    e = entries(t)
    unknown = F.col("status") == "unknown-no-redistribution"
    rules = {"attribution": ~F.col("attribution") | F.col("attribution_text").isNotNull(), "redistribution": ~unknown | F.coalesce(~F.col("redistribution"), F.lit(False))}
    admissible = (~unknown | F.coalesce("redistribution", F.lit(False))).alias("admissible")
    return govern.provenance(e.select("*", admissible), "doc_id", "status", rules).join(e.select("doc_id", admissible), "doc_id")


@query("split_leakage", f"""WITH {MANIFEST} SELECT digest AS key, count(DISTINCT split)::BIGINT AS values, count(*)::BIGINT AS rows, 'origin' AS rule FROM man WHERE digest IS NOT NULL GROUP BY digest HAVING count(DISTINCT split) > 1
    UNION ALL SELECT family, count(DISTINCT split), count(*), 'family' FROM man WHERE family IS NOT NULL GROUP BY family HAVING count(DISTINCT split) > 1""")  # fmt: skip
def split_leakage(t):
    """Origins and families that stand in more than one split."""
    m = manifest(t)
    return govern.ambiguous(m, "digest", "split", "origin").unionByName(govern.ambiguous(m, "family", "split", "family"))


@query("duplicate_digest", f"WITH {MANIFEST} SELECT digest, count(*)::BIGINT AS n FROM man GROUP BY digest HAVING count(*) > 1")
def duplicate_digest(t):
    """Digests of more than one document."""
    return govern.duplicates(manifest(t), "digest")


@query("dedup_keep_first", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedup_keep_first(t):
    """The first document of each text."""
    return govern.keep_first(t("documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source"), ["digest"], "doc_id").select("digest", "doc_id", "source")


@query("registry_missing", "SELECT lang, source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s EXCEPT SELECT lang, source FROM documents WHERE n_chars > 5000")
def registry_missing(t):
    """Languages and sources without a long document: a registry less what was observed."""
    d = t("documents")
    universe = govern.with_every(d.select("lang").distinct(), "source", govern.roster(d, "source"))
    return universe.subtract(d.where("n_chars > 5000").select("lang", "source"))


@query("url_policy", "SELECT page_id, coalesce(regexp_matches(url, '^https://[^/@#?\\s]+([/?][^#\\s]*)?$'), false) AS allowed FROM pages")
def url_policy(t):
    """Which URLs are https without credentials or fragment."""
    return t("pages").select("page_id", url_allowed("url").alias("allowed"))


@query("monotone_timestamps", """WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (WHERE ts <= before))::BIGINT AS violations FROM b GROUP BY user_id""")  # fmt: skip
def monotone_timestamps(t):
    """Times that aren't after the one before them."""
    return govern.not_increasing(t("events"), ["user_id"], "event_id", "ts")


@query("fixed_point_exact", """WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '.1234' WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey ELSE c_custkey || '.25' END AS s FROM customer)
    SELECT c_custkey, CASE WHEN try_cast(s AS DECIMAL(30, 9)) = try_cast(s AS DECIMAL(30, 3)) THEN (try_cast(s AS DECIMAL(30, 3)) * 1000)::BIGINT END AS scaled FROM v""")  # fmt: skip
def fixed_point_exact(t):
    """Decimals scaled to thousandths, where that is exact."""
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(".1234"))).when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".25")))
    return t("customer").select("c_custkey", exact_fixed_point(s).alias("scaled"))


@query("date_order", "SELECT o_orderkey, o_orderdate::DATE > DATE '1996-06-30' AS late, strftime(o_orderdate, '%Y-%m-%d') <= '1997-01-01' AS by_text FROM orders")
def date_order(t):
    """Dates compared as dates and as ISO text."""
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", (d.cast("date") > F.lit("1996-06-30").cast("date")).alias("late"), (F.date_format(d, "yyyy-MM-dd") <= "1997-01-01").alias("by_text"))


@query("page_classes", """SELECT CASE WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' ELSE 'other' END AS class,
    CASE WHEN strlen(html) >= 8192 THEN 'long' WHEN strlen(html) >= 2048 THEN 'middle' ELSE 'short' END AS size_class, count(*)::BIGINT AS n, sum(strlen(html))::BIGINT AS n_bytes FROM pages GROUP BY ALL""")  # fmt: skip
def page_classes(t):
    """Pages by class of address and size."""
    u, n = F.col("url"), F.octet_length("html").cast("bigint")
    kind = F.when(F.startswith(u, F.lit("https://m.")), "mobile").when(F.startswith(u, F.lit("https://")), "secure").when(F.startswith(u, F.lit("http://")), "plain").otherwise("other")
    size = F.when(n >= 8192, "long").when(n >= 2048, "middle").otherwise("short")
    return t("pages").groupBy(kind.alias("class"), size.alias("size_class")).agg(F.count("*").alias("n"), F.sum(n).alias("n_bytes"))


@query("admission_checks", """WITH a AS (SELECT d.doc_id, sha256(d.text) AS digest, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, digest IS NOT NULL AS archived, quality IS NOT NULL AS rights, coalesce(toxic = 0, false) AS isolated, n_chars >= 100 AS typed,
        digest IS NOT NULL AND quality IS NOT NULL AND coalesce(toxic = 0, false) AND n_chars >= 100 AS admissible, false AS authorised FROM a""")  # fmt: skip
def admission_checks(t):
    """Documents joined with what they need for admission; nothing is ever authorised."""
    a = t("documents").join(t("labels"), "doc_id", "left")
    return govern.admission(a, "doc_id", {"archived": F.sha2("text", 256).isNotNull(), "rights": F.col("quality").isNotNull(), "isolated": F.col("toxic") == 0, "typed": F.col("n_chars") >= 100})


@query("artifact_conservation", """WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, sum(q)::BIGINT AS parts FROM (SELECT l_orderkey, l_linestatus, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL) GROUP BY 1)
    SELECT count(*)::BIGINT AS orders, sum(lines)::BIGINT AS lines, (count(*) FILTER (WHERE q <> parts))::BIGINT AS unbalanced, (count(*) FILTER (WHERE o_orderkey IS NULL))::BIGINT AS orphans FROM l JOIN s USING (l_orderkey) LEFT JOIN orders ON o_orderkey = l_orderkey""")  # fmt: skip
def artifact_conservation(t):
    """Whether parts add up to their wholes and every line has its order."""
    q = F.sum(F.col("l_quantity").cast("bigint"))
    whole = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), q.alias("q"))
    parts = t("lineitem").groupBy("l_orderkey", "l_linestatus").agg(q.alias("p")).groupBy("l_orderkey").agg(F.sum("p").alias("parts"))
    both = whole.join(parts, "l_orderkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("found")), "l_orderkey", "left")
    return both.agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.count_if(F.col("q") != F.col("parts")).alias("unbalanced"), F.count_if(F.col("found").isNull()).alias("orphans"))


@query("document_lint", r"""SELECT doc_id, len(regexp_extract_all(text, '[ \t]+\n'))::BIGINT AS trailing_space, len(regexp_extract_all(text, '\S+@\S+\.\S+'))::BIGINT AS addresses, regexp_matches(text, '\S\n?$') AS ends_clean FROM documents""")
def document_lint(t):
    """Patterns that a document shouldn't hold."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("bigint")
    return t("documents").select("doc_id", count(r"[ \t]+\n").alias("trailing_space"), count(r"\S+@\S+\.\S+").alias("addresses"), F.col("text").rlike(r"\S\n?\z").alias("ends_clean"))


@query("completeness", f"""WITH {MANIFEST} SELECT family, count(*)::BIGINT AS n, (count(*) FILTER (WHERE lang IS NULL))::BIGINT AS no_lang, (count(*) FILTER (WHERE quality IS NULL))::BIGINT AS no_label,
    (count(*) FILTER (WHERE digest IS NULL))::BIGINT AS no_digest, count(*) FILTER (WHERE quality IS NULL) = 0 AS complete FROM man LEFT JOIN labels USING (doc_id) GROUP BY family""")  # fmt: skip
def completeness(t):
    """What provenance each family lacks."""
    m = manifest(t).join(t("labels"), "doc_id", "left")
    missing = lambda c: F.count_if(F.col(c).isNull())
    return m.groupBy("family").agg(F.count("*").alias("n"), missing("lang").alias("no_lang"), missing("quality").alias("no_label"), missing("digest").alias("no_digest"), (missing("quality") == 0).alias("complete"))


@query("finite_values", """SELECT l_suppkey, (count(*) FILTER (WHERE l_tax > 0))::BIGINT AS positive, (count(*) FILTER (WHERE l_tax >= 0))::BIGINT AS not_negative, (count(*) FILTER (WHERE isfinite(l_discount / nullif(l_tax, 0))))::BIGINT AS finite_ratio FROM lineitem GROUP BY l_suppkey""")
def finite_values(t):
    """Counts of positive, non-negative and finite measurements."""
    r = F.try_divide("l_discount", "l_tax")
    return t("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_tax") > 0).alias("positive"), F.count_if(F.col("l_tax") >= 0).alias("not_negative"), F.count_if(~F.isnan(r) & (F.abs(r) < float("inf"))).alias("finite_ratio"))


@query("gate_battery", """WITH g AS (SELECT l_suppkey, 'g' || l_linenumber AS gate, sum(l_partkey) % 9 <> 0 AS ok FROM lineitem GROUP BY l_suppkey, l_linenumber)
    SELECT l_suppkey, count(*)::BIGINT AS gates, coalesce(string_agg(gate, ';' ORDER BY gate) FILTER (WHERE NOT ok), '') AS failed, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g GROUP BY l_suppkey""")  # fmt: skip
def gate_battery(t):
    """A battery of gates and its verdict."""
    g = t("lineitem").groupBy("l_suppkey", F.concat(F.lit("g"), "l_linenumber").alias("gate")).agg((F.sum("l_partkey") % 9 != 0).alias("ok"))
    return govern.verdicts(g, ["l_suppkey"], "gate", "ok")


@query("live_set_model", """SELECT o_orderkey, (o_custkey * 4096 + least(o_custkey * 4096, 1048576) * 5 + 262144)::BIGINT AS live_bytes FROM orders""")
def live_set_model(t):
    """A decoder's live bytes: input, a capped sub-block's transform at five bytes each, and fixed tables."""
    n = F.col("o_custkey") * 4096
    return t("orders").select("o_orderkey", (n + F.least(n, F.lit(1 << 20)) * 5 + (1 << 18)).alias("live_bytes"))


@query("schema_errors")
def schema_errors(t):
    """Where event properties break a typed schema."""
    spec = {"kind": "object", "fields": {"k": {"kind": "int", "least": 0, "most": 90}}}
    return govern.validate_json(t("events"), "event_id", "props", spec)


AUDITED = ["bands", "jaccard_den", "jaccard_num", "permutations", "shingle"]
LOCKS = """lk AS (SELECT s_suppkey AS lock FROM supplier), dc AS (SELECT lock, name, CASE WHEN name = 'jaccard_den' AND lock % 7 = 0 THEN 0 WHEN name = 'jaccard_den' AND lock % 11 = 0 THEN NULL ELSE 5 END AS value
    FROM lk, (SELECT unnest(['bands', 'jaccard_den', 'jaccard_num', 'permutations', 'shingle', 'speed']) AS name, unnest(range(6)) AS k) WHERE CASE WHEN name = 'speed' THEN lock % 4 = 0 ELSE lock % 6 <> k END)"""


@query("threshold_findings", f"""WITH {LOCKS}, rq AS (SELECT unnest(['bands', 'jaccard_den', 'jaccard_num', 'permutations', 'shingle']) AS name) SELECT lock, name, 'undeclared' AS code FROM (SELECT lock, name FROM lk, rq EXCEPT SELECT lock, name FROM dc)
    UNION ALL SELECT lock, name, 'unaudited' FROM dc WHERE name NOT IN (SELECT name FROM rq) UNION ALL SELECT lock, name, 'unusable' FROM dc WHERE name = 'jaccard_den' AND coalesce(value, 0) <= 0""")  # fmt: skip
def threshold_findings(t):
    """Thresholds that a lock lacks, that nobody audits, or that can't be used."""
    locks = t("supplier").select(F.col("s_suppkey").alias("lock"))
    names = [*AUDITED, "speed"]
    long = locks.select("lock", F.posexplode(F.array(*map(F.lit, names))).alias("k", "name"))
    lock = F.col("lock")
    value = F.when(F.col("name") != "jaccard_den", 5).when(lock % 7 == 0, 0).when(lock % 11 == 0, F.lit(None)).otherwise(5)
    declared = long.where(F.when(F.col("name") == "speed", lock % 4 == 0).otherwise(lock % 6 != F.col("k"))).select("lock", "name", value.alias("value"))
    return govern.threshold_findings(locks, declared, "lock", AUDITED, ["jaccard_den"])
