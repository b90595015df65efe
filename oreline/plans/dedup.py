"""Queries over duplicates, shared content and independence units of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import dedup
from oreline.plans.registry import query
from oreline.session import cut

#: Texts with CRLF line ends in every second document, block size 64.
LINES = "CASE WHEN doc_id % 2 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"


def blocks_sql(text: str) -> str:
    return f"""b AS (SELECT DISTINCT doc_id, sha256(substr(x, i * 64 + 1, 64)) AS digest FROM (SELECT doc_id, x, unnest(range(0, length(x) // 64)) AS i FROM (SELECT doc_id, {text} AS x FROM documents))),
    n AS (SELECT digest, count(*) AS n FROM b GROUP BY digest)"""


def components_sql(links: str, nodes: str) -> str:
    """CTEs reach (closure of links by least root) and roots, for DuckDB."""
    return f"""{links}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    roots AS (SELECT n.id, least(n.id, min(r.b)) AS root FROM ({nodes}) n LEFT JOIN reach r ON r.a = n.id GROUP BY n.id)"""


@query("exact_duplicate_pairs", """WITH c AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), m AS (SELECT digest, min(doc_id) AS a, count(*) AS n FROM c GROUP BY digest)
    SELECT a, doc_id AS b, n::BIGINT AS class_size FROM c JOIN m USING (digest) WHERE doc_id > a""")  # fmt: skip
def exact_duplicate_pairs(t):
    """Each copy with the first document of its text."""
    c = dedup.classes(t("documents"), "doc_id", F.sha2("text", 256))
    return c.where("doc_id > class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"), "class_size")


@query("blob_length_pairs", """WITH c AS (SELECT doc_id, md5(text) || ':' || strlen(text) AS k FROM documents WHERE text IS NOT NULL), m AS (SELECT k, min(doc_id) AS a FROM c GROUP BY k)
    SELECT a, doc_id AS b FROM c JOIN m USING (k) WHERE doc_id > a""")  # fmt: skip
def blob_length_pairs(t):
    """Documents of equal blob id and length; nulls match nothing."""
    return dedup.star_links(t("documents").withColumn("k", F.concat(F.md5("text"), F.lit(":"), F.octet_length("text").cast("string"))), "doc_id", "k")


@query("shared_block_counts", f"WITH {blocks_sql('text')} SELECT doc_id, count(*)::BIGINT AS blocks, (count(*) FILTER (WHERE n > 1))::BIGINT AS shared_blocks FROM b JOIN n USING (digest) GROUP BY doc_id")
def shared_block_counts(t):
    """Aligned blocks of each document that another also has."""
    return dedup.shared_blocks(dedup.block_digests(t("documents"), "doc_id", F.col("text"), 64), "doc_id")


@query("shared_block_pairs", f"WITH {blocks_sql('text')}, m AS (SELECT digest, min(doc_id) AS a FROM b GROUP BY digest) SELECT DISTINCT a, doc_id AS b FROM b JOIN m USING (digest) WHERE doc_id > a")
def shared_block_pairs(t):
    """Links of documents through shared blocks, to the first document of each block."""
    return dedup.star_links(dedup.block_digests(t("documents"), "doc_id", F.col("text"), 64), "doc_id", "digest")


@query("crlf_block_pairs", f"WITH {blocks_sql('replace(' + LINES + ', chr(13) || chr(10), chr(10))')}, m AS (SELECT digest, min(doc_id) AS a FROM b GROUP BY digest) SELECT DISTINCT a, doc_id AS b FROM b JOIN m USING (digest) WHERE doc_id > a")
def crlf_block_pairs(t):
    """The same links where line ends differ: carriage returns before line feeds are dropped first."""
    text = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return dedup.star_links(dedup.block_digests(t("documents"), "doc_id", dedup.normalise_line_ends(text), 64), "doc_id", "digest")


SIMILAR = """w AS (SELECT min(doc_id) AS doc_id, regexp_extract_all(translate(replace(text, chr(13) || chr(10), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY 2),
    s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
    d AS (SELECT DISTINCT doc_id, g FROM s), k AS (SELECT doc_id, list_sort(list(g)) AS gs FROM d GROUP BY doc_id), c AS (SELECT gs, min(doc_id) AS id FROM k GROUP BY gs),
    f AS (SELECT id, len(gs) AS n, unnest(gs) AS g FROM c), p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM f x JOIN f y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id)"""


@query("shingle_jaccard_pairs", f"WITH {SIMILAR} SELECT a, b, shared::INT AS shared, (na + nb - shared)::INT AS total FROM p WHERE shared * 5 >= (na + nb - shared) * 4")
def shingle_jaccard_pairs(t):
    """Different sets of five-word shingles that are 0.8 alike or more."""
    return dedup.similar_sets(dedup.shingle_sets(t("documents"), "doc_id", "text", 5), "doc_id")


@query("shingle_jaccard_classes", f"""WITH {SIMILAR},
    y AS (SELECT a, b FROM p WHERE shared * 5 >= (na + nb - shared) * 4), n AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM y UNION ALL SELECT b FROM y) GROUP BY id),
    ws AS (SELECT doc_id, regexp_extract_all(translate(replace(text, chr(13) || chr(10), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    own AS (SELECT ws.doc_id, c.id AS class_id FROM ws JOIN w USING (w) JOIN k ON k.doc_id = w.doc_id JOIN c USING (gs))
    SELECT d.doc_id, coalesce(own.class_id, d.doc_id) AS class_id, coalesce(n.links, 0)::BIGINT AS links FROM documents d LEFT JOIN own USING (doc_id) LEFT JOIN n ON n.id = own.class_id""")  # fmt: skip
def shingle_jaccard_classes(t):
    """Each document with the first of its set of five-word shingles, and how many other sets are 0.8 like it or more."""
    sets = dedup.shingle_sets(t("documents"), "doc_id", "text", 5)
    return dedup.link_counts(sets, "doc_id", dedup.set_key("s"), cut(dedup.similar_sets(sets, "doc_id").select("a", "b")))


@query("benchmark_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(t):
    """Documents that hold a benchmark item's whole text."""
    return dedup.contained(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text")


@query("containment_status", """SELECT d.doc_id, CASE WHEN d.source = 'src1' THEN 'not_evaluated_sealed' WHEN count(b.item_id) > 0 THEN 'contained' ELSE 'clean' END AS status FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) AND d.source <> 'src1' GROUP BY d.doc_id, d.source""")
def containment_status(t):
    """Whether a document holds an item; sealed documents aren't evaluated, and so never called clean."""
    d = t("documents")
    found = dedup.contained(d.where("source <> 'src1'"), t("benchmark"), "doc_id", "text", "item_id", "text").select("doc_id").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("source") == "src1", "not_evaluated_sealed").when(F.col("hit"), "contained").otherwise("clean")
    return d.select("doc_id", "source").join(found, "doc_id", "left").select("doc_id", status.alias("status"))


META = """k AS (SELECT c_custkey AS id, 'c6' AS criterion, c_mktsegment || '/' || c_nationkey AS k FROM customer UNION ALL SELECT c_custkey, 'c7', floor(c_acctbal)::BIGINT::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'c8', CASE WHEN c_custkey % 40 = 0 THEN c_mktsegment END FROM customer),
    m AS (SELECT criterion, k, min(id) AS a FROM k WHERE k IS NOT NULL GROUP BY ALL)"""


def metadata(t):
    c = t("customer")
    keys = {
        "c6": F.concat_ws("/", "c_mktsegment", "c_nationkey"),
        "c7": F.floor("c_acctbal").cast("string"),
        "c8": F.when(F.col("c_custkey") % 40 == 0, F.col("c_mktsegment")),
    }
    out = None
    for name, key in keys.items():
        links = dedup.star_links(c.withColumn("k", key), "c_custkey", "k").withColumn("criterion", F.lit(name))
        out = links if out is None else out.unionByName(links)
    return out


@query("metadata_edges", f"WITH {META} SELECT a, id AS b, criterion FROM k JOIN m USING (criterion, k) WHERE id > a")
def metadata_edges(t):
    """Links through shared metadata: cluster and publisher, release, generator."""
    return metadata(t)


@query("independence_components", f"""WITH RECURSIVE c AS (SELECT doc_id, sha256(text) AS digest FROM documents), {components_sql("m AS (SELECT digest, min(doc_id) AS a FROM c GROUP BY digest), links AS (SELECT a, doc_id AS b FROM c JOIN m USING (digest) WHERE doc_id > a UNION SELECT item_first, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY item_id) AS item_first FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE doc_id > item_first)", "SELECT doc_id AS id FROM documents")}
    SELECT root, count(*)::BIGINT AS size, 'iu-' || substr(sha256(string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 16) AS unit FROM roots GROUP BY root""")  # fmt: skip
def independence_components(t):
    """Independence units: documents connected by equal text or a shared benchmark item."""
    d = t("documents")
    copies = dedup.star_links(d.withColumn("k", F.sha2("text", 256)), "doc_id", "k")
    shared = dedup.star_links(cut(dedup.contained(d, t("benchmark"), "doc_id", "text", "item_id", "text")), "doc_id", "item_id")
    return dedup.unit_ids(cut(dedup.with_roots(d, "doc_id", copies.union(shared))), "doc_id")


ROLES = """r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS unit, CASE WHEN doc_id % 10 = 0 THEN 'heldout' WHEN doc_id % 10 = 1 THEN 'external' WHEN doc_id % 10 = 9 THEN NULL ELSE 'discovery' END AS role, coalesce(toxic, 0) = 1 AS consumed FROM documents LEFT JOIN labels USING (doc_id))"""


@query("role_stratified_aggregate", f"""WITH {ROLES}, s AS (SELECT 'all' AS scope, * FROM r WHERE role IS NOT NULL UNION ALL SELECT 'role:' || role, * FROM r WHERE role IS NOT NULL AND NOT consumed UNION ALL SELECT 'heldout', * FROM r WHERE role IN ('heldout', 'external') AND NOT consumed)
    SELECT scope, count(*)::BIGINT AS n_rows, count(DISTINCT doc_id)::BIGINT AS n_ids, count(DISTINCT unit)::BIGINT AS n_units, scope = 'heldout' AND count(DISTINCT unit) > 0 AS promotion_authorised FROM s GROUP BY scope""")  # fmt: skip
def role_stratified_aggregate(t):
    """Counts for all roles, each role, and held-out roles alone."""
    i = F.col("doc_id")
    role = F.when(i % 10 == 0, "heldout").when(i % 10 == 1, "external").when(i % 10 == 9, F.lit(None)).otherwise("discovery")
    c = dedup.classes(t("documents"), "doc_id", F.sha2("text", 256)).join(t("labels"), "doc_id", "left")
    rows = c.select("doc_id", F.col("class_id").alias("unit"), role.alias("role"), (F.coalesce("toxic", F.lit(0)) == 1).alias("consumed"))
    return dedup.role_aggregate(rows, "role", "doc_id", "unit", "consumed", ["heldout", "external"])


@query("tombstone_matches", """WITH f AS (SELECT doc_id, unnest(['sha256', 'name', 'family']) AS field, unnest([sha256(text), lower(trim(source || '-' || doc_id)), lower(source)]) AS value FROM documents),
    t AS (SELECT 'sha256' AS field, sha256(text) AS value FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION SELECT 'name', 'src3-' || doc_id FROM labels UNION SELECT 'family', 'src7')
    SELECT doc_id, field, value FROM f JOIN t USING (field, value)""")  # fmt: skip
def tombstone_matches(t):
    """Documents that match a consumed entry in any of their hash and name fields."""
    d = t("documents")
    fields = d.select("doc_id", F.sha2("text", 256).alias("digest"), F.lower(F.trim(F.concat_ws("-", "source", "doc_id"))).alias("name"), F.lower("source").alias("family"))
    long = fields.unpivot("doc_id", ["digest", "name", "family"], "field", "value").withColumn("field", F.when(F.col("field") == "digest", "sha256").otherwise(F.col("field")))
    toxic = d.join(t("labels").where("toxic = 1"), "doc_id").select(F.lit("sha256").alias("field"), F.sha2("text", 256).alias("value"))
    stones = toxic.union(t("labels").select(F.lit("name"), F.concat(F.lit("src3-"), F.col("doc_id").cast("string")))).union(toxic.sparkSession.range(1).select(F.lit("family"), F.lit("src7"))).distinct()
    return long.join(stones, ["field", "value"]).select("doc_id", "field", "value")


@query("minhash_pairs")
def minhash_pairs(t):
    """Pairs whose MinHash signatures agree in 0.8 of their places or more."""
    sets = dedup.shingle_sets(t("documents"), "doc_id", "text", 5)
    return dedup.minhash_pairs(dedup.minhash_signatures(sets, "doc_id"), "doc_id")


@query("minhash_classes")
def minhash_classes(t):
    """Each document with the first of its MinHash signature, and how many other signatures agree with it in 0.8 of their places or more."""
    sigs = cut(dedup.minhash_signatures(dedup.shingle_sets(t("documents"), "doc_id", "text", 5), "doc_id"))
    return dedup.link_counts(sigs, "doc_id", dedup.set_key("sig"), cut(dedup.minhash_pairs(sigs, "doc_id").select("a", "b")))
