"""Validation as tables of violations: one row per row and rule that it breaks.

Rules are expressions, so any number of them is one pass. A rule holds where
its expression is true; null counts as a violation.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalars import url_allowed

#: Fixed values of the manifest format: what digests and ids look like, the splits and the representations there are.
SHA256 = r"^[0-9a-f]{64}\z"
IDENT = r"^[a-z][a-z0-9_-]{2,63}\z"
SPLITS = ("discovery", "validation", "heldout")
REPRESENTATIONS = ("raw-bytes", "uint8", "uint16le", "uint32le", "uint64le", "int16le", "int32le", "int64le", "float32-bitcast-le", "float64-bitcast-le")


def filled(text: Column | str) -> Column:
    """Whether a text is there and has more than white space."""
    return F.coalesce(F.length(F.trim(F.col(text) if isinstance(text, str) else text)) > 0, F.lit(False))


def manifest_rules(today: Column | None = None) -> dict[str, Column]:
    """The rules of a source's record, for rows with the manifest's columns."""
    c = F.col
    rebuilt = (c("representation") != "raw-bytes") & c("reconstructible")
    return {
        "ident": c("ident").rlike(IDENT),
        "origin": c("origin").rlike(IDENT),
        "family": c("family").rlike(IDENT),
        "split": c("split").isin(*SPLITS),
        "sha256": c("digest").rlike(SHA256),
        "positive": c("n_bytes") > 0,
        "url": url_allowed("url"),
        **{name: filled(name) for name in ("publisher", "release", "license", "preprocess")},
        "representation": c("representation").isin(*REPRESENTATIONS),
        "reconstructible": c("reconstructible").isNotNull(),
        "recipe": ~F.coalesce(rebuilt, F.lit(False)) | filled("recipe"),
        "date": valid_date(c("retrieved")),
        "future": ~valid_date(c("retrieved")) | (F.try_to_date(c("retrieved"), "yyyy-MM-dd") <= (F.current_date() if today is None else today)),
    }


def manifest_structure(rows: DataFrame, least_origins: int = 3) -> DataFrame:
    """One row: sources and origins, how many of each split, and whether that is enough to be frozen."""
    each = [F.count_if(F.coalesce(F.col("split") == s, F.lit(False))).alias(s) for s in SPLITS]
    found = rows.agg(F.count("*").alias("sources"), F.countDistinct("origin").alias("origins"), *each)
    enough = F.col("origins") >= least_origins
    for s in SPLITS:
        enough &= F.col(s) > 0
    return found.withColumn("complete", enough)


def roster(rows: DataFrame, col: str, most: int = 10_000) -> list:
    """The distinct values of a registry's column, of which there may be ``most``; more raise."""
    found = [r[0] for r in rows.select(col).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return found


def with_every(rows: DataFrame, name: str, values: list, kind: str = "string") -> DataFrame:
    """Each row once with every value of a roster."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")))


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule, for every rule that a row breaks."""
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    return rows.select(*keys, F.explode(F.array_compact(broken)).alias("rule"))


def ambiguous(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys with more than one value: an origin or family in two splits, an id of two digests."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.countDistinct(value).alias("values"), F.count("*").alias("rows")).where("values > 1").withColumn("rule", F.lit(name))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; one combinable aggregation."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("_m")).select(*keys, F.col("_m._o").alias(order), *[f"_m.{c}" for c in rest])


def not_increasing(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys and how many values aren't above the one before them."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_before", before).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value) <= F.col("_before")).alias("violations"))


def valid_date(text: Column) -> Column:
    """Whether a text is a date in ISO form that exists."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def admission(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Every check beside its conjunction. It never authorises: ``authorised`` stays false even if all checks hold."""
    named = [F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]
    every = F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()]), lambda x: x)
    return rows.select(key, *named, every.alias("admissible"), F.lit(False).alias("authorised"))


def canonical(value) -> str:
    """JSON text that equal values share: keys sorted, arrays named as sets sorted by their own canonical text."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(sorted(v, key=canonical) if k.endswith('_set') and isinstance(v, list) else v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def identity(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def schema_errors(value, spec: dict, path: str = "$") -> list[str]:
    """Where a value breaks a typed schema: kinds, exact keys, constants, patterns, enums, bounds, empty values and order, all the way down."""
    kinds = {"object": dict, "array": list, "string": str, "bool": bool, "int": int, "number": (int, float)}
    kind = spec["kind"]
    if value is None and spec.get("nullable"):
        return []
    if not isinstance(value, kinds[kind]) or (kind in ("int", "number") and isinstance(value, bool)):
        return [f"{path}: not {kind}"]
    out = []
    if "const" in spec and (value != spec["const"] or isinstance(value, bool) != isinstance(spec["const"], bool)):
        out.append(f"{path}: not {spec['const']!r}")
    if spec.get("nonempty") and (not value or (kind == "string" and not value.strip())):
        out.append(f"{path}: empty")
    if kind == "array" and spec.get("sorted_unique") and any(not isinstance(x, type(y)) or not x < y for x, y in zip(value, value[1:], strict=False)):
        out.append(f"{path}: not sorted and distinct")
    if "enum" in spec and value not in spec["enum"]:
        out.append(f"{path}: not one of the allowed values")
    if kind == "string" and "pattern" in spec and not re.fullmatch(spec["pattern"], value):
        out.append(f"{path}: doesn't match")
    if kind in ("int", "number"):
        if "least" in spec and value < spec["least"]:
            out.append(f"{path}: below {spec['least']}")
        if "most" in spec and value > spec["most"]:
            out.append(f"{path}: above {spec['most']}")
    if kind == "array":
        if len(value) < spec.get("least_items", 0):
            out.append(f"{path}: too few items")
        for i, x in enumerate(value):
            out += schema_errors(x, spec["items"], f"{path}[{i}]")
    if kind == "object":
        fields = spec["fields"]
        out += [f"{path}.{k}: missing" for k in fields if k not in value and not fields[k].get("optional")]
        out += [f"{path}.{k}: unknown" for k in value if k not in fields]
        for k, x in value.items():
            if k in fields:
                out += schema_errors(x, fields[k], f"{path}.{k}")
    return out


def validate_json(rows: DataFrame, id_col: str, text_col: str, spec: dict) -> DataFrame:
    """id_col and error for every place where a JSON text breaks ``spec``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at, errors = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    own = schema_errors(json.loads(text), spec) if text is not None else ["$: null"]
                except ValueError:
                    own = ["$: not JSON"]
                at += [i] * len(own)
                errors += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(errors, pa.string())], names=[id_col, "error"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, error string")


def verdicts(gates: DataFrame, keys: list[str], gate: str, passed: str) -> DataFrame:
    """Over rows of gates: how many there are, which failed, and the overall verdict; no gate at all fails."""
    return gates.groupBy(*keys).agg(
        F.count("*").alias("gates"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col(passed), F.col(gate)))), ";").alias("failed"),
        F.when(F.bool_and(passed), "PASS").otherwise("FAIL").alias("verdict"),
    )


def provenance(rows: DataFrame, key: str, kind: str, rules: dict[str, Column]) -> DataFrame:
    """key, kind, complete and missing: the names of the rules that a row breaks, in order, each a condition that must hold."""
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in sorted(rules.items())])
    return rows.select(key, kind, F.array_join(F.array_compact(broken), ";").alias("missing")).withColumn("complete", F.col("missing") == "")


def isolation(rows: DataFrame, key: str, role: str, sealed: list[str], dimensions: list[str]) -> DataFrame:
    """Of every row in a sealed role, which of its ``dimensions`` rows in open roles have as well; a null is shared with none.

    Values of open roles are aggregated to one row each before the join, so a value that many rows have costs no more than any other.
    """
    is_sealed = F.coalesce(F.col(role).isin(*sealed), F.lit(False))
    long = rows.select(key, is_sealed.alias("_s"), F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dimensions])).alias("_x"))
    shared = long.where("not _s and _x.v is not null").select("_x.d", "_x.v").distinct().withColumn("_hit", F.lit(True))
    hits = long.where("_s").select(key, "_x.d", "_x.v").join(shared, ["d", "v"], "left").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.col("d")))), ";").alias("problems"))
    return hits.withColumn("isolated", F.col("problems") == "")


def lineages(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """kind, value, members and first of the rows that share a generator, publisher or producer; nulls share nothing."""
    long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in columns.items()])).alias("_x"))
    return long.where("_x.value is not null").groupBy("_x.kind", "_x.value").agg(F.count("*").alias("members"), F.min("id").alias("first"))


def threshold_findings(locks: DataFrame, declared: DataFrame, key: str, required: list[str], denominators: list[str]) -> DataFrame:
    """key, name and code where a lock doesn't declare exactly the audited thresholds (undeclared, unaudited) or one can't be used (a denominator that isn't positive).

    ``locks`` has every key, ``declared`` has key, name and value.
    """
    wanted = with_every(locks.select(key), "name", required)
    known = F.col("name").isin(*required)
    missing = wanted.join(declared.select(key, "name"), [key, "name"], "left_anti").withColumn("code", F.lit("undeclared"))
    extra = declared.where(~known).select(key, "name", F.lit("unaudited").alias("code"))
    unusable = declared.where(F.col("name").isin(*denominators) & ~F.coalesce(F.col("value") > 0, F.lit(False))).select(key, "name", F.lit("unusable").alias("code"))
    return missing.unionByName(extra).unionByName(unusable)


def code_thresholds(source: str, pinned: dict[str, float] | None = None) -> list[str]:
    """Names of numbers that a module's source sets at its top level or as a parameter's default, other than those pinned: thresholds that are in no lock."""
    import ast

    pinned = pinned or {}
    number = lambda x: isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool)
    tree, found = ast.parse(source), []
    for node in tree.body:
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None and number(node.value):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            found += [t.id for t in targets if isinstance(t, ast.Name) and pinned.get(t.id) != node.value.value]
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            a = node.args
            pairs = [*zip([*a.posonlyargs, *a.args][::-1], a.defaults[::-1], strict=False), *((x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None)]
            found += [f"{node.name}.{x.arg}" for x, d in pairs if number(d) and pinned.get(x.arg) != d.value]
    return sorted(found)
