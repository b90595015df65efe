"""Every registered query of the engine against its SQL in DuckDB, and against itself under other partitionings."""

import math

import duckdb
import pytest

from oreline.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(text(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    described = {r[0]: r[1] for r in duck.sql(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()}
    assert sorted(described) == sorted(df.columns)
    for c, kind in df.dtypes:
        assert KINDS.get(kind, described[c]) == described[c], c
    order = list(described)
    own = [order.index(c) for c in sorted(order)]
    want = sorted(tuple(text(r[i]) for i in own) for r in duck.sql(ORACLE_SQL[name]).fetchall())
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, TESTDATA)
    rows = df.collect()
    assert rows or name == "minhash_pairs"
    for flag in ("ok", "roundtrip", "same", "covers"):
        if flag in df.columns:
            assert all(r[flag] for r in rows)


@pytest.mark.parametrize("name", ["leaf_select_lineitem", "shape_dictionary", "token_order_ordinal", "pareto_2d", "verdict_vs_best", "independence_components", "shingle_jaccard_pairs", "affine_median_model"])
def test_partitioning_changes_nothing(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows_of(QUERIES[name](spark, TESTDATA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    """The entry file imports and keeps its other queries when those operators are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "oreline", tmp_path / "oreline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); print('fine')"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip().endswith("fine"), said.stderr
