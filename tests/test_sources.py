"""Readers, sinks and streams on files written here."""

import hashlib
import json

import numpy as np
import pytest
from oreline.operators import series
from oreline.sources import container, generate, readers
from oreline.streaming import blocks as streams


def test_csv_is_strict(spark, tmp_path):
    head = "file,input_bytes,codec,compressed_bytes,ratio,encode_MBps,decode_MBps,roundtrip\n"
    (tmp_path / "a.csv").write_text(head + "f,10,c,5,0.5,1.0,,ok\n")
    r = readers.csv(spark, str(tmp_path / "a.csv"), readers.SUITE).collect()
    assert r[0]["compressed_bytes"] == 5 and r[0]["decode_MBps"] is None
    (tmp_path / "b.csv").write_text(head + "f,ten,c,5,0.5,1.0,2.0,ok\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        readers.csv(spark, str(tmp_path / "b.csv"), readers.SUITE).collect()
    (tmp_path / "c.tsv").write_text("a\tb\n1\tx y\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "c.tsv"), "a INT, b STRING").collect()] == [(1, "x y")]
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.required(readers.tsv(spark, str(tmp_path / "c.tsv"), "a INT, b STRING"), ["a", "z"])


def test_evidence_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"status": f"s{i}", "pairs": [{"pair": 1, "seconds": 0.5}]}, indent=1))
    r = readers.evidence(spark, str(tmp_path), "status STRING, pairs ARRAY<STRUCT<pair: INT, seconds: DOUBLE>>").collect()
    assert {x["status"] for x in r} == {"s0", "s1", "s2"} and all(x["file"].endswith(".json") and x["pairs"][0]["seconds"] == 0.5 for x in r)


def test_daily_lines(spark, tmp_path):
    fields = "".join(f"{v:5d} {q} " for v, q in [(d * 10 if d != 3 else -9999, "X" if d == 2 else " ") for d in range(1, 32)])
    (tmp_path / "a.dly").write_text("USC00012345202302TMAX" + fields + "\n")
    r = {x["date"].day: x for x in readers.daily(spark, str(tmp_path / "a.dly")).collect()}
    assert len(r) == 28 and r[1]["value"] == 10 and r[3]["value"] is None and r[2]["flag"] == "X" and r[1]["station"] == "USC00012345"


def test_water_levels(spark, tmp_path):
    doc = {"value": {"timeSeries": [{"sourceInfo": {"siteCode": [{"value": "01"}]}, "values": [{"value": [{"value": "1.250", "dateTime": "2024-01-01"}, {"value": "1.2345", "dateTime": "2024-01-02"}, {"value": "2", "dateTime": "2024-01-02"}]}]}]}}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    r = sorted(map(tuple, readers.water_levels(spark, str(tmp_path / "w.json")).select("time", "scaled", "ordered").collect()), key=str)
    assert r == sorted([("2024-01-01", 1250, True), ("2024-01-02", None, True), ("2024-01-02", 2000, False)], key=str)


def test_power_series(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"properties": {"parameter": {"T": {"20240101": 1.5, "20240102": -2}}}}))
    assert {(r["parameter"], r["day"], float(r["value"])) for r in readers.power_series(spark, str(tmp_path / "p.json")).collect()} == {("T", "20240101", 1.5), ("T", "20240102", -2.0)}


def test_profiles(spark, tmp_path):
    (tmp_path / "g.txt").write_text("Flat profile:\n  %   cumulative   self\n 60.00      0.60     0.60     100     0.01     0.01  decode_block\n 40.00      1.00     0.40                             main\n")
    assert {(r["function"], r["seconds"]) for r in readers.profile_lines(spark, str(tmp_path / "g.txt")).collect()} == {("decode_block", 0.6), ("main", 0.4)}


def test_database_pages(spark, tmp_path):
    import sqlite3

    c = sqlite3.connect(tmp_path / "x.db")
    c.execute("PRAGMA page_size = 4096")
    c.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(i, "x" * 50) for i in range(2000)])
    c.commit()
    c.close()
    kinds = {r["page"]: r["kind"] for r in readers.database_pages(readers.files(spark, str(tmp_path / "x.db"))).collect()}
    assert kinds[0] == "header" and "table_leaf" in kinds.values() and "table_interior" in kinds.values()


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in readers.replace_rows(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in readers.append_missing(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "C")}
    assert json.loads(readers.json_rows(old, "s/1").first()["value"]) == {"schema": "s/1", "k": 1, "v": "a"}
    assert readers.markdown(old.orderBy("k")) == "| k | v |\n| --- | --- |\n| 1 | a |\n| 2 | b |\n"
    with pytest.raises(ValueError):
        readers.markdown(old, most=1)


def test_pins(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"content")
    (tmp_path / "b").write_bytes(b"other")
    pins = spark.createDataFrame([("a", 7, hashlib.md5(b"content").hexdigest()), ("b", 5, "0" * 32), ("c", 1, "0" * 32)], "name string, bytes bigint, md5 string")
    assert {tuple(r) for r in readers.verify_pins(readers.files(spark, str(tmp_path)), pins).collect()} == {("b", "differs"), ("c", "missing")}


def test_block_streams(spark, tmp_path):
    source, coded = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a").write_bytes(b"streamed text " * 100)
    run = lambda: streams.run_once(streams.coded_blocks(streams.arriving_files(spark, str(source)), 256), str(coded), str(tmp_path / "ck"))
    run()
    assert spark.read.parquet(str(coded)).count() == 6
    (source / "b").write_bytes(b"x" * 100)
    run()
    assert spark.read.parquet(str(coded)).count() == 7  # what was done isn't done again


def test_container_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_bytes(container.write(b"streamed text " * 100, 256))
    streams.run_once(streams.checked_blocks(streams.arriving_files(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("block_id").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == b"streamed text " * 100


def test_event_windows(spark, data, tmp_path):
    path = f"{data}/events.parquet"
    schema = spark.read.parquet(path).schema
    batch = {(r["start"], r["event_type"]): r["n"] for r in streams.event_windows(spark.read.parquet(path)).collect()}
    stream = streams.event_windows(spark.readStream.schema(schema).parquet(path + "*"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.sql("SELECT * FROM windows").collect()} == batch


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("b", None)], "name string, content binary")
    assert {tuple(r) for r in readers.write_files(rows, str(tmp_path / "out")).collect()} == {("a", 3), ("b", 0)}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"a": b"one", "b": b""}


def test_callgrind(spark, tmp_path):
    (tmp_path / "c.out").write_text("events: Ir\nfn=(1) main\n10 5\ncalls=1 20\n12 700\n+3 2\nfn=(2) work\n20 700\n")
    assert {(r["function"], r["cost"]) for r in readers.callgrind(spark, str(tmp_path / "c.out")).collect()} == {("main", 7), ("work", 700)}


@pytest.mark.parametrize("name", sorted(generate.CORPORA))
def test_generated_corpora(spark, name):
    a = generate.content(spark, name, 60)
    assert a == generate.content(spark, name, 60) and a.startswith(generate.content(spark, name, 20))
    assert container.read(container.write(a, 512, (2, 9, 16, 17, 18, 32))) == a


def test_generated_words_suit_their_models(spark):
    words = [int.from_bytes(generate.arithmetic(i, 1)[:4], "little") for i in range(300)]
    found = series.block_models(np.array(words))
    assert found["model"] != "raw" and found["regular"]
    strides = [int.from_bytes(generate.arithmetic(i // 8, 1)[i % 8 * 4 :][:4], "little") for i in range(512)]
    assert series.block_models(np.array(strides))["stride"] == 8
