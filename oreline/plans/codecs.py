"""Queries that code and decode whole tables, block by block."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from oreline.operators.codecs import bits, decode_all, encode_all, matches
from oreline.operators.codecs.registry import REGISTRY
from oreline.plans.registry import query
from oreline.sources import census, container, readers

BLOCK = 4096


def blocks(t):
    """Documents as blocks of bytes."""
    raw = F.encode("text", "UTF-8")
    n = F.ceil(F.octet_length("text") / BLOCK).cast("int")
    each = t("documents").where(n > 0).select("doc_id", raw.alias("raw"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_id"))
    return each.select("doc_id", "block_id", F.substring("raw", F.col("block_id") * BLOCK + 1, F.lit(BLOCK)).alias("data"))


def dealt(t):
    """The blocks, dealt to tasks anew: the table may be one row group, and a long document is one row, but coding costs far more than the exchange."""
    return blocks(t).repartition("doc_id", "block_id")


def round_trip(t, number: int):
    """Size of every block under a codec, and whether it comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            packed = encode_all(number, data)
            sizes = list(map(len, packed))
            ok = [a == b for a, b in zip(decode_all(number, packed), data, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(map(len, data)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(ok, pa.bool_())], names=["doc_id", "block_id", "n_bytes", "size", "ok"])

    return dealt(t).mapInArrow(run, "doc_id bigint, block_id int, n_bytes bigint, size bigint, ok boolean")


for _name, _number in {"huffman": 1, "rans": 2, "rans_clustered": 3, "arithmetic": 4, "mtf": 6, "bwt": 7, "bwt_huffman": 8, "self_reference": 11, "context_split": 13, "transpose": 14, "lz_rans": 15}.items():
    query(f"{_name}_roundtrip")(lambda t, n=_number: round_trip(t, n))
for _name, _number in {"sparse": 16, "word_reference": 17, "token_streams": 18, "measured_parse": 19, "gated_literals": 20, "sorted_indexed": 21}.items():
    query(f"{_name}_roundtrip")(lambda t, n=_number: round_trip(t, n))
query("repair_grammar")(lambda t: round_trip(t, 12))
query("default_exception_roundtrip")(lambda t: round_trip(t, 5))
query("lz_cheapest_roundtrip")(lambda t: round_trip(t, 10))


@query("lz_greedy_tokens")
def lz_greedy_tokens(t):
    """Tokens of a greedy parse and what they cover, per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in batch.column(2).to_pylist():
                tokens = matches.greedy_tokens(block)
                m = [x for x in tokens if x[0]]
                rows.append((len(tokens), len(m), sum(x[2] for x in m), sum(x[2] for x in tokens) == len(block), max((x[3] for x in m), default=0)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "block_id", "tokens", "matches", "matched_bytes", "covers", "farthest"])

    return blocks(t).mapInArrow(run, "doc_id bigint, block_id int, tokens bigint, matches bigint, matched_bytes bigint, covers boolean, farthest bigint")


@query("codec_grid")
def codec_grid(t):
    """The quicker codecs' bytes over all blocks, and whether all come back.

    Codecs 3, 4, 7, 8, 10, 11 and 13 to 21 are left out; each has a round trip of its own.
    """
    numbers = (0, 1, 2, 5, 6, 9, 12, 32, 33, 34, 35, 36, 37)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: [0, 0, 0, True] for n in numbers}
        for batch in batches:
            data = batch.column(2).to_pylist()
            for n, own in total.items():
                packed = encode_all(n, data)
                own[0] += len(data)
                own[1] += sum(map(len, data))
                own[2] += sum(map(len, packed))
                own[3] = own[3] and decode_all(n, packed) == data
        rows = [(REGISTRY[n].name, *v) for n, v in total.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["codec", "blocks", "n_bytes", "size", "ok"]), preserve_index=False)

    sums = dealt(t).mapInArrow(run, "codec string, blocks bigint, n_bytes bigint, size bigint, ok boolean")
    return sums.groupBy("codec").agg(F.sum("blocks").alias("blocks"), F.sum("n_bytes").alias("n_bytes"), F.sum("size").alias("size"), F.bool_and("ok").alias("roundtrip"))


@query("budgeted_selection")
def budgeted_selection(t):
    """The codec that each block is given, by size plus a price on decoding, raw where nothing gains."""
    return container.encode_blocks(blocks(t), ["doc_id", "block_id"], "data", (2, 9, 32, 36), 0.0005).select("doc_id", "block_id", "size", "codec", "payload_size", "crc")


@query("container_scan", """SELECT doc_id, ((strlen(text) + 4095) // 4096)::BIGINT AS blocks, strlen(text)::BIGINT AS size FROM documents WHERE text <> ''""")
def container_scan(t):
    """Documents written as containers, read again strictly: every block is decoded and its CRC compared, and a wrong one raises."""
    files = container.assemble(container.encode_blocks(blocks(t), ["doc_id", "block_id"], "data", (2, 32)), "doc_id", "block_id", BLOCK)
    return container.inspect(container.scan(files, "doc_id", with_data=True), "doc_id").select("doc_id", "blocks", "size")


@query("crc32_blocks")
def crc32_blocks(t):
    """CRC-32 of each block by the built-in function, and whether the library's agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [zlib.crc32(x) for x in batch.column(2).to_pylist()]
            fnv = [bits.fnv1a(x) - (1 << 63) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array([a == b for a, b in zip(own, batch.column(3).to_pylist(), strict=True)]), pa.array(fnv, pa.int64())], names=["doc_id", "block_id", "crc", "same", "fnv1a"])

    return blocks(t).withColumn("crc", F.crc32("data")).mapInArrow(run, "doc_id bigint, block_id int, crc bigint, same boolean, fnv1a bigint")


@query("packing_roundtrip")
def packing_roundtrip(t):
    """Fixed-width packing of each supplier's part keys, and whether it comes back."""
    groups = t("lineitem").groupBy("l_suppkey", F.floor(F.col("l_orderkey") / 1024).alias("part")).agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(2).to_pylist():
                x = np.array(v, dtype=np.uint64)
                width = int(x.max()).bit_length()
                packed = bits.pack(x, width)
                rows.append((len(x), width, len(packed), bool((bits.unpack(packed, len(x), width) == x).all())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]], names=["l_suppkey", "part", "n", "width", "size", "ok"])

    return groups.mapInArrow(run, "l_suppkey bigint, part bigint, n bigint, width bigint, size bigint, ok boolean")


#: Which container a page's bytes are put into, by its id.
PLANTED = "CASE page_id % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zip' WHEN 2 THEN 'png' WHEN 3 THEN 'zlib' ELSE 'zip' END"


def planted(number: int, raw: bytes) -> bytes:
    """A gzip file, a zip archive with sizes behind the data, a PNG, a zlib stream or an archive with 64-bit sizes."""
    if number % 5 == 0:
        return zlib.compress(raw, wbits=31)
    if number % 5 == 3:
        return zlib.compress(raw)
    if number % 5 == 2:
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        packed = zlib.compress(raw)
        half = len(packed) // 2
        return census.PNG + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")

    class Pipe(io.RawIOBase):  # can't seek, so sizes follow the data
        def __init__(self):
            super().__init__()
            self.parts = []

        def writable(self):
            return True

        def write(self, b):
            self.parts.append(bytes(b))
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z, z.open("page.html", "w", force_zip64=number % 5 == 4) as f:
        f.write(raw)
    return b"".join(pipe.parts)


@query("embedded_stream_census", f"""SELECT {PLANTED} AS kind, count(*)::BIGINT AS streams, count(*)::BIGINT AS verified, sum(strlen(html))::BIGINT AS plain_bytes FROM pages WHERE html <> '' GROUP BY 1""")
def embedded_stream_census(t):
    """Streams found in files that hold a gzip file, a zip archive, a PNG or a zlib stream each, between other bytes."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [b"head" + planted(i, h.encode()) + b"tail" for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    files = t("pages").where("html <> ''").select(F.col("page_id").alias("path"), "html").mapInArrow(wrap, "path bigint, content binary")
    return census.summary(census.census(files)).select("kind", "streams", "verified", "plain_bytes")


def per_row(rows, keys: list[str], kernel, fields: str):
    """keys and what ``kernel`` gives for the last column of each row."""
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = zip(*[(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in fields.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernel(v) for v in batch.column(len(keys)).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*keys, *names])

    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{own}, {fields}")


@query("leaf_roundtrip")
def leaf_roundtrip(t):
    """Every leaf's payload of each supplier's part keys, in parts of an order range: its size and whether it comes back."""
    from oreline.operators.codecs import columns

    part = F.floor(F.col("l_orderkey") / 4096)
    rows = t("lineitem").groupBy("l_suppkey", part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("v"))

    def kernel(tokens):
        sizes, ok = [], True
        for leaf in range(5):
            payload = columns.leaf_encode(leaf, tokens)
            sizes.append(None if payload is None else len(payload))
            ok = ok and (payload is None or columns.leaf_decode(leaf, payload, len(tokens)) == tokens)
        return (*sizes, ok)

    return per_row(rows, ["l_suppkey", "part"], kernel, "raw bigint, dict bigint, for bigint, delta bigint, dod bigint, ok boolean")


@query("region_carrier_roundtrip")
def region_carrier_roundtrip(t):
    """Each user's event records as a carrier of shapes and a raw region: its size and whether the lines come back."""
    from oreline.operators import shapes
    from oreline.operators.codecs import columns
    from oreline.plans.shapes import records

    broken = records(t).withColumn("rec", F.when(F.col("event_id") % 11 == 0, F.substring("rec", 1, 20)).otherwise(F.col("rec")))
    rows = broken.groupBy("user_id", F.floor(F.col("event_id") / 4096).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "rec"))), lambda x: x["rec"]).alias("v"))

    def kernel(lines):
        packed = columns.region_encode(lines, shapes.scalar_spans)
        return len(lines), sum(len(x.encode()) for x in lines), len(packed), columns.region_decode(packed) == lines

    return per_row(rows, ["user_id", "part"], kernel, "lines bigint, n_bytes bigint, size bigint, ok boolean")


@query("budget_gated_portfolio")
def budget_gated_portfolio(t):
    """Blocks of words under a general codec or a numeric model; models are only tried where the codec leaves room and the probe finds order."""
    from oreline.operators import series
    from oreline.operators.codecs import encode as code

    rows = series.series_blocks(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_partkey", 256)

    def kernel(words):
        v = np.array(words, dtype=np.int64) % series.RING
        raw = v.astype("<u4").tobytes()
        quick = len(code(36, raw))
        cheap = quick <= len(raw) // 8
        regular = not cheap and len(raw) >= 512 and series.numeric_probe(v)
        model = series.block_models(v)["model_size"] if regular else None
        best = min((n, k, name) for n, k, name in ((len(raw), 0, "raw"), (quick, 1, "codec"), (model, 2, "model")) if n is not None)
        return len(raw), quick, model, cheap, regular, best[2], best[0]

    return per_row(rows.select("l_suppkey", "block", "words"), ["l_suppkey", "block"], kernel, "n_bytes bigint, quick bigint, model bigint, cheap boolean, regular boolean, mode string, size bigint")


@query("series_segments_roundtrip")
def series_segments_roundtrip(t):
    """Blocks of words cut into segments of difference orders and range coded: segments, bytes, and whether they come back."""
    from oreline.operators import series
    from oreline.operators.codecs import measured

    rows = series.series_blocks(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_orderkey", 256)

    def kernel(words):
        packed = measured.series_encode(words)
        return len(words), len(measured.segments(np.array(words, dtype=np.float64))), len(packed), measured.series_decode(packed) == words

    return per_row(rows.select("l_suppkey", "block", "words"), ["l_suppkey", "block"], kernel, "n_words bigint, segments bigint, size bigint, ok boolean")


@query("deflate_replay")
def deflate_replay(t):
    """Whether each page's zlib stream, of a level, window, memory level and strategy by its id, can be written again from its text, and at which settings."""

    def kernel(i, html):
        c = zlib.compressobj(1 + i % 9, zlib.DEFLATED, 15 - i % 3, 9 - i % 2, census.STRATEGIES[i % 5])
        found = census.replay(c.compress((html or "").encode()) + c.flush())
        return (*found, True) if found else (None, None, None, None, False)

    rows = t("pages").select("page_id", F.struct("page_id", "html").alias("x"))
    return per_row(rows, ["page_id"], lambda x: kernel(x["page_id"], x["html"]), "level bigint, window bigint, memory bigint, strategy bigint, ok boolean")


@query("gcd_modulus")
def gcd_modulus(t):
    """The greatest common divisor of each supplier's order keys, scaled; partial divisors are taken before the exchange."""
    from pyspark.sql.functions import pandas_udf

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for k, g in frame.groupby("l_suppkey")["v"]:
                held[k] = int(np.gcd(np.gcd.reduce(g.to_numpy()), held.get(k, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["l_suppkey", "v"])

    @pandas_udf("bigint")
    def gcd(v: pd.Series) -> int:
        return int(np.gcd.reduce(v.to_numpy()))

    scaled = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * (F.col("l_suppkey") % 5 + 1)).alias("v"))
    return scaled.mapInArrow(partial, "l_suppkey bigint, v bigint").groupBy("l_suppkey").agg(gcd("v").alias("gcd"))


def bucket_candidates(data: bytes, k: int) -> list[np.ndarray]:
    """For each four-byte window the places of its k last earlier occurrences, -1 where there are fewer: one stable sort."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    win = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    order = np.argsort(win, kind="stable")
    out = []
    for back in range(1, k + 1):
        found = np.full(len(win), -1, dtype=np.int64)
        same = win[order[back:]] == win[order[:-back]] if len(win) > back else np.zeros(0, dtype=bool)
        found[order[back:][same]] = order[:-back][same]
        out.append(found)
    return out


#: Overlapping windows of four bytes in blocks of 4096 bytes, and the place of each one's last occurrences in its block.
WINDOWS = """w AS (SELECT doc_id, i // 4096 AS block, i % 4096 AS pos, substr(h, 2 * i + 1, 8) AS win FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, strlen(text) - 3)) AS i FROM documents WHERE strlen(text) >= 4) WHERE i % 4096 <= 4092)"""


@query("match_candidates", f"""WITH {WINDOWS}, c AS (SELECT *, lag(pos, 1) OVER p AS c1, lag(pos, 2) OVER p AS c2 FROM w WINDOW p AS (PARTITION BY doc_id, block, win ORDER BY pos))
    SELECT doc_id, block::BIGINT AS block, count(*)::BIGINT AS positions, count(c1)::BIGINT AS with_match, sum(pos - c1)::BIGINT AS nearest, count(c2)::BIGINT AS with_two FROM c GROUP BY doc_id, block""")  # fmt: skip
def match_candidates(t):
    """Earlier places of each four-byte window, the last two of its own bucket; a block is one row, so nothing is exchanged."""

    def kernel(block):
        near = bucket_candidates(block, 2)
        first, second = near
        at = np.arange(len(first))
        return len(at), int((first >= 0).sum()), (int((at - first)[first >= 0].sum()) if (first >= 0).any() else None), int((second >= 0).sum())

    b = blocks(t).where(F.octet_length("data") >= 4).select("doc_id", F.col("block_id").cast("bigint").alias("block"), "data")
    return per_row(b, ["doc_id", "block"], kernel, "positions bigint, with_match bigint, nearest bigint, with_two bigint")


@query("hot_operations", """WITH c AS (SELECT l_suppkey, l_quantity::BIGINT * 100 + (l_discount * 100)::BIGINT AS op, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, op::BIGINT AS op, n::BIGINT AS n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, op DESC) AS r FROM c) WHERE r <= 254""")  # fmt: skip
def hot_operations(t):
    """The 254 commonest operations of each supplier, ties to the larger key."""
    from pyspark.sql import Window

    op = F.col("l_quantity").cast("bigint") * 100 + F.round(F.col("l_discount") * 100).cast("bigint")
    c = t("lineitem").groupBy("l_suppkey", op.alias("op")).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), F.desc("op")))).where("rank <= 254")


@query("boundary_dilation", """WITH s AS (SELECT l_suppkey, l_partkey * 5 AS p FROM lineitem), d AS (SELECT DISTINCT l_suppkey, p + k AS place FROM s, (SELECT unnest(range(-8, 9)) AS k) WHERE p + k >= 0)
    SELECT l_suppkey, count(*)::BIGINT AS places, min(place)::BIGINT AS first, max(place)::BIGINT AS last FROM d GROUP BY l_suppkey""")  # fmt: skip
def boundary_dilation(t):
    """Places within eight of a token's start."""
    s = t("lineitem").select("l_suppkey", (F.col("l_partkey") * 5).alias("at")).distinct()
    d = s.select("l_suppkey", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - 8), F.col("at") + 8)).alias("place")).distinct()
    return d.groupBy("l_suppkey").agg(F.count("*").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"))


@query("step_regions", """WITH d AS (SELECT l_suppkey, l_orderkey // 64 AS v, row_number() OVER w AS i, l_orderkey // 64 - lag(l_orderkey // 64) OVER w AS d FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)),
    m AS (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (PARTITION BY l_suppkey ORDER BY i) THEN 1 ELSE 0 END AS new FROM d WHERE d IS NOT NULL), r AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY i) AS r FROM m)
    SELECT l_suppkey, min(i)::BIGINT AS first, count(*)::BIGINT AS steps, min(d)::BIGINT AS step FROM r GROUP BY l_suppkey, r HAVING count(*) >= 3""")  # fmt: skip
def step_regions(t):
    """Regions of a series that keep one step, by gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    v = F.floor(F.col("l_orderkey") / 64)
    d = t("lineitem").select("l_suppkey", F.row_number().over(w).alias("i"), (v - F.lag(v).over(w)).alias("d")).where("d IS NOT NULL")
    p = Window.partitionBy("l_suppkey").orderBy("i")
    new = F.when(F.lag("d").over(p).eqNullSafe(F.col("d")), 0).otherwise(1)
    return d.withColumn("new", new).withColumn("r", F.sum("new").over(p)).groupBy("l_suppkey", "r").agg(F.min("i").cast("bigint").alias("first"), F.count("*").alias("steps"), F.min("d").alias("step")).where("steps >= 3").drop("r")


@query("invariant_candidates", """WITH n AS (SELECT l_suppkey, l_partkey AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem),
    k AS (SELECT l_suppkey, i, v - i AS minus, v + i AS plus FROM n), c AS (SELECT l_suppkey, i, lag(i) OVER (PARTITION BY l_suppkey, minus ORDER BY i) AS a, lag(i) OVER (PARTITION BY l_suppkey, plus ORDER BY i) AS b FROM k)
    SELECT l_suppkey, count(a)::BIGINT AS minus_matches, count(b)::BIGINT AS plus_matches, sum(i - a)::BIGINT AS minus_distance FROM c GROUP BY l_suppkey""")  # fmt: skip
def invariant_candidates(t):
    """Earlier words with the same invariant, word less or plus its place, by a window over the derived key."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    k = t("lineitem").select("l_suppkey", i.alias("i"), F.col("l_partkey").alias("v")).select("l_suppkey", "i", (F.col("v") - F.col("i")).alias("minus"), (F.col("v") + F.col("i")).alias("plus"))
    last = lambda c: F.lag("i").over(Window.partitionBy("l_suppkey", c).orderBy("i"))
    c = k.select("l_suppkey", "i", last("minus").alias("a"), last("plus").alias("b"))
    return c.groupBy("l_suppkey").agg(F.count("a").alias("minus_matches"), F.count("b").alias("plus_matches"), F.sum(F.col("i") - F.col("a")).alias("minus_distance"))


@query("resumed_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version, o_custkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def resumed_rows(t):
    """A table of results in which a later run replaces the rows that it has and appends those that were missing."""
    rows = lambda k, name: t("orders").where(f"o_orderkey % {k} = 0").select("o_orderkey", F.lit(name).alias("version"), "o_custkey")
    replaced = readers.replace_rows(rows(2, "old"), rows(6, "new"), ["o_orderkey"])
    return readers.append_missing(replaced, rows(3, "new"), ["o_orderkey"])


@query("pin_mismatches", """SELECT 'page-' || page_id AS name, CASE WHEN page_id % 7 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM pages WHERE html IS NOT NULL AND (page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 13 = 0)""")
def pin_mismatches(t):
    """Pages as fetched files, of which some are missing, cut or altered, against their pinned sizes and digests."""
    i, html = F.col("page_id"), F.col("html")
    pages = t("pages").where("html is not null")
    pins = pages.select(F.concat(F.lit("page-"), i.cast("string")).alias("name"), F.octet_length(html).cast("bigint").alias("bytes"), F.md5(html).alias("md5"))
    content = F.when(i % 11 == 0, F.concat(html, F.lit("x"))).when(i % 13 == 0, F.concat(F.lit("x"), html)).otherwise(html)
    found = pages.where(i % 7 != 0).select(F.concat(F.lit("/files/page-"), i.cast("string")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return readers.verify_pins(found, pins)
