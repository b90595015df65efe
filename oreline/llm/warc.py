"""WARC archives and the monolithic gzip normaliser (operator 6).

Writers put each task's records into one archive that is a single gzip stream,
as crawlers that compress whole files leave them. The normaliser inflates such a stream
once, in pieces, rewrites every record as a gzip member of its own and writes a
sidecar index with each record's offset and length. Readers take records by that
index. Files go through pyarrow's file systems into the shared folder; each has a name of
its own for each attempt, and only names in the checkpointed manifest are read,
so lost executors leave at most unused files.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one
with the largest id is a response and the others revisit it. Payload digests are
aggregated before the exchange; digests that stand for one record drop out, and the
remaining table is broadcast below a bound and joined by a shuffle above it.

Defined cases: a null payload is empty; rows that repeat an id and its payload are
all responses if that id is the largest; a null id is below all others and refers to nothing of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, cut, fresh_path

CHUNK = 1 << 20
END = b"\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, record_type: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the response's headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    name = "none" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(3, "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + END + block + END


class RecordParser:
    """Cuts a stream of WARC bytes into whole records."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        at = 0
        while (head := self.held.find(END, at)) >= 0:
            size = content_length(bytes(self.held[at:head]))
            stop = head + 4 + size + 4
            if len(self.held) < stop:
                break
            yield bytes(self.held[at:stop])
            at = stop
        del self.held[:at]


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def content_length(head: bytes) -> int:
    return int(headers(head)["content-length"])


def parse(raw: bytes) -> dict:
    """The fields of one record; digest and size of a revisit are those of the full payload it stands for."""
    head, _, rest = raw.partition(END)
    h = headers(head)
    http, _, body = rest[: int(h["content-length"])].partition(END)
    size = int(headers(http)["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"record {h['warc-record-id']}: the payload is not what its header says")
    number = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(h["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to")), "payload": body}


def normalise(source: str, target: str) -> int:
    """Rewrite a monolithic archive with one gzip member per record; the index goes to ``target`` + ``.idx``.

    Inflates ``source`` once and holds a piece of it and a record at a time.
    Also takes files that already have several members.
    """
    from_fs, from_path = opened(source)
    to_fs, to_path = opened(target)
    inflate, parser, at, count, within = zlib.decompressobj(31), RecordParser(), 0, 0, False
    with from_fs.open_input_stream(from_path, compression=None) as src, to_fs.open_output_stream(to_path, compression=None) as out, to_fs.open_output_stream(to_path + ".idx", compression=None) as index:
        while data := src.read(CHUNK):
            while data:
                plain, within = inflate.decompress(data, 8 * CHUNK), True
                for raw in parser.feed(plain):
                    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    out.write(member)
                    index.write(json.dumps([at, len(member)]).encode() + b"\n")
                    at += len(member)
                    count += 1
                if inflate.eof:
                    data, inflate, within = inflate.unused_data, zlib.decompressobj(31), False
                else:
                    data = inflate.unconsumed_tail
        if parser.held or within:
            raise ValueError(f"{source} ends within a record")
    return count


def read_indexed(path: str) -> Iterator[bytes]:
    """The records of a normalised archive, by its index."""
    own, plain = opened(path)
    with own.open_input_stream(plain + ".idx", compression=None) as f:
        entries = [json.loads(x) for x in f.read().splitlines()]
    with own.open_input_file(plain) as f:
        for at, size in entries:
            yield zlib.decompress(f.read_at(size, at), 31)


def with_digests(pages: DataFrame, payload_col: str) -> DataFrame:
    """``pages`` with payload, payload_bytes and payload_digest."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.withColumn("_payload", payload).withColumn("_bytes", F.octet_length("_payload").cast("bigint")).withColumn("_digest", F.sha1("_payload"))


def roles(pages: DataFrame, *, id_col: str, payload_col: str, revisit_bytes: int, broadcast_rows: int) -> DataFrame:
    """``pages`` with ``_payload``, ``_bytes``, ``_digest`` and ``_last``, the response's id where a payload occurs twice."""
    own = with_digests(pages, payload_col)
    repeated = cut(
        own.where(F.col("_bytes") >= revisit_bytes).groupBy("_digest").agg(F.count("*").alias("n"), F.max(id_col).alias("_last")).where("n > 1").select("_digest", "_last")
    )
    right = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    return own.join(right, "_digest", "left")


def archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, broadcast_rows: int = 100_000, normalised: bool = True) -> DataFrame:
    """Write ``pages`` as archives into ``folder``; returns their manifest, a checkpointed table with ``path`` and ``records``.

    A monolithic archive is removed once its normalised form is complete.
    """
    rows = roles(pages.select(id_col, url_col, payload_col), id_col=id_col, payload_col=payload_col, revisit_bytes=revisit_bytes, broadcast_rows=broadcast_rows)
    rows = rows.select(id_col, F.col(url_col).cast("string"), "_payload", "_bytes", "_digest", "_last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        own, plain = opened(name)
        own.create_dir(plain.rpartition("/")[0], recursive=True)
        squeeze, count = zlib.compressobj(1, zlib.DEFLATED, 31), 0
        with own.open_output_stream(plain, compression=None) as out:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns[:2]] + [batch.column(2)] + [c.to_pylist() for c in batch.columns[3:]]
                for page, url, payload, size, digest, last in zip(*columns, strict=True):
                    kind = "response" if last is None or page == last else "revisit"
                    raw = record(page, url, payload.as_py().encode(), digest, size, last, kind)
                    out.write(squeeze.compress(raw))
                    count += 1
            out.write(squeeze.flush())
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])
        else:
            own.delete_file(plain)

    manifest = cut(batched(rows).mapInArrow(write, "path string, records bigint"))
    if not normalised:
        return manifest

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, counts = [], []
            for path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{folder}/{uuid.uuid4().hex}.members.warc.gz"
                if normalise(path, target) != n:
                    raise ValueError(f"{path} does not hold {n} records")
                paths.append(target)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    done = cut(manifest.mapInArrow(rewrite, "path string, records bigint"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own, plain = opened(path)
                if own.get_file_info(plain).type != fs.FileType.NotFound:
                    own.delete_file(plain)
            yield batch

    manifest.select("path").mapInArrow(remove, "path string").count()
    return done


def read(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for raw in read_indexed(path):
                    rows.append(parse(raw))
                    held += len(raw) if with_payload else 0
                    if not with_payload:
                        del rows[-1]["payload"]
                    if held > 8 * CHUNK or len(rows) >= 10_000:
                        yield out()
                        rows, held = [], 0
                yield out()

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return manifest.select("path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, normalise them and read them back, without the payloads."""
    return read(archive(pages, fresh_path(pages.sparkSession, "warc")), with_payload=False)
