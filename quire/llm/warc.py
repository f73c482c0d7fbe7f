"""A Spark data source for WARC archives, and an archive of pages in it.

Reading plans one partition for each file (the writer rolls files at ``ROLL`` bytes).
Record-type and header predicates are pushed down: headers are parsed first, and the block
of a record that they rule out is skipped by a seek, never read or decoded.  Filters on the
columns of FIELDS are pushed by Spark; for any other header field there are options,
``header.content-type`` for example, whose value the field must have.  Option ``payload`` is
``true`` or ``false``: without payloads every block is skipped.

Writing goes to files with names of their own in a temporary folder; the commit moves those
of the attempts that succeeded, so lost and repeated tasks leave nothing behind.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from quire.llm._frames import col, table
from quire.llm._scratch import Scratch, small_join

ROLL = 32 << 20
#: Payload bytes in a batch, at least one record.
BATCH = 8 << 20
#: Records under so many bytes are never revisits.
SMALL = 1000

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Columns that are header fields, by the field's name in lower case.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _open_fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def read_records(stream, wanted, payload: bool):
    """(headers, payload or None) of the records whose headers satisfy ``wanted``.

    ``stream`` is a binary file that can seek.  Header names are in lower case.
    """
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {stream.tell() - len(line)}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        left = int(headers.get("content-length", 0))
        if not wanted(headers):
            stream.seek(left, 1)
        elif not payload:
            stream.seek(left, 1)
            yield headers, None
        else:
            block = stream.read(left)
            if len(block) < left:
                raise ValueError("a record is cut off")
            if headers.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield headers, block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.tests = [(name.removeprefix("header."), {value}) for name, value in options.items() if name.startswith("header.")]

    def pushFilters(self, filters):
        for f in filters:
            name = FIELDS.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def partitions(self):
        from pyarrow import fs

        store, path = _open_fs(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path[len(path) :])
        return [File(n) for n in names] or [File("")]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = _open_fs(self.path)
        tests = self.tests

        def wanted(h):
            return all(h.get(name) is not None and (values is None or h[name] in values) for name, values in tests)

        def batch(rows):
            kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows, held = [], 0
        with store.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else _Buffered(raw)
            for headers, payload in read_records(stream, wanted, self.payload):
                length = headers.get("warc-payload-length")
                length = int(length) if length is not None else None if payload is None else len(payload)
                rows.append((*(headers.get(f) for f in FIELDS.values()), length, list(headers.items()), payload))
                held += len(payload or b"") + 500
                if held >= BATCH:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class _Buffered:
    """readline, read and forward seeks over a file of any store, in blocks."""

    SIZE = 1 << 20

    def __init__(self, raw):
        self.raw, self.end, self.base, self.data, self.at = raw, raw.size(), 0, b"", 0

    def tell(self):
        return self.base + self.at

    def _fill(self, n: int):
        where = self.tell()
        self.raw.seek(where)
        self.base, self.data, self.at = where, self.raw.read(max(n, self.SIZE)), 0

    def readline(self):
        while True:
            hit = self.data.find(b"\n", self.at)
            if hit >= 0:
                line, self.at = self.data[self.at : hit + 1], hit + 1
                return line
            have = len(self.data) - self.at
            if self.base + len(self.data) >= self.end:
                line, self.at = self.data[self.at :], len(self.data)
                return line
            self._fill(2 * have)

    def read(self, n: int):
        if len(self.data) - self.at < n:
            self._fill(n)
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def seek(self, n: int, whence: int):
        if self.at + n <= len(self.data):
            self.at += n
        else:
            self.base, self.data, self.at = self.tell() + n, b"", 0


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(kind: str, record_id: str, payload: bytes, digest: str, length: int, uri: str | None, refers_to: str | None) -> bytes:
    """One record as bytes; a revisit has the digest and length of the full payload, but no block."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    block = b""
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.zipped = options["path"], options.get("compression", "none") == "gzip"

    def write(self, iterator):
        store, path = _open_fs(self.path)
        store.create_dir(f"{path}/_temporary", recursive=True)
        files, out, size = [], None, 0
        part = TaskContext.get().partitionId()
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{path}/_temporary/part-{part:05d}-{len(files):04d}-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
                    files.append(name)
                    out, size = store.open_output_stream(name, compression=None), 0
                digest = r["payload_digest"] or hashlib.sha1(r["payload"] or b"").hexdigest()
                length = r["payload_length"] if r["payload_length"] is not None else len(r["payload"] or b"")
                raw = record(r["record_type"], r["record_id"], r["payload"] or b"", digest, length, r["target_uri"], r["refers_to"])
                raw = gzip.compress(raw, 6, mtime=0) if self.zipped else raw
                out.write(raw)
                size += len(raw)
                if size >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, path = _open_fs(self.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(name, f"{path}/{name.rpartition('/')[2]}")
        store.create_dir(f"{path}/_temporary", recursive=True)
        store.delete_dir(f"{path}/_temporary")

    def abort(self, messages):
        from pyarrow import fs

        store, path = _open_fs(self.path)
        if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``.

    Reading: a record without a field has null there; an empty folder gives no rows; files
    other than .warc and .warc.gz are passed over; a record that is cut off is an error.
    Writing: of null payload_digest and payload_length the payload's own are written, null
    payloads are empty, records are written as often as they come.  A payload has to fit in
    memory.  No column but those of SCHEMA is written.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archive pages: one record each.

    Of rows with equal payloads of at least SMALL bytes that with the largest id is the
    response and the others revisit it (rows that repeat its id are responses too; where all
    ids are null, all are).  Null html: an empty payload.  Null urls have no target.  Null ids
    are written as such and read back as null.
    """
    payload = F.coalesce(col(pages, html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(pages, id_col).cast("long").alias("id"), col(pages, url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long"))
    key = F.when(F.col("payload_length") >= SMALL, F.sha2("payload", 256))
    twins = rows.select("id", "payload_length", key.alias("same")).filter("same is not null").groupBy("same", "payload_length").agg(F.max("id").alias("first"), F.count("*").alias("copies"))
    twins = scratch.stage(twins.filter("copies > 1 and first is not null").select("same", "payload_length", "first"), "twins")
    told = small_join(rows.withColumn("same", key), scratch, "twins", twins, ["same", "payload_length"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    told.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload_length",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def page_id(c) -> F.Column:
    return F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def query(spark, sf_dir):
    register(spark)
    scratch = Scratch(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), scratch.path("archive"), scratch)
    records = spark.read.format("warc").load(scratch.path("archive"))
    revisit = F.col("record_type") == "revisit"
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        page_id(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, b, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
