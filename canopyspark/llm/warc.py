"""WARC archives as a Python data source: write records, read them back with what is not needed left out.

Reading plans one partition per archive, or per run of whole records where an archive is longer than
``split_bytes`` (splits are found by record index files written beside archives, or the archive is one
partition). Each record's header is parsed first; filters on the record type and on header fields are
pushed down and decide there whether the record counts at all, and the payload of a record that does not,
or of any record when the reader asks for none, is skipped by seeking.

``dedupe`` decides which page of equal payloads is the response and which ones revisit it, from digests
alone: payloads do not travel but to the writer.

Archives of gzip members (``.warc.gz``) are read too, a partition each. A writer in mode overwrite replaces the
folder's archives when all its own are complete. URIs come back as they were written, white space included.

Edge cases: a null in a list that a header is compared with equals nothing; a null payload is empty; empty payloads are equal to each other; repeated page ids keep a row
each, the first written of the smallest id being the response; null ids come last and never are a response
unless all ids of the payload are null; an empty table gives an empty archive and an empty table; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from canopyspark.llm.common import cut, scratch, stable

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, page_id long, payload binary"
#: Column -> the header field that holds it.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Bytes", "page_id": "X-Page-ID",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
BUFFER = 1 << 20
#: Characters of a URI that stand in a header as they are; others, and the percent sign, are percent-encoded and come back as they were.
PRINTABLE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, payload: bytes, sha: str, size: int, record_id: str, uri: str | None, page_id: int | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Bytes: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe=PRINTABLE))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(f: io.BufferedIOBase, stop: int | None = None) -> Iterator[tuple[dict[str, str], int]]:
    """(header, block length) of each record; the file then stands at the block, and may be left anywhere within it."""
    while stop is None or f.tell() < stop:
        line = f.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {f.tell() - len(line)}")
        header: dict[str, str] = {}
        name = ""
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:  # a folded line
                header[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                header[name] = value.strip()
        begin, size = f.tell(), int(header.get("content-length", 0))
        yield header, size
        f.seek(begin + size)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def archive(where: fs.FileSystem, path: str) -> io.BufferedIOBase:
    """An archive to read from its beginning; a ``.gz`` one is a run of gzip members, which are unpacked as they are read."""
    raw = io.BufferedReader(where.open_input_file(path), BUFFER)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


@dataclass
class Span(InputPartition):
    """A run of whole records of one archive."""

    path: str
    start: int
    stop: int | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema) -> None:
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.names = [f.name for f in schema.fields]
        self.types: set[str] | None = None
        self.equal: dict[str, set] = {}
        self.needed: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on header fields; the header alone decides them."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo) and f.value is not None:
                self._allow(column, {f.value})
            elif column in FIELDS and isinstance(f, In):
                self._allow(column, {v for v in f.value if v is not None})  # nothing equals null
            elif column in FIELDS and isinstance(f, IsNotNull):
                self.needed.add(column)
            else:
                yield f

    def _allow(self, column: str, values: set) -> None:
        self.equal[column] = self.equal[column] & values if column in self.equal else values

    def partitions(self) -> list[Span]:
        """Archives by size; those with an index of record offsets are split at record starts."""
        where, root = opened(self.path)
        found = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True)):
            if not info.path.endswith((".warc", ".warc.gz")):
                continue
            uri = self.path.rstrip("/") + info.path[len(root.rstrip("/")) :]
            index = info.path[: -len(".warc")] + ".idx"
            cuts = [0]
            if info.path.endswith(".warc") and info.size > self.split and where.get_file_info(index).type == fs.FileType.File:
                with where.open_input_stream(index) as f:
                    for at in map(int, f.read().split()):
                        if at - cuts[-1] >= self.split:
                            cuts.append(at)
            found += [Span(uri, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return found or [Span("", 0, None)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        where, path = opened(span.path)
        rows: list[tuple] = []
        held = 0
        with archive(where, path) as f:
            if span.start:
                f.seek(span.start)
            for header, size in parse(f, span.stop):
                row = {c: header.get(h.lower()) for c, h in FIELDS.items()}
                row["target_uri"] = row["target_uri"] and unquote(row["target_uri"])
                for c in ("record_id", "refers_to"):
                    row[c] = row[c] and row[c].strip("<>")
                row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
                for c in ("payload_bytes", "page_id"):
                    row[c] = None if row[c] is None else int(row[c])
                if any(row[c] not in values for c, values in self.equal.items()) or any(row[c] is None for c in self.needed):
                    continue  # before a byte of the payload is read
                row["payload"] = f.read(size) if self.payloads else None
                rows.append(tuple(row[c] for c in self.names))
                held += size if self.payloads else 200
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "page_id": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(self.names, zip(*rows, strict=True), strict=True)], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    path: str
    index: str


class WarcWriter(DataSourceArrowWriter):
    """One archive and its index of record offsets per task, in files of their own names until the commit."""

    def __init__(self, options: dict[str, str], schema, overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.names = [f.name for f in schema.fields]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = opened(self.path)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}"
        starts, at = [], 0
        with where.open_output_stream(name + ".open", buffer_size=BUFFER) as out:
            for batch in batches:
                columns = {n: batch.column(n) for n in self.names}
                for k in range(batch.num_rows):
                    row = {n: c[k].as_py() for n, c in columns.items()}
                    data = record(row["record_type"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["record_id"], row["target_uri"], row["page_id"], row["refers_to"])
                    starts.append(at)
                    at += len(data)
                    out.write(data)
        with where.open_output_stream(name + ".idx") as out:
            out.write("\n".join(map(str, starts)).encode())
        return Written(name + ".open", name + ".idx")

    def commit(self, messages: list[Written | None]) -> None:
        where, root = opened(self.path)
        if self.overwrite:
            new = {x for m in messages if m is not None for x in (m.path, m.index)}
            for info in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if info.path.endswith((".warc", ".warc.gz", ".idx")) and info.path not in new:
                    where.delete_file(info.path)
        for m in messages:
            if m is not None:
                where.move(m.path, m.path[: -len(".open")] + ".warc")

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = opened(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.path)
                where.delete_file(m.index)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``.

    Options: path, payloads (false: no payload is read), split_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(hexadecimal: F.Column) -> F.Column:
    """Upper-case base32 of a column of hexadecimal digits whose number is a multiple of 10 (five bytes)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def five(at: F.Column) -> F.Column:
        number = F.conv(F.substring(hexadecimal, at * 5 + 1, F.lit(5)), 16, 10).cast("int")  # 20 bits are four letters
        return F.concat(*[F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), five), "")


def dedupe(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows of SCHEMA: a response for the smallest id of equal payloads of ``least_bytes`` or more, revisits for the others."""
    rows = stable(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select("sha", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_id")))
    if shared.count() <= broadcast_rows:  # few payloads occur twice: the pages need not be shuffled
        shared = F.broadcast(shared)
    told = rows.join(shared, "sha", "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    name = lambda row, page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"))
    return told.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("row"), F.col("page_id")).alias("record_id"), "target_uri",
        F.when(revisit, name(F.col("first_row"), F.col("first_id"))).alias("refers_to"), base32(F.col("sha")).alias("payload_digest"), "payload_bytes", "page_id",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def referred(record_id: F.Column) -> F.Column:
    """The page id in a record id."""
    return F.split(record_id, ":")[2].try_cast("long")


def verified(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a response's size and digest are those of its payload as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(5)
            full = [p.as_py() for p in payloads]
            kinds = batch.column(3).to_pylist()
            sizes = [len(p) if k == "response" else n for p, k, n in zip(full, kinds, batch.column(1).to_pylist(), strict=True)]
            shas = [digest(p) if k == "response" else d for p, k, d in zip(full, kinds, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), batch.column(3), batch.column(4)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    told = records.select("page_id", "payload_bytes", "payload_digest", "record_type", referred(F.col("refers_to")).alias("refers_to"), "payload")
    return told.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` to archives and read them back: responses with their payloads, revisits from their headers alone."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    dedupe(pages, **columns).write.format("warc").mode("append").save(path)
    response = spark.read.format("warc").load(path).where("record_type = 'response'")
    revisit = spark.read.format("warc").option("payloads", "false").load(path).where("record_type = 'revisit'")
    headers = revisit.select("page_id", "payload_bytes", "payload_digest", "record_type", referred(F.col("refers_to")).alias("refers_to"))
    return verified(response).unionByName(headers)


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as sha from p),
f as (select *, min(page_id) over (partition by sha) as first from d)
select page_id, payload_bytes::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1]), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f
"""
