"""WARC archives as a Spark data source, and deduplicated writing of pages.

Reading plans partitions of whole files up to a size. A task reads a record's header first; equality and membership
predicates on the header columns are pushed down and decided there, and the block of an unwanted record is skipped, not
decoded. So is every block where option ``payload`` is ``false``. Archives written here put header and block of a record
into gzip members of their own, each with its length in an extra field, so that skipping is a seek; other ``.warc.gz``
files (a member a record) and plain ``.warc`` files are read as well, where skipping costs a decompression, or a seek.

Each writing task writes a file of its own under a new name, and the commit names the files that count in a manifest;
files of failed attempts are never read. Files are reached through pyarrow's file systems, so the folder may be any that
driver and executors share.

Defined results: a null html or url is an empty one; a null page_id is last among equal payloads and named by nothing, a
repeated one names its rows alike; a very long page is one record, held whole by the task that writes or reads it; control characters in header values are percent-encoded; equal
rows are written each; an empty table gives an empty archive; records that end early or lack a version line raise."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quillspark.llm.tables import fresh, table

#: Header fields that are columns, and so can be filtered before a payload is decoded.
COLUMNS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", headers map<string,string>, payload binary"
INPUT = "type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length string, payload binary"
_MANIFEST, _DATE = "_archives.json", "2024-01-01T00:00:00Z"
_EXTRA = struct.Struct("<2sHI")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member whose extra field QL has its own length."""
    c = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 12 + 8 + len(body) + 8
    return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", 8), _EXTRA.pack(b"QL", 4, size), body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)))


def record(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    lines = "".join(f"{k}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields.items() if v)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode(), block + b"\r\n\r\n"


class _Input:
    """Reads an archive's bytes in order, through gzip members where there are such, and can skip."""

    def __init__(self, stream) -> None:  # noqa: ANN001  an open pyarrow file
        self.stream, self.held, self.at = stream, b"", 0
        self.ended = False
        self.zipped = self._raw(2) == b"\x1f\x8b"
        self.unpacker = None
        self.out = bytearray()  # grows at its end and shrinks at its front without being copied

    def _fill(self, n: int) -> None:
        while len(self.held) - self.at < n and not self.ended:
            more = self.stream.read(1 << 18)
            self.ended = not more
            self.held, self.at = self.held[self.at :] + more, 0

    def _raw(self, n: int) -> bytes:
        self._fill(n)
        return self.held[self.at : self.at + n]

    def _more(self) -> bool:
        """Unpacks some more into ``out``; false at the end."""
        if not self.zipped:
            part = self._raw(1 << 16)
            self.at += len(part)
            self.out += part
            return bool(part)
        if self.unpacker is None:
            if not self._raw(1):
                return False
            self.unpacker = zlib.decompressobj(31)
        part = self._raw(1 << 16)
        if not part:
            raise ValueError("a gzip member ends early")
        self.out += self.unpacker.decompress(part)
        self.at += len(part) - len(self.unpacker.unused_data)
        if self.unpacker.eof:
            self.unpacker = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark))
            if not self._more():
                if self.out.strip():
                    raise ValueError("a record's header ends early")
                return None
        return self._cut(found + len(mark))

    def _cut(self, n: int) -> bytes:
        whole = bytes(self.out[:n])
        del self.out[:n]
        return whole

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("a record's block ends early")
        return self._cut(n)

    def skip(self, n: int) -> None:
        """Passes n bytes without decoding them where that is possible."""
        if self.zipped and not self.out and self.unpacker is None:
            head = self._raw(20)
            if len(head) == 20 and head[3] == 4:
                mark, _, size = _EXTRA.unpack(head[12:20])
                if mark == b"QL":
                    # the member's size before packing must be what is to be passed
                    self._forward(size - 4)
                    if self._raw(4) == struct.pack("<I", n & 0xFFFFFFFF):
                        self.at += 4
                        return
                    raise ValueError("a record's block has another length than its header says")
        elif not self.zipped and len(self.out) < n:
            self._forward(n - len(self.out))
            self.out.clear()
            return
        while n > len(self.out):
            n -= len(self.out)
            self.out.clear()
            if not self._more():
                raise ValueError("a record's block ends early")
        del self.out[:n]

    def _forward(self, n: int) -> None:
        have = len(self.held) - self.at
        if n <= have:
            self.at += n
        else:
            self.stream.seek(self.stream.tell() + n - have)
            self.held, self.at = b"", 0


def records(stream, wanted: list[tuple[str, frozenset]] = (), payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:  # noqa: ANN001
    """(header fields, payload) of the records whose fields are in the wanted sets."""
    data = _Input(stream)
    while True:
        head = data.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length", 0))
        if not payload or not all(fields.get(COLUMNS[c].lower()) in values for c, values in wanted):
            data.skip(length + 4)
            if payload or not all(fields.get(COLUMNS[c].lower()) in values for c, values in wanted):
                continue
            yield fields, None
            continue
        block = data.take(length)
        data.skip(4) if not data.zipped else data.take(4)
        if fields.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield fields, None if fields.get("warc-type") == "revisit" else block


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("maxpartitionbytes", 64 << 20))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in COLUMNS:
                self.wanted.append((column, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        system, root = _place(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        known = {i.base_name: i for i in infos if i.is_file}
        if _MANIFEST in known:
            with system.open_input_stream(known[_MANIFEST].path) as f:
                names = json.loads(f.read())
        else:
            names = sorted(n for n in known if n.endswith((".warc", ".warc.gz")))
        planned, size = [_Files([])], 0
        for n in names:
            if planned[-1].paths and size + known[n].size > self.most:
                planned.append(_Files([]))
                size = 0
            planned[-1].paths.append(known[n].path)
            size += known[n].size
        return planned

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        kinds = [pa.string()] * len(COLUMNS) + [pa.map_(pa.string(), pa.string()), pa.binary()]
        schema = pa.schema([*zip([*COLUMNS, "headers", "payload"], kinds, strict=True)])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for fields, payload in records(stream, self.wanted, self.payload):
                    rows.append((*(fields.get(h.lower()) for h in COLUMNS.values()), list(fields.items()), payload))
                    size += len(payload or b"") + 500
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class _Wrote(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"], options.get("date", _DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    payload = row["payload"] or b""
                    revisit = row["type"] == "revisit"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
                    fields = {COLUMNS[c]: row[c] for c in ("type", "record_id", "target_uri")} | {"WARC-Date": self.date}
                    if row["payload_digest"]:
                        fields["WARC-Payload-Digest"] = f"sha1:{row['payload_digest']}"
                    fields |= {"X-Payload-Length": row["payload_length"], "WARC-Refers-To": row["refers_to"], "Content-Type": "application/http; msgtype=response"}
                    if revisit:
                        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    for part in record(fields, http if revisit else http + payload):
                        out.write(member(part))
        return _Wrote(name)

    def commit(self, messages: list[_Wrote | None]) -> None:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{_MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m)).encode())

    def abort(self, messages: list[_Wrote | None]) -> None:
        """Files without a manifest that names them do not count."""


class WarcSource(DataSource):
    """``format("warc")``: options path, payload (false: headers only), maxPartitionBytes; for writing, path and date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: each 5 hexadecimal digits are 4 letters."""
    digits, letters = F.sha1(data), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records for pages: of equal payloads of at least ``least`` bytes the one with the largest page_id is a response
    and the others revisit it.

    Who revisits whom is settled on (page_id, digest) alone; payloads are then dealt out by page, evenly, even if a third
    of all pages are equal."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload"))
    keys = pages.where(F.col("size") >= least).select("page_id", "digest").distinct()
    first = keys.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    revisits = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("response_id"))).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "response_id")
    found = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("response_id").isNotNull()
    return found.select(
        F.when(again, "revisit").otherwise("response").alias("type"),
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.when(again, name(F.col("response_id"))).alias("refers_to"),
        F.col("size").cast("string").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads; of revisits, which have none, and so of nothing else, the headers alone are
    read. Both predicates go down to the reader."""
    path = fresh(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    responses = read_archives(spark, path).where("type = 'response'").select("record_id", "type", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    heads = read_archives(spark, path, payload="false").where("type = 'revisit'")
    number = F.regexp_extract("refers_to", r"page:(-?\d+)>", 1).cast("long")
    revisits = heads.select("record_id", "type", F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), number.alias("refers_to"))
    page_id = F.expr("try_cast(nullif(regexp_extract(record_id, 'page:(-?[0-9]+)>', 1), '') AS long)")
    return responses.unionByName(revisits).select(page_id.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
