"""WARC archives as a PySpark data source, read and write.

Writing: each task writes one file of gzip members, one record a member, under a name of its own attempt; the commit
writes a manifest of the files of the attempts that succeeded, and an index beside each file gives every member's place,
type and digest. Readers only see files of a manifest, so what a lost or repeated attempt leaves is never read.

Reading: an archive of this writer is read by its manifest and indexes; a predicate on type or page is checked on the index,
so an unwanted member isn't even read. Any other folder or file is read by its .warc and .warc.gz files as they are. Files are
split into partitions of about `split_bytes`: by the index, or where a gzip member starts with a record (each record that
crawlers write is a member); a plain .warc is a partition. Headers are parsed first: predicates on record type, page, record,
URL, date and payload digest are tested on them, and what is unwanted is passed over: by a seek in a plain file, without
being kept, parsed or digested in a compressed one. If no column needs the payload it is passed over too. A folder without
archives is an error.

Paths go through pyarrow's file systems, so a shared mount, HDFS or an object store work alike.

Defined cases: a null payload is empty; a null page_id is written as '-' and counts as the smallest; rows that repeat
page_id and payload all are responses or all revisits of the same page; ties of page_id are broken by nothing else, as such
records are equal; very long payloads are compressed and checked whole; an empty table gives an archive without records;
other columns of the pages aren't written, whatever their names. A record of another writer has the page_id of a record id of
the form <urn:page:N>, else null; payload_bytes and payload_digest are what its headers say, or of its payload if they
don't, null if it has none; its payload is what follows the HTTP headers of a response or request, else its block.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from ripplegraph.llm.util import fresh_path, table

LEVEL = 3
MIN_PAYLOAD = 0
FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, date string"
SPLIT_BYTES, STEP = 128 << 20, 1 << 16
DATE = "1970-01-01T00:00:00Z"  # records carry no time of their own; a fixed one keeps archives reproducible
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, record_type: str, refers_to, payload: bytes) -> bytes:
    ident = lambda x: f"<urn:page:{'-' if x is None else x}>"
    block = _STATUS + payload if record_type == "response" else _STATUS
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {ident(page_id)}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {ident(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url) -> str:
    return "".join(" " if c in "\r\n" else c for c in url or "")


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Message(WriterCommitMessage):
    def __init__(self, name: str | None, records: int):
        self.name, self.records = name, records


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema):
        self.path, self.names = path, schema.names

    def write(self, batches) -> Message:
        system, root = files(self.path)
        system.create_dir(root, recursive=True)
        name, index, at, out = f"part-{uuid.uuid4().hex}.warc.gz", [], 0, None
        need = [self.names.index(x) for x in ("page_id", "url", "record_type", "refers_to", "payload")]
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in need], strict=True):
                out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                payload = row[4] if isinstance(row[4], bytes) else (row[4] or "").encode()
                c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = c.compress(record_bytes(*row[:4], payload)) + c.flush()
                out.write(member)
                index.append(json.dumps([at, len(member), row[0], row[2]]))
                at += len(member)
        if out is None:
            return Message(None, 0)
        out.close()
        with system.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write("\n".join(index).encode())
        return Message(name, len(index))

    def commit(self, messages) -> None:
        system, root = files(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages) -> None:
        system, root = files(self.path)
        for m in messages:
            if m and m.name:
                for x in (m.name, f"{m.name}.idx"):
                    system.delete_file(f"{root}/{x}")


class Part(InputPartition):
    """Members of a file that start in [start, end); indexed: the file has an index of this writer beside it."""

    def __init__(self, path: str, start: int, end: int, indexed: bool):
        super().__init__(f"{path}:{start}")
        self.path, self.start, self.end, self.indexed = path, start, end, indexed


class Bytes:
    """The bytes of an archive from a place on: of a plain file as they are, else of its gzip members, one after the other."""

    def __init__(self, file, start: int, plain: bool):
        self.file, self.plain, self.at = file, plain, start  # at: the file's place of the first byte that isn't decoded
        self.raw, self.held, self.z = b"", b"", None
        self.opened = self.member = start  # where the members of the last decoded byte and of the first held byte start
        file.seek(start)

    def _more(self) -> bool:
        """Holds more bytes; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.file.read(STEP)
            if self.plain:
                self.held, self.raw, more = self.held + self.raw, b"", bool(self.raw)
                return more
            if not self.raw and (self.z is None or self.z.eof):
                return False
            if self.z is None or self.z.eof:
                self.z, self.opened = zlib.decompressobj(31), self.at
            size = len(self.raw)
            out = self.z.decompress(self.raw, STEP)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += size - len(self.raw)
            if out:
                if not self.held:
                    self.member = self.opened
                self.held += out
                return True
            if not size:  # the file ends within a member
                return False

    def head(self) -> bytes | None:
        """The next record's header block, None at the end of the file; `member` then is the member that it starts in."""
        while not self.held:
            if not self._more():
                return None
            self.held = self.held.lstrip(b"\r\n")
        self.held = self.held.lstrip(b"\r\n")
        if not self.held:
            return self.head()
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out

    def take(self, size: int) -> bytes:
        parts = []
        while size > 0 and (self.held or self._more()):
            parts.append(self.held[:size])
            self.held = self.held[size:]
            size -= len(parts[-1])
        return b"".join(parts)

    def skip(self, size: int) -> None:
        if self.plain and size > len(self.held):
            self.file.seek(self.file.tell() + size - len(self.held))
            self.held = b""
            return
        while size > 0 and (self.held or self._more()):
            size, self.held = size - min(size, len(self.held)), self.held[size:]


def first_member(file, start: int, end: int) -> int | None:
    """Where the first gzip member at or after start begins that begins a record; None if that isn't before end."""
    if start == 0:
        return 0
    at, tail = start, b""
    file.seek(start)
    while chunk := file.read(1 << 20):
        data = tail + chunk
        base, k = at - len(tail), -1
        while (k := data.find(b"\x1f\x8b\x08", k + 1)) >= 0:
            if base + k >= end:
                return None
            try:
                file.seek(base + k)
                if zlib.decompressobj(31).decompress(file.read(4096), 5) == b"WARC/":
                    return base + k
            except zlib.error:
                pass
        at += len(chunk)
        tail = data[-2:]
        file.seek(at)
    return None


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), In: lambda a, b: a in b}
_BY_HEADER = ("record_type", "page_id", "record_id", "url", "date", "payload_digest", "refers_to")


def header_fields(head: dict[str, str]) -> dict:
    page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    digest = head.get("warc-payload-digest")
    return {
        "page_id": page(head.get("warc-record-id")),
        "record_id": head.get("warc-record-id"),
        "url": head.get("warc-target-uri"),
        "record_type": head.get("warc-type"),
        "refers_to": page(head.get("warc-refers-to")),
        "date": head.get("warc-date"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
    }


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, split_bytes: int = SPLIT_BYTES):
        self.path, self.names, self.split_bytes = path, schema.names, split_bytes
        self.tests: list[tuple[str, object, object]] = []  # column, filter type, value

    def pushFilters(self, filters):
        """Takes what record headers tell; what it can't, Spark filters."""
        for f in filters:
            column = f.attribute[0] if type(f) in _COMPARE and len(f.attribute) == 1 else None
            # of other writers' records a header may lack the digest, which the payload then gives
            if column in _BY_HEADER and column != "payload_digest":
                self.tests.append((column, type(f), f.value))
            else:
                if column == "payload_digest":
                    self.tests.append((column, type(f), f.value))
                yield f

    def wanted(self, found: dict, known: tuple[str, ...] = _BY_HEADER) -> bool:
        for column, kind, value in self.tests:
            if column in known and not (column == "payload_digest" and found[column] is None):
                if found[column] is None or value is None or not _COMPARE[kind](found[column], value):
                    return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, root = files(self.path)
        whole = system.get_file_info(root)
        infos = {x.path: x for x in (system.get_file_info(fs.FileSelector(root, recursive=True)) if whole.type == fs.FileType.Directory else [whole])}
        manifests = [p for p in infos if p.rsplit("/", 1)[-1].startswith("manifest-") and p.endswith(".json")]
        if manifests:
            chosen = []
            for path in sorted(manifests):
                with system.open_input_stream(path, compression=None) as f:
                    chosen += [f"{path.rsplit('/', 1)[0]}/{x}" for x in json.loads(f.read())]
        else:
            chosen = [p for p in sorted(infos) if p.endswith((".warc", ".warc.gz"))]
            if not chosen:
                raise FileNotFoundError(f"no WARC archive in {self.path}")
        parts = []
        for path in chosen:
            size = infos[path].size
            step = self.split_bytes if path.endswith(".gz") else max(size, 1)
            parts += [Part(path, at, min(at + step, size), bool(manifests) and f"{path}.idx" in infos) for at in range(0, size, step)]
        return parts or [Part("", 0, 0, False)]

    def read(self, part: Part | None):
        if part is None or not part.path:  # planned without files
            return
        system, _ = files(self.path)
        with system.open_input_file(part.path) as f:
            yield from self.indexed(system, f, part) if part.indexed else self.scanned(f, part)

    def indexed(self, system, f, part: Part):
        with system.open_input_stream(f"{part.path}.idx", compression=None) as x:
            index = [json.loads(line) for line in x.read().decode().split("\n") if line]
        for at, size, page, kind in index:
            if part.start <= at < part.end and self.wanted({"page_id": page, "record_type": kind}, ("page_id", "record_type")):
                f.seek(at)
                one = Bytes(io.BytesIO(f.read(size)), 0, False)
                if (row := self.row(one, one.head())) is not None:
                    yield row

    def scanned(self, f, part: Part):
        plain = not part.path.endswith(".gz")
        start = 0 if plain else first_member(f, part.start, part.end)
        if start is None:
            return
        records = Bytes(f, start, plain)
        while (head := records.head()) is not None and (plain or records.member < part.end):
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{part.path}: no record where one should start, before byte {records.at}")
            if (row := self.row(records, head)) is not None:
                yield row

    def row(self, records: Bytes, raw: bytes) -> tuple | None:
        """The record after its header block, passed over as far as it isn't wanted."""
        head = parse_head(raw)
        found = header_fields(head)
        length = int(head.get("content-length") or 0)
        if not self.wanted(found):
            records.skip(length)
            return None
        known = head.get("x-payload-bytes")
        has_payload = found["record_type"] != "revisit"
        need = has_payload and ("payload" in self.names or "payload_bytes" in self.names and known is None or "payload_digest" in self.names and found["payload_digest"] is None)
        payload = None
        if need:
            payload = records.take(length)
            if len(payload) < length:
                raise ValueError(f"record {found['record_id']} ends early")
            if head.get("content-type", "").startswith("application/http"):
                _, _, payload = payload.partition(b"\r\n\r\n")
            if "payload" in self.names and head.get("warc-payload-digest", "").startswith("sha1:") and digest32(payload) != found["payload_digest"]:
                raise ValueError(f"record {found['record_id']} doesn't have the payload of its digest")
        else:
            records.skip(length)
        found["payload"] = payload
        found["payload_bytes"] = len(payload) if payload is not None else int(known) if known is not None else None
        if found["payload_digest"] is None and payload is not None:
            found["payload_digest"] = digest32(payload)
        return tuple(found[x] for x in self.names)


class WarcSource(DataSource):
    """format("warc"): options path, a folder or file, and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The records of pages: of equal payloads the largest page_id is the response. Payloads only move once, by page_id."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    small = p.where(F.octet_length("payload") >= min_payload).select("page_id", "digest")
    most = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    later = small.distinct().join(most, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = later.select(F.col("page_id").alias("p2"), F.col("digest").alias("d2"), "refers_to")
    out = p.join(later, F.col("page_id").eqNullSafe(F.col("p2")) & (F.col("digest") == F.col("d2")), "left")
    return out.select("page_id", "url", F.when(F.col("d2").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to", "payload")


def write_warc(pages: DataFrame, path: str, **how) -> None:
    register(pages.sparkSession)
    planned(pages, **how).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, fields: str = FIELDS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(fields).option("split_bytes", split_bytes).load(path)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
