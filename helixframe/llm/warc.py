"""WARC archives as a Spark data source, and writing of archives that store a repeated payload once."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import cut, held, spread_join

#: Header behind each column that a predicate can be pushed to.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload_length long, payload binary"
_ARROW = pa.schema([(c, {"payload_length": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c in (*HEADERS, "payload_length", "payload")])
FILE_BYTES, BATCH_BYTES, PARTITION_BYTES = 32 << 20, 4 << 20, 64 << 20
MANIFEST, INDEX = "_committed", ".index"
#: The record types of the format, by whose numbers an archive's index tells them: fixed values.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Up to so many repeated payloads (some 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    """The file system and path of a URI. A path without a scheme means different places to Spark and to its workers, so it is refused."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path!r} names no file system; warc.qualified(spark, path) adds the session's own")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def qualified(spark, path: str) -> str:
    """``path`` with the scheme of the session's file system, where it names none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def remove(path: str) -> None:
    """Deletes a folder of archives."""
    fs, root = _filesystem(path)
    fs.delete_dir(root)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


@dataclass
class _Files(InputPartition):
    files: list[str]


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A response holds an HTTP head and the payload, a revisit the HTTP head alone."""
    payload, kind = row.get("payload") or b"", row.get("warc_type") or "resource"
    head = b""
    if kind in ("response", "revisit"):
        n = row["payload_length"] if row.get("payload_length") is not None else len(payload)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (b"" if kind == "revisit" else payload)
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", *(f"{h}: {clean(row[c])}" for c, h in HEADERS.items() if row.get(c) is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; only those that the commit lists count, so a lost or repeated task leaves nothing behind that is read."""

    def __init__(self, path: str, compress: bool):
        self.path, self.compress = path, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Archives of about FILE_BYTES, each with an index beside it: (offset, stored bytes, number of the type) of its records."""
        held("warc", None, dict)
        fs, root = _filesystem(self.path)
        files, out, at, index = [], None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                with fs.open_output_stream(posixpath.join(root, files[-1] + INDEX), compression=None) as f:
                    f.write(np.array(index, "<i8").tobytes())

        for batch in iterator:
            names = batch.schema.names
            for values in zip(*(batch.column(i) for i in range(len(names))), strict=True):
                row = {n: v.as_py() for n, v in zip(names, values, strict=True)}
                data = record_bytes(row)
                if self.compress:
                    data = gzip.compress(data, 6)
                if out is None or at > FILE_BYTES:
                    close()
                    files.append(f"{uuid.uuid4().hex}.warc{'.gz' * self.compress}")
                    out, at, index = fs.open_output_stream(posixpath.join(root, files[-1]), compression=None), 0, []
                kind = row.get("warc_type") or "resource"
                index.append((at, len(data), TYPES.index(kind) if kind in TYPES else -1))
                out.write(data)
                at += len(data)
        close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.path)
        with fs.open_output_stream(posixpath.join(root, f"{MANIFEST}-{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.path)
        for name in (y for m in messages if m for x in m.files for y in (x, x + INDEX)):
            fs.delete_file(posixpath.join(root, name))


class _Member(io.RawIOBase):
    """The bytes of one record, read from its archive as they are asked for."""

    def __init__(self, f, offset: int, size: int):
        self.f, self.at, self.end = f, offset, offset + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        self.f.seek(self.at)
        data = self.f.read(min(len(buffer), self.end - self.at))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def read_indexed(f, index: np.ndarray, packed: bool, wanted: dict[str, set[str]], payload: bool, verify: bool) -> Iterator[dict]:
    """The wanted records of an archive with an index. Of records of other types nothing is read, and of those whose headers or payload aren't wanted, only the beginning is unpacked."""
    kinds = wanted.get("warc_type")
    for offset, size, kind in index.tolist():
        if kinds is None or kind < 0 or TYPES[kind] in kinds:
            member = io.BufferedReader(_Member(f, offset, size), 1 << 12)
            yield from read_records(gzip.GzipFile(fileobj=member) if packed else member, wanted, payload, verify, single=True)


def read_records(f, wanted: dict[str, set[str]], payload: bool, verify: bool, single: bool = False) -> Iterator[dict]:
    """The records of one open file whose headers have the wanted values, or the first alone; the bytes of others are skipped.

    In a packed file that has no index, what is skipped has to be unpacked to find where the next record begins.
    """

    def skip(n: int) -> None:
        if not single:
            f.seek(n, io.SEEK_CUR)

    while True:
        line = f.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        if any(row[c] not in values for c, values in wanted.items()):
            skip(length)
            if single:
                return
            continue
        head, size = 0, length
        if row["warc_type"] in ("response", "revisit"):
            while head < length and (line := f.readline()):
                head += len(line)
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
                if line in (b"\r\n", b"\n"):
                    break
        row["payload_length"], row["payload"], rest = size, None, length - head
        if row["warc_type"] != "revisit" and (payload or verify):
            data = f.read(rest)
            if len(data) < rest:
                raise ValueError(f"record {row['record_id']} is cut off")
            if verify and row["payload_digest"] not in (None, payload_digest(data)):
                raise ValueError(f"record {row['record_id']}: its payload doesn't have its digest")
            row["payload"] = data if payload else None
        else:
            skip(rest)
        yield row
        if single:
            return


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.wanted = path, payload, verify, {}

    def pushFilters(self, filters: list) -> Iterable:
        """Equality and IN on header columns are settled while headers are parsed."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column in HEADERS and values is not None:
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (isinstance(f, IsNotNull) and column in self.wanted):
                yield f

    def partitions(self) -> list[_Files]:
        """Committed files, or all archives where nothing was committed, in groups of about PARTITION_BYTES."""
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        manifests = [x for x in info if x.base_name.startswith(MANIFEST)]
        named = {posixpath.join(posixpath.dirname(m.path), n) for m in manifests for n in json.loads(fs.open_input_file(m.path).read())}
        groups: list[list[str]] = []
        room = 0
        for x in sorted(info, key=lambda x: x.path):
            if x.type != pafs.FileType.File or not x.base_name.endswith((".warc", ".warc.gz")) or (manifests and x.path not in named):
                continue
            if not groups or room < x.size:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(x.path)
            room -= x.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        held("warc", None, dict)
        fs, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                if fs.get_file_info(path + INDEX).type == pafs.FileType.File:
                    with fs.open_input_file(path + INDEX) as f:
                        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                    found = read_indexed(raw, index, packed, self.wanted, self.payload, self.verify)
                else:
                    found = read_records(gzip.open(raw) if packed else io.BufferedReader(raw, 1 << 20), self.wanted, self.payload, self.verify)
                for row in found:
                    rows.append(row)
                    size += 400 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``: options path, payload (false: payloads are skipped) and verify (true: digests are checked)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._flag("payload", "true"), self._flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        fs, root = _filesystem(self.options["path"])
        if overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir_contents(root)
        fs.create_dir(root, recursive=True)
        return WarcWriter(self.options["path"], self._flag("compress", "false"))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = b.column(2)
        digests = pa.array([payload_digest(x.as_buffer()) for x in payloads], pa.string())
        yield pa.record_batch([b.column(0), b.column(1), payloads, digests], names=["page_id", "url", "payload", "digest"])


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """WARC rows for pages: of equal payloads of at least ``min_bytes`` the smallest id is a response, the others revisit it.

    A null html is an empty payload, and a very long one is one record; a null url leaves out its header. Ids that repeat
    with an equal payload are responses each if theirs is the smallest; null ids never win against others. An empty table
    gives no rows; other columns, whatever their names, are ignored. Payloads are counted by digest before any shuffle. Up
    to ``broadcast_digests`` repeated ones are broadcast and the payloads stay where they are read; more are joined by a
    shuffle that deals those of a frequent digest over several tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.mapInArrow(_digests, "page_id long, url string, payload binary, digest string")
    repeated = cut(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if repeated.count() <= broadcast_digests:
        known = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        known = spread_join(rows, repeated, ["digest"], "n", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.length("payload") >= min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return known.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2026-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_number(c: Column) -> Column:
    """The page id in a record id, null where it has none."""
    return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
