"""A splittable reader of FASTA files: byte ranges are read apart, and what a range doesn't know is carried to it from those before."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of what is held of it at once.
RANGE, BLOCK = 1 << 26, 1 << 20
_BLANK = b" \t\r\n\v\f"
_SCHEMA = "file string, part long, record long, header string, at long, bases long, seq string"
_ARROW = pa.schema([("file", pa.string()), ("part", pa.int64()), ("record", pa.int64()), ("header", pa.string()), ("at", pa.int64()), ("bases", pa.int64()), ("seq", pa.string())])


@dataclass
class _Range(InputPartition):
    path: str
    part: int
    start: int
    end: int | None  # None: packed, to be read in order to its end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files but for hidden ones."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    own = system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = [f for f in own if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].strip("/").split("/"))]
    return sorted((path.rstrip("/") + f.path[len(inner.rstrip("/")) :], f.size) for f in shown)


def _blocks(r: _Range) -> Iterator[bytes]:
    """The range's bytes from its first to the file's end, block by block; the caller stops."""
    system, inner = _opened(r.path)
    if r.end is None:
        with system.open_input_stream(inner) as f:
            while block := f.read(BLOCK):
                yield block
        return
    with system.open_input_file(inner) as f:
        f.seek(r.start)
        while block := f.read(BLOCK):
            yield block


def _inside_header(r: _Range) -> bool:
    """Whether the range starts inside a header line; the line's start is sought backwards."""
    if not r.start:
        return False
    system, inner = _opened(r.path)
    with system.open_input_file(inner) as f:
        at = r.start
        while at:
            size = min(BLOCK, at)
            f.seek(at - size)
            block = f.read(size)
            line = block.rfind(b"\n")
            if line >= 0 or at == size:
                f.seek(at - size + line + 1)
                return at - size + line + 1 < r.start and f.read(1) == b">"
            at -= size
    return False


def _at_line_start(r: _Range) -> bool:
    if not r.start:
        return True
    system, inner = _opened(r.path)
    with system.open_input_file(inner) as f:
        f.seek(r.start - 1)
        return f.read(1) == b"\n"


def pieces(r: _Range) -> Iterator[tuple[int, str | None, bytes, bool]]:
    """(record, header, bases, new) of a range: record 0 is what the range starts in; a header is told once, with ``new``.

    A byte belongs to the range that holds it, a header to that of its ``>``, which reads it to its end.
    """
    record, at = 0, r.start
    end = r.end if r.end is not None else 1 << 62
    in_header, line_start, header = _inside_header(r), _at_line_start(r), b""
    skipping = in_header  # a header that another range tells
    for block in _blocks(r):
        place = 0
        while place < len(block):
            if in_header:
                stop = block.find(b"\n", place)
                if not skipping:
                    header += block[place : stop if stop >= 0 else len(block)]
                place = stop + 1 if stop >= 0 else len(block)
                if stop >= 0:
                    if not skipping:
                        yield record, header.decode("utf-8", "replace").rstrip("\r"), b"", True
                    in_header, skipping, line_start, header = False, False, True, b""
                continue
            if at + place >= end:
                return
            if line_start and block[place : place + 1] == b">":
                record, in_header, place = record + 1, True, place + 1
                continue
            mark = block.find(b"\n>", place)
            stop = min(len(block) if mark < 0 else mark + 1, end - at)
            yield record, None, block[place:stop].translate(None, _BLANK), False
            line_start = block[stop - 1 : stop] == b"\n"
            place = stop
        at += len(block)
        if at >= end and not in_header:
            return
    if in_header and not skipping:
        yield record, header.decode("utf-8", "replace").rstrip("\r"), b"", True


class _Reader(DataSourceReader):
    def __init__(self, path: str, chunk: int, lengths: bool, size: int):
        self.path, self.chunk, self.lengths, self.size = path, chunk, lengths, size

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in files_of(self.path):
            packed = path.rsplit(".", 1)[-1] in ("gz", "bz2", "zst", "lz4")
            out += [_Range(path, 0, 0, None)] if packed else [_Range(path, k, a, min(a + self.size, size)) for k, a in enumerate(range(0, max(size, 1), self.size))]
        return out

    def read(self, r: _Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        record, header, at, parts, size = 0, None, 0, [], 0

        def told(last: bool) -> None:
            nonlocal at, parts, size
            text = b"".join(parts)
            if self.lengths:
                if last:
                    rows.append((r.path, r.part, record, header, 0, at + len(text), None))
                at, parts, size = at + len(text), [], 0
                return
            keep = 0 if last else len(text) % self.chunk
            whole = text[: len(text) - keep]
            for k in range(0, len(whole), self.chunk):
                own = whole[k : k + self.chunk]
                rows.append((r.path, r.part, record, header, at + k, len(own), own.upper().decode("ascii", "replace")))
            if last and record and not at and not whole:
                rows.append((r.path, r.part, record, header, 0, 0, ""))
            at, parts, size = at + len(whole), [text[len(whole) :]] if keep else [], keep

        for now, name, bases, new in pieces(r):
            if new:
                told(True)
                record, header, at = now, name, 0
            elif bases:
                parts.append(bases)
                size += len(bases)
                if size >= max(self.chunk, BLOCK):
                    told(False)
            if len(rows) >= 256:
                yield self._batch(rows)
                rows = []
        told(True)
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class FastaDataSource(DataSource):
    """Stretches of records; options: path, chunk (bases of a stretch), lengths (one row a record of a range, without bases), range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "helix_fasta"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        o = self.options
        return _Reader(o["path"], int(o.get("chunk", 16384)), o.get("lengths", "false") == "true", int(o.get("range", RANGE)))


def read_fasta(spark: SparkSession, path: str, chunk: int = 16384, range_bytes: int = RANGE) -> DataFrame:
    """(contig, chunk, seq): upper-case sequences in pieces of ``chunk`` bases; a contig without bases is one empty chunk.

    A record starts at a line's ``>`` and is named by its header's first word; any other ``>`` is text. Files are read in
    ranges of bytes. A range that starts inside a record gets its name and place from the ranges before it: lengths are
    read first, one row a record, and carried along each file, range by range. No row holds more than ``chunk`` bases,
    however long lines and records are. Bases before a file's first header are left out; records of one name stay apart.
    Packed files (gz, bz2, zst, lz4) are one range each.
    """
    spark.dataSource.register(FastaDataSource)
    read = lambda lengths: spark.read.format("helix_fasta").options(chunk=chunk, range=range_bytes, lengths=lengths).load(path)
    told = read("true")
    last = F.max_by(F.struct("record", "header", "bases"), "record")
    parts = told.groupBy("file", "part").agg(last.alias("z")).select("file", "part", "z.*").withColumn("opens", F.col("record") > 0)
    along = Window.partitionBy("file").orderBy("part")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("file", "opened").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = parts.withColumn("opened", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("sum", F.sum("bases").over(within))
    name = F.last(F.when(F.col("opens"), F.struct("header", "part", "record")), ignorenulls=True).over(so_far)
    carry = own.withColumn("open", name).select("file", "part", F.lag("open").over(along).alias("open"), F.lag("sum").over(along).alias("before"))
    got = read("false").join(carry, ["file", "part"], "left")
    first = F.col("record") == 0
    header = F.when(first, F.col("open.header")).otherwise(F.col("header"))
    rows = got.select(
        F.regexp_extract(header, r"^\s*(\S*)", 1).alias("contig"), "file", F.when(first, F.col("open.part")).otherwise(F.col("part")).alias("part"), F.when(first, F.col("open.record")).otherwise(F.col("record")).alias("record"),
        (F.col("at") + F.when(first, F.coalesce("before", F.lit(0))).otherwise(0)).alias("at"), "seq",
    ).filter("contig is not null")
    spread = F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.greatest(F.length("seq"), F.lit(1)) - 1) / chunk))
    cut = rows.withColumn("chunk", F.explode(spread)).withColumn("lo", F.greatest(F.col("chunk") * chunk - F.col("at"), F.lit(0)))
    part = F.substr("seq", (F.col("lo") + 1).cast("int"), (F.least((F.col("chunk") + 1) * chunk - F.col("at"), F.length("seq").cast("long")) - F.col("lo")).cast("int"))
    held = cut.groupBy("contig", "file", "part", "record", "chunk").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("lo")).alias("at"), part.alias("seq")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    return held.select("contig", F.col("chunk").cast("int").alias("chunk"), joined.alias("seq"))
