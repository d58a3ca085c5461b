"""What the operators share: column selection and cutting of lineage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, shared_folder

#: Up to so many keys (some tens of bytes each) are broadcast.
BROADCAST_ROWS = 500_000
#: A key of more than this share of the rows is dealt over so many tasks in a join; its inverse bounds how many there are.
SUPPORT, SALTS = 1e-3, 64


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared checkpoint folder: its lineage ends there and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for tables that are read more than once and by columns."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(columns: list[str]) -> Column:
    """A 64-bit hash of a row's columns, nulls told from empty texts."""
    return F.xxhash64(*(x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def without(docs: DataFrame, gone: DataFrame, key: list[Column], names: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``gone`` (columns ``names``, distinct); nulls equal each other.

    Up to ``most`` keys are broadcast, so that the texts stay where they are read; beyond that both sides are shuffled.
    """
    gone = cut(gone.select(*(F.col(n).alias(f"_gone_{n}") for n in names)))
    side = F.broadcast(gone) if gone.count() <= most else gone
    same = [k.eqNullSafe(F.col(f"_gone_{n}")) for k, n in zip(key, names, strict=True)]
    return docs.join(side, same, "left_anti")


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], places: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``found``, which has one row a key and in ``places`` how many rows have it; read ``found`` from files.

    Keys of more than SUPPORT of the rows are salted: those rows are dealt over SALTS tasks, and their one row of ``found``
    goes to each.
    """
    total = found.agg(F.sum(places)).first()[0] or 0
    often = F.col(places) > F.lit(total * SUPPORT)
    names = found.filter(often).select(*keys, F.lit(True).alias("_often"))
    dealt = rows.join(F.broadcast(names), keys, "left").withColumn("_salt", F.when(F.col("_often"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_often")
    copies = F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(found.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def release() -> None:
    """Gives memory that was freed, which Arrow and the C library keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if trim:
        trim(0)


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``task``, a function of batches, whose Python worker gives freed memory back when a task is over: it lives on beside the JVM."""

    @functools.wraps(task)
    def run(*args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(*args, **named)
        finally:
            release()

    return run


_held: dict = {}


def held(owner: str, key, make):
    """What a Python worker keeps for later tasks of one operator: ``make()``, once a key. Another operator's goes."""
    if _held.get("owner") != owner:
        _held.clear()
        release()
        _held.update(owner=owner, made={})
    made = _held["made"]
    if key not in made:
        made[key] = make()
    return made[key]


def mixed(values: np.ndarray) -> np.ndarray:
    """Longs scattered over all longs, one to one."""
    v = values.astype(np.int64).view(np.uint64)
    for step, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ v >> np.uint64(step)) * np.uint64(factor)
    return (v ^ v >> np.uint64(31)).view(np.int64)


class Crowds:
    """Tells a task which keys it has sent often enough, from counters that keys share by hash: a key may count as one early, never late."""

    def __init__(self, most: int, bits: int = 20):
        self.most, self.counts, self.told = most, np.zeros(1 << bits, np.int32), set()

    def beyond(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks the rows whose key has had its share, and gives the keys of which that is told for the first time."""
        place = mixed(key) & len(self.counts) - 1
        np.add.at(self.counts, place, 1)
        many = self.counts[place] > self.most
        new = sorted(set(np.unique(key[many]).tolist()) - self.told)
        self.told.update(new)
        return many, np.array(new, np.int64)
