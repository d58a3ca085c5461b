"""Ordered scans along chromosomes in two levels.

A window over a whole chromosome would be one task. These scans split each chromosome into stretches of positions, scan
inside each stretch, and carry one row a stretch over to the next, so the largest sorted group is one stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 20


def _stretch(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(pos) / size))


def _join(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "_stretch"]
    return df.join(carried.withColumnsRenamed({k: f"_{k}" for k in on}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on]).drop(*(f"_{k}" for k in on))


def next_position(df: DataFrame, keys: list[str], pos: str, out: str, size: int = STRETCH) -> DataFrame:
    """The next greater row's ``pos`` in the group of ``keys``, null at the last; positions are distinct."""
    rows = _stretch(df, pos, size)
    first = rows.groupBy(*keys, "_stretch").agg(F.min(pos).alias("_f"))
    carried = first.withColumn("_n", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_stretch"))).drop("_f")
    inside = F.lead(pos).over(Window.partitionBy(*keys, "_stretch").orderBy(pos))
    return _join(rows, carried, keys).withColumn(out, F.coalesce(inside, "_n")).drop("_stretch", "_n")


def running_max_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, size: int = STRETCH) -> DataFrame:
    """The greatest ``value`` of the rows before, in ``order`` (its first column is the position); null at the first."""
    rows = _stretch(df, order[0], size)
    top = rows.groupBy(*keys, "_stretch").agg(F.max(value).alias("_m"))
    carried = top.withColumn("_c", F.max("_m").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inside = F.max(value).over(Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return _join(rows, carried, keys).withColumn(out, F.greatest(inside, "_c")).drop("_stretch", "_c")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, size: int = STRETCH) -> DataFrame:
    """The sum of ``value`` up to and with each row, in ``order``."""
    rows = _stretch(df, order[0], size)
    total = rows.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_m"))
    carried = total.withColumn("_c", F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    inside = F.sum(value).over(Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _join(rows, carried, keys).withColumn(out, inside + F.col("_c")).drop("_stretch", "_c")
