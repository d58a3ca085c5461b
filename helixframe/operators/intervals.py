"""Interval joins and interval sets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds as B
from .scans import next_position, running_max_before, running_sum

KEYS = ["chrom"]


def overlap_join(left: DataFrame, right: DataFrame, left_bounds=("start0", "end1"), right_bounds=("r_start0", "r_end1"), keys=None, shift: int = B.BIN_SHIFT) -> DataFrame:
    """Pairs of bounds that overlap strictly. Both sides have ``keys``; other column names differ.

    Each bound goes to the bins that it touches, and a pair is kept in the later of the two first bins alone, so no
    distinct is needed. Empty bounds join nothing.
    """
    keys = keys or KEYS
    (ls, le), (rs, re_) = left_bounds, right_bounds
    bins = lambda s, e: F.explode(F.sequence(F.shiftright(F.col(s).cast("long"), shift), F.shiftright(F.col(e).cast("long") - 1, shift)))
    a = left.filter(F.col(ls) < F.col(le)).withColumn("_bin", bins(ls, le))
    b = right.filter(F.col(rs) < F.col(re_)).withColumn("_bin", bins(rs, re_))
    both = a.join(b, [*keys, "_bin"]).filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)))
    first = F.greatest(F.shiftright(F.col(ls).cast("long"), shift), F.shiftright(F.col(rs).cast("long"), shift))
    return both.filter(F.col("_bin") == first).drop("_bin")


def point_join(points: DataFrame, intervals: DataFrame, pos: str = "pos0", bounds=("start0", "end1"), keys=None, how: str = "inner", shift: int = B.BIN_SHIFT) -> DataFrame:
    """Points with the intervals that hold them; ``how='left'`` keeps points outside all."""
    keys = keys or KEYS
    s, e = bounds
    a = points.withColumn("_bin", F.shiftright(F.col(pos).cast("long"), shift))
    b = intervals.filter(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(F.shiftright(F.col(s).cast("long"), shift), F.shiftright(F.col(e).cast("long") - 1, shift))))
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_bin"]})
    on = [F.col(k) == F.col(f"_r_{k}") for k in [*keys, "_bin"]] + [F.col(pos) >= F.col(s), F.col(pos) < F.col(e)]
    return a.join(right, on, how).drop("_bin", *(f"_r_{k}" for k in [*keys, "_bin"]))


def number_islands(df: DataFrame, keys: list[str], start: str = "start0", end: str = "end1", max_gap: int = 0, touching: bool = True, out: str = "island") -> DataFrame:
    """Rows with the number of their island: rows whose start is at most ``max_gap`` past the greatest end so far.

    Without ``touching`` the start has to lie before that end.
    """
    seen = running_max_before(df, keys, [start, end], end, "_seen")
    apart = F.col(start) > F.col("_seen") + max_gap if touching else F.col(start) >= F.col("_seen") + max_gap
    flagged = seen.withColumn("_new", F.when(F.col("_seen").isNull() | apart, 1).otherwise(0))
    return running_sum(flagged, keys, [start, end], "_new", out).drop("_seen", "_new")


def islands(df: DataFrame, keys: list[str], start: str = "start0", end: str = "end1", max_gap: int = 0, touching: bool = True) -> DataFrame:
    """One row per island: keys, start, end and n, the number of rows in it."""
    numbered = number_islands(df, keys, start, end, max_gap, touching)
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def merge_bounds(df: DataFrame, keys=None) -> DataFrame:
    """A set of disjoint bounds: those that overlap are merged, those that touch are not."""
    return islands(df.filter("start0 < end1"), keys or KEYS, touching=False).drop("n")


def position_runs(df: DataFrame, keys=None, pos: str = "pos1") -> DataFrame:
    """Runs (start1, end1) of positions that follow each other without a gap."""
    rows = df.select(*(keys or KEYS), F.col(pos).alias("start1"), F.col(pos).alias("end1")).distinct()
    return islands(rows, keys or KEYS, "start1", "end1", max_gap=1).drop("n")


def segments(points: DataFrame, keys=None, pos: str = "p") -> DataFrame:
    """Consecutive distinct points as bounds (start0, end1)."""
    keys = keys or KEYS
    lined = next_position(points.select(*keys, F.col(pos).alias("start0")).distinct(), keys, "start0", "end1")
    return lined.filter("end1 is not null").select(*keys, "start0", "end1")


def set_overlap_length(a: DataFrame, b: DataFrame, keys=None) -> DataFrame:
    """``a`` with ``overlap``, the summed overlap with the bounds of ``b``."""
    keys = keys or KEYS
    own = ["start0", "end1"]
    found = overlap_join(a.select(*keys, *own).distinct(), b.select(*keys, F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1")), keys=keys)
    cut = F.least("end1", "r_end1") - F.greatest("start0", "r_start0")
    return a.join(found.groupBy(*keys, *own).agg(F.sum(cut).alias("overlap")), [*keys, *own], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def intersect(a: DataFrame, b: DataFrame, keys=None) -> DataFrame:
    """The common parts of bounds of ``a`` and ``b``, every one of them."""
    keys = keys or KEYS
    found = overlap_join(a.select(*keys, "start0", "end1"), b.select(*keys, F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1")), keys=keys)
    return found.select(*keys, F.greatest("start0", "r_start0").alias("start0"), F.least("end1", "r_end1").alias("end1")).distinct()


def subtract(a: DataFrame, b: DataFrame, keys=None) -> DataFrame:
    """Parts of the bounds of ``a`` that no bound of ``b`` covers, whole stretches each.

    What ``b`` covers of each bound is merged inside that bound, and the gaps are left.
    """
    keys = keys or KEYS
    own = a.select(*keys, "start0", "end1").distinct().filter("start0 < end1")
    found = overlap_join(own, b.select(*keys, F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1")), keys=keys)
    cuts = found.groupBy(*keys, "start0", "end1").agg(F.array_sort(F.collect_set(F.struct(F.greatest("start0", "r_start0").alias("s"), F.least("end1", "r_end1").alias("e")))).alias("cuts"))
    gap = "array<struct<s:bigint,e:bigint>>"
    state = F.struct(F.col("start0").cast("long").alias("at"), F.array().cast(gap).alias("gaps"))
    step = lambda acc, c: F.struct(F.greatest(acc["at"], c["e"]).cast("long").alias("at"), F.when(c["s"] > acc["at"], F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("s"), c["s"].cast("long").alias("e"))))).otherwise(acc["gaps"]).alias("gaps"))
    done = lambda acc: F.when(acc["at"] < F.col("end1"), F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("s"), F.col("end1").cast("long").alias("e"))))).otherwise(acc["gaps"])
    held = own.join(cuts, [*keys, "start0", "end1"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    parts = held.select(*keys, F.explode(F.aggregate("cuts", state, step, done)).alias("g"))
    return parts.select(*keys, F.col("g.s").alias("start0"), F.col("g.e").alias("end1")).distinct()


def _collapse(elements: list[tuple], seed: tuple[float, float], tiers: list[tuple[int, float, float]], passes: int) -> list[list]:
    """Greedy islands (start, end, score) of one cluster: elements go left to right, and those left over try again in the next pass."""
    islands: list[list] = []  # in order
    waiting = elements
    for _ in range(passes):
        rest = []
        for s, e, score in waiting:
            dense = score / max(e - s, 1)
            reach = max((d for d, least, thick in tiers if score >= least and dense >= thick), default=-1)
            at = bisect_right(islands, s, key=lambda x: x[0])
            near = [i for i in (at - 1, at) if 0 <= i < len(islands) and max(s - islands[i][1], islands[i][0] - e) <= reach]
            if near:
                own = islands[near[0]]
                parts = [(s, e, score), *(islands[i] for i in near[1:])]
                own[0], own[1], own[2] = min(own[0], *(p[0] for p in parts)), max(own[1], *(p[1] for p in parts)), own[2] + sum(p[2] for p in parts)
                for i in near[1:]:
                    del islands[i]
            elif score >= seed[0] and dense >= seed[1]:
                islands.insert(at, [s, e, score])
            else:
                rest.append((s, e, score))
        if len(rest) == len(waiting):
            break
        waiting = rest
    return islands


def _clusters(batches: Iterator[pa.RecordBatch], seed: tuple[float, float], tiers: list[tuple[int, float, float]], passes: int) -> Iterator[pa.RecordBatch]:
    """Islands of rows (chrom, cluster, start0, end1, score) sorted by cluster and place; one cluster is held at a time."""
    known, held = None, []
    names = ["chrom", "start0", "end1", "score"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        c, s, e, x = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.record_batch([pa.array(c, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(x, pa.float64())], names=names)

    for b in batches:
        out: list[tuple] = []
        for chrom, cluster, *element in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (chrom, cluster) != known:
                if held:
                    out += [(known[0], *x) for x in _collapse(held, seed, tiers, passes)]
                known, held = (chrom, cluster), []
            held.append(tuple(element))
        yield made(out)
    if held:
        yield made([(known[0], *x) for x in _collapse(held, seed, tiers, passes)])


def collapse_wig(scored: DataFrame, seed: tuple[float, float], tiers: list[tuple[int, float, float]], min_length: int = 0, passes: int = 2) -> DataFrame:
    """Islands (chrom, start0, end1, score) of scored intervals.

    An element of at least the ``seed`` score and score per base starts an island. One that meets a tier (distance, score,
    score per base) of an island within that distance joins it, and joins two such islands to one. Further passes offer
    elements that were left over again. Islands under ``min_length`` go. Elements farther apart than the widest tier never
    meet, so each chromosome is cut there and a task holds one such cluster at a time.
    """
    wide = max(d for d, _, _ in tiers) if tiers else 0
    known = number_islands(scored.select("chrom", "start0", "end1", "score"), ["chrom"], max_gap=wide, out="cluster")
    sorted_ = known.select("chrom", "cluster", F.col("start0").cast("long").alias("start0"), F.col("end1").cast("long").alias("end1"), F.col("score").cast("double").alias("score")).repartition("chrom", "cluster").sortWithinPartitions("chrom", "cluster", "start0", "end1")
    out = sorted_.mapInArrow(partial(_clusters, seed=seed, tiers=tiers, passes=passes), "chrom string, start0 long, end1 long, score double")
    return out.filter(F.col("end1") - F.col("start0") >= min_length)
