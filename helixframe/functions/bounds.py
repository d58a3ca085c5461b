"""Columns of half-open bounds (start0, end1), region strings and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift of the storage bins that interval joins use.
BIN_SHIFT = 14
#: Shifts of the nested bins, finest first: fixed values of the alignment index format.
LEVEL_SHIFTS = (14, 17, 20, 23, 26)


def length(start: Column, end: Column) -> Column:
    return end - start


def is_valid(start: Column, end: Column) -> Column:
    return (start >= 0) & (start < end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict half-open overlap; bounds that touch or are empty don't overlap."""
    return (s1 < e2) & (s2 < e1) & (s1 < e1) & (s2 < e2)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0).cast("long"))


def overlap_bound(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common part as a struct, null where there is none."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start0"), F.least(e1, e2).alias("end1")))


def expand_bound(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.struct(F.least(s1, s2).alias("start0"), F.greatest(e1, e2).alias("end1"))


def contained_in(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 >= s2) & (e1 <= e2)


def is_left_of(e1: Column, s2: Column) -> Column:
    return e1 <= s2


def convert(start: Column, end: Column, frm: str, to: str) -> tuple[Column, Column]:
    """Bounds between conventions; the digits say whether starts are 0- or 1-based and ends inclusive 0-based (0) or exclusive = inclusive 1-based (1)."""
    return start + (int(to[0]) - int(frm[0])), end + (int(to[1]) - int(frm[1]))


def parse_region(region: Column) -> Column:
    """struct<chrom, start0, end1> of ``chr``, ``chr:b`` or ``chr:b-e``; commas don't count, bounds are 1-based, an open end is null."""
    clean = F.replace(region, F.lit(","), F.lit(""))
    part = lambda i: F.regexp_extract(clean, r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", i)
    begin = F.coalesce(part(2).try_cast("bigint"), F.lit(1))
    return F.struct(part(1).alias("chrom"), F.greatest(begin - 1, F.lit(0)).cast("long").alias("start0"), part(3).try_cast("bigint").alias("end1"))


def _level_offset(shift: int) -> int:
    return ((1 << (29 - shift)) - 1) // 7


def bin_of(start: Column, end: Column) -> Column:
    """The smallest nested bin that holds the bound."""
    last, c = end - 1, None
    for s in LEVEL_SHIFTS:
        same = F.shiftright(start, s) == F.shiftright(last, s)
        value = F.shiftright(start, s) + _level_offset(s)
        c = F.when(same, value) if c is None else c.when(same, value)
    return c.otherwise(0)


def candidate_bins(start: Column, end: Column) -> Column:
    """All nested bins that can hold something that overlaps the bound."""
    levels = [F.sequence(F.shiftright(start, s) + _level_offset(s), F.shiftright(end - 1, s) + _level_offset(s)) for s in reversed(LEVEL_SHIFTS)]
    return F.concat(F.array(F.lit(0).cast("long")), *(x.cast("array<bigint>") for x in levels))
