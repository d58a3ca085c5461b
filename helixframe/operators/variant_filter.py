"""Reasons to drop variants: quality and depth of their own, dense neighbours, and better ones around them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reliable
from .intervals import number_islands, point_join

#: Letters of filter reasons: fixed values (quality, depth, great depth, dense SNPs, near a gap, near a better gap, SNP and indel quality).
REASONS = {"quality": "Q", "shallow": "d", "deep": "D", "dense": "W", "near_gap": "G", "worse_gap": "g", "snp_quality": "s", "indel_quality": "i"}


def deletion_length(cons: Column) -> Column:
    """The length of an indel genotype's longer allele (the second of two as long) if that is a deletion, else 0."""
    one, two = F.split_part(cons, F.lit("/"), F.lit(1)), F.split_part(cons, F.lit("/"), F.lit(2))
    longer = F.when(F.length(one) > F.length(two), one).otherwise(two)
    return F.when(longer.startswith("-"), F.length(longer) - 1).otherwise(0).cast("long")


def _worse_gaps(gaps: DataFrame, reach: int) -> DataFrame:
    """(id) of gaps with a better one around them.

    A gap that an earlier one reaches is the worse one unless its score is greater. If it is, it outdoes those that reach
    it, up to the first that it can't outdo.
    """
    later = gaps.select("chrom", "pos1", "seq", F.col("score").alias("own"), F.col("id").alias("later"))
    earlier = gaps.select("chrom", F.col("pos1").alias("start0"), (F.col("pos1") + F.col("gone") + reach + 1).alias("end1"), F.col("seq").alias("x_seq"), "score", "id")
    met = point_join(later, earlier, "pos1").filter((F.col("start0") < F.col("pos1")) | (F.col("x_seq") < F.col("seq")))
    place = F.struct("start0", "x_seq")
    stop = F.min(F.when(F.col("score") >= F.col("own"), place)).over(Window.partitionBy("later"))
    told = met.withColumn("stop", stop)
    return told.filter("stop is not null").select(F.col("later").alias("id")).unionByName(told.filter(F.col("stop").isNull() | (place < F.col("stop"))).select("id")).distinct()


def _counted(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(id) of dense SNPs among rows (chrom, island, pos1, id, counts) in order; what is held are the counted places of the last ``width`` bases."""
    island, near = None, deque()
    for b in batches:
        out = []
        for chrom, n, pos, row, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if island != (chrom, n):
                island, near = (chrom, n), deque()
            while near and near[0] < pos - width:
                near.popleft()
            if len(near) >= most:
                out.append(row)
                counts = True
            if counts:
                near.append(pos)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])


def _dense(snps: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(id) of SNPs with ``most`` or more counted ones in the ``width`` bases before them, and the pairs (id, later, at) that close.

    Rows (chrom, pos1, seq, id, counts): one that doesn't count of its own does once it is dense itself. SNPs further apart
    than ``width`` don't act on each other, so islands of closer ones are dealt over tasks and streamed in order, each with
    the last ``width`` bases as its only state. However long a chain of SNPs is, it takes no further job.
    """
    rows = number_islands(snps.select("chrom", "pos1", "seq", "id", "counts", F.col("pos1").alias("end1")), ["chrom"], "pos1", "end1", max_gap=width)
    dealt = rows.repartition("chrom", "island").sortWithinPartitions("chrom", "island", "pos1", "seq").select("chrom", "island", "pos1", "id", "counts")
    dense = reliable(dealt.mapInArrow(partial(_counted, width=width, most=most), "id long"))
    later = snps.select("chrom", "pos1", "seq", F.col("id").alias("later"))
    earlier = snps.select("chrom", F.col("pos1").alias("start0"), (F.col("pos1") + width + 1).alias("end1"), F.col("seq").alias("x_seq"), "id")
    met = point_join(later, earlier, "pos1").filter((F.col("start0") < F.col("pos1")) | (F.col("x_seq") < F.col("seq")))
    return dense, met.select("id", "later", F.col("pos1").alias("at"))


def variant_filter(cns: DataFrame, d: int = 3, D: int = 100, l: int = 30, Q: int = 25, q: int = 10, G: int = 25, s: int = 100, w: int = 10, W: int = 10, N: int = 2, S: int = 0, i: int = 0) -> DataFrame:
    """Variant rows of a consensus pileup with ``reason``, empty for those that pass.

    Sites are in order of position, a SNP before the indel at the same one; others that tie are in order of their columns.

    * A row fails by its own quality (s, i, where asked) or depth (d, D). Such rows act on no others.
    * An indel's score is its quality and ``s`` for each read of an allele. It fails (g) where another reaches it within
      ``l`` bases after that one and its deletion, and does at least as well; or where a later one outdoes it.
    * A SNP fails (W) if more than ``N`` of those before it within ``W`` bases, itself included, count, and so do those of
      them that had passed. SNPs of a low mapping quality (under ``Q``) count only where they fail as W or G.
    * A SNP fails (G) within ``w`` bases after an indel with a score of ``G`` or its deletion, or before an indel with a
      quality of ``G``. Where W and G both come from later sites, the first of them tells.
    * What is left fails (Q) by its mapping quality, under ``Q`` or, for indels, ``q``.

    Neighbours meet by joins on bins of positions, and dense SNPs are told by an ordered scan of each chain of close ones, so no
    contig is gathered in one task and the jobs don't depend on the data.
    """
    up = F.upper("ref") != F.upper("cons")
    gap = F.col("ref") == "*"
    poor = F.when(gap & F.lit(i > 0) & (F.col("snp_q") < i), "i").when(~gap & F.lit(S > 0) & (F.col("snp_q") < S), "s").when(F.col("depth") < d, "d").when(F.col("depth") > D, "D")
    reads = F.when(F.col("a1") != "*", F.col("cnt1")).otherwise(0) + F.when(F.col("a2") != "*", F.col("cnt2")).otherwise(0)
    ties = Window.partitionBy("chrom", "pos1", gap).orderBy("cons", "ref", "snp_q", "depth", "rms_mapq", "_id")
    marked = cns.filter(up & (F.col("cons") != "*/*")).withColumns({"_poor": poor, "_low": F.col("rms_mapq") < F.when(gap, q).otherwise(Q), "_id": F.monotonically_increasing_id()})
    sites = reliable(marked.withColumn("_seq", F.row_number().over(ties)))
    able = sites.filter("_poor is null").select("chrom", F.col("pos1").cast("long").alias("pos1"), F.col("_seq").alias("seq"), F.col("_id").alias("id"), F.col("_low").alias("low"), gap.alias("gap"), "snp_q", deletion_length(F.col("cons")).alias("gone"), (F.col("snp_q") + s * reads).alias("score"))
    gaps, snps = able.filter("gap"), able.filter("not gap")
    good = gaps.filter(F.col("score") >= G).select("chrom", (F.col("pos1") + 1).alias("start0"), (F.col("pos1") + F.col("gone") + w + 1).alias("end1"))
    after = reliable(point_join(snps.select("chrom", "pos1", "id"), good, "pos1").select("id").distinct())
    snps = snps.join(after.withColumn("after", F.lit(True)), "id", "left").withColumn("after", F.coalesce("after", F.lit(False)))
    dense, pairs = _dense(snps.select("chrom", "pos1", "seq", "id", (~F.col("low") | F.col("after")).alias("counts")), W, N)
    seen = snps.select("chrom", "id", F.col("pos1").alias("start0"), (F.col("pos1") + w + 1).alias("end1"))
    before = point_join(gaps.filter(F.col("snp_q") >= G).select("chrom", "pos1"), seen, "pos1").select("id", F.col("pos1").alias("at"), F.lit("G").alias("mark"))
    crowded = pairs.join(dense.withColumnRenamed("id", "later"), "later").select("id", "at", F.lit("W").alias("mark"))
    none = F.lit(None).cast("long")
    told = [
        _worse_gaps(gaps, l).select("id", none.alias("at"), F.lit("g").alias("mark")),
        dense.select("id", none.alias("at"), F.lit("W").alias("mark")),
        after.select("id", none.alias("at"), F.lit("G").alias("mark")),
        before,
        crowded,
    ]
    rows = told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]).unionByName(told[4])
    own = lambda m: F.bool_or((F.col("mark") == m) & F.col("at").isNull())
    first = lambda m: F.min(F.when(F.col("mark") == m, F.col("at")))
    flags = rows.groupBy(F.col("id").alias("_id")).agg(own("g").alias("_g"), own("W").alias("_w"), own("G").alias("_a"), first("W").alias("_lw"), first("G").alias("_lg"))
    later = F.when(F.col("_lw").isNotNull() & (F.col("_lg").isNull() | (F.col("_lw") <= F.col("_lg"))), "W").when(F.col("_lg").isNotNull(), "G").otherwise("")
    reason = F.when(F.col("_poor").isNotNull(), F.col("_poor")).when(F.col("_g"), "g").when(F.col("_w"), "W").when(F.col("_a"), "G").when(F.col("_low"), "Q").when(gap, "").otherwise(F.coalesce(later, F.lit("")))
    return sites.join(flags, "_id", "left").select(*(F.col(f"`{c}`") for c in cns.columns), reason.alias("reason"))
