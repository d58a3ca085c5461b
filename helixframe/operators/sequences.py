"""Sequences in chunks (contig, chunk, seq) and substrings of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16384


def fetch_sequence(chunks: DataFrame, regions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``regions`` (contig, start0, end1) with ``seq``, ends cut to the contig; regions outside have an empty text.

    Each region meets the chunks that it touches by an equi-join, takes its part of each, and joins them in order.
    """
    own = regions.select("contig", "start0", "end1").distinct()
    pieces = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start0") / chunk), F.floor((F.greatest("end1", F.col("start0") + 1) - 1) / chunk))))
    met = pieces.join(chunks.select("contig", F.col("chunk").cast("long").alias("chunk"), "seq"), ["contig", "chunk"])
    lo = F.greatest(F.col("start0") - F.col("chunk") * chunk, F.lit(0))
    part = F.substr("seq", (lo + 1).cast("int"), F.greatest(F.col("end1") - F.col("chunk") * chunk - lo, F.lit(0)).cast("int"))
    held = met.groupBy("contig", "start0", "end1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))), lambda x: x["part"]), "").alias("seq"))
    return regions.join(held, ["contig", "start0", "end1"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def with_ref_base(sites: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sites`` (contig, pos0) with ``ref``, the reference base, N where there is none."""
    keyed = sites.withColumn("chunk", F.floor(F.col("pos0") / chunk))
    met = keyed.join(chunks.select("contig", F.col("chunk").cast("long").alias("chunk"), "seq"), ["contig", "chunk"], "left")
    base = F.substr("seq", (F.col("pos0") - F.col("chunk") * chunk + 1).cast("int"), F.lit(1))
    return met.withColumn("ref", F.when(F.length(base) == 1, F.upper(base)).otherwise("N")).drop("chunk", "seq")
