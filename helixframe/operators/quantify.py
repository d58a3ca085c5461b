"""Reads and mappable positions on segments and junctions, densities and expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bounds as B
from . import intervals as I

BLOCK = ["chrom", "start0", "end1"]


def quality_filter(reads: DataFrame, min_mapq: int = 0, max_nm: int | None = None) -> DataFrame:
    kept = reads.filter(F.col("mapq") >= min_mapq)
    return kept if max_nm is None else kept.filter(F.col("nm") <= max_nm)


def read_starts(reads: DataFrame) -> DataFrame:
    """(chrom, pos0, n): read starts counted per position, which bounds the rows of a bin whatever a locus expresses."""
    return reads.groupBy("chrom", "pos0").agg(F.count(F.lit(1)).alias("n"))


def assign_reads(reads: DataFrame, blocks: DataFrame, how: str = "left") -> DataFrame:
    """Read starts (chrom, pos0, n) with the one segment that holds each; none for blind spots."""
    return I.point_join(read_starts(reads), blocks.select(*BLOCK), how=how)


def block_counts(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, start0, end1, n_reads) for every segment, 0 where no read starts."""
    counted = assign_reads(reads, blocks, "inner").groupBy(*BLOCK).agg(F.sum("n").alias("n_reads"))
    return blocks.select(*BLOCK).join(counted, BLOCK, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))


def assign_jnx_reads(jnx_reads: DataFrame, tag_blocks: DataFrame) -> DataFrame:
    """Counts of reads on junction tags by the tag block that holds their start.

    Reads stream past their tag's blocks, which are hashed, and are neither sorted nor held; only counts of blocks are.
    """
    found = jnx_reads.join(tag_blocks.hint("shuffle_hash"), "tag_id").filter("pos0 >= block_start0 and pos0 < block_end1")
    return found.groupBy("tag_id", "block_start0", "block_end1").agg(F.count(F.lit(1)).alias("n_reads"))


def mappable_on_blocks(runs: DataFrame, blocks: DataFrame, read_length: int) -> DataFrame:
    """Mappable starts on each segment: ``pos_l`` where a whole read fits inside, ``pos_r`` where it protrudes.

    ``runs``: (chrom, start1, end1), both inclusive.
    """
    r = runs.select("chrom", (F.col("start1") - 1).alias("r_start0"), F.col("end1").alias("r_end1"))
    found = I.overlap_join(blocks.select(*BLOCK), r)
    s, e = F.greatest("start0", "r_start0"), F.least("end1", "r_end1")
    fit = F.greatest(F.col("end1") - read_length + 1, F.col("start0"))
    left, right = F.greatest(F.least(e, fit) - s, F.lit(0)), F.greatest(e - F.greatest(s, fit), F.lit(0))
    summed = found.groupBy(*BLOCK).agg(F.sum(left).alias("pos_l"), F.sum(right).alias("pos_r"))
    return blocks.select(*BLOCK).join(summed, BLOCK, "left").select(*BLOCK, F.coalesce("pos_l", F.lit(0)).alias("pos_l"), F.coalesce("pos_r", F.lit(0)).alias("pos_r"))


def mappable_on_tags(runs: DataFrame, tag_blocks: DataFrame) -> DataFrame:
    """Mappable starts on junction tag blocks; ``runs``: (tag_id, start1, end1)."""
    r = runs.select("tag_id", (F.col("start1") - 1).alias("r_start0"), F.col("end1").alias("r_end1"))
    t = tag_blocks.select("tag_id", F.col("block_start0").alias("start0"), F.col("block_end1").alias("end1"))
    return I.set_overlap_length(t, r.withColumnsRenamed({"r_start0": "start0", "r_end1": "end1"}), ["tag_id"]).select("tag_id", F.col("start0").alias("block_start0"), F.col("end1").alias("block_end1"), F.col("overlap").alias("n_positions"))


def blocks_in(blocks: DataFrame, spans: DataFrame, complete: bool = True) -> DataFrame:
    """Segments inside each span (chrom, s0, e1), or overlapping it where not ``complete``."""
    found = I.overlap_join(spans, blocks.select(*BLOCK), ("s0", "e1"), ("start0", "end1"))
    return found.filter("start0 >= s0 and end1 <= e1") if complete else found


def exonic_stats(blocks: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads and positions over exonic and other segments, per chromosome and in all (chrom null)."""
    counted = block_counts(reads, blocks).join(blocks.select(*BLOCK, "n_exons"), BLOCK)
    exonic, size = F.col("n_exons") > 0, F.col("end1") - F.col("start0")
    part = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return counted.rollup("chrom").agg(part(F.col("n_reads"), exonic).alias("exonic_reads"), part(size, exonic).alias("exonic_positions"), part(F.col("n_reads"), ~exonic).alias("other_reads"), part(size, ~exonic).alias("other_positions"))


def run_density(run_blocks: DataFrame, reads: DataFrame, read_length: int, keys: list[str]) -> DataFrame:
    """Reads and positions of each run of contiguous segments.

    All but the run's last segment count every start; the last counts starts that leave room for a whole read.
    ``run_blocks``: keys, chrom, start0, end1.
    """
    last = Window.partitionBy(*keys)
    b = run_blocks.withColumn("limit1", F.when(F.col("end1") == F.max("end1").over(last), F.greatest(F.col("end1") - read_length + 1, F.col("start0"))).otherwise(F.col("end1")))
    rows = b.select(*[k for k in keys if k != "chrom"], "chrom", "start0", F.col("limit1").alias("end1"))
    held = I.point_join(read_starts(reads), rows.filter("start0 < end1")).groupBy(*keys).agg(F.sum("n").alias("n_reads"))
    size = rows.groupBy(*keys).agg(F.sum(F.col("end1") - F.col("start0")).alias("n_positions"))
    return size.join(held, keys, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))


def junction_density(tag_blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Reads and positions of each junction, summed over its tag blocks."""
    on = ["tag_id", "block_start0", "block_end1"]
    return tag_blocks.join(counts, on, "left").groupBy("junction_id").agg(F.coalesce(F.sum("n_reads"), F.lit(0)).alias("n_reads"), F.sum(F.col("block_end1") - F.col("block_start0")).alias("n_positions"))


def constitutive_expression(occ: DataFrame, blocks: DataFrame, reads: DataFrame, ratio: float, read_length: int, from_max: int | None = None) -> DataFrame:
    """Reads and positions of each gene's constitutive segments.

    Transcripts with at least the threshold of exons vote; segments that a share of ``ratio`` of them has are chained
    where they touch; each chain's last segment counts starts with room for a whole read. A gene without such segments
    has null counts.
    """
    from .annotation import exon_count_threshold

    counts = occ.groupBy("gene_id", "tx_id").agg(F.count(F.lit(1)).alias("k"))
    voters = counts.join(exon_count_threshold(occ, from_max=from_max), "gene_id").filter("k >= threshold").select("gene_id", "tx_id") if from_max is not None else counts.select("gene_id", "tx_id")
    n = voters.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_tx"))
    rows = occ.join(voters, ["gene_id", "tx_id"], "left_semi").select("gene_id", "tx_id", "chrom", F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1"))
    votes = I.overlap_join(blocks.select(*BLOCK), rows).groupBy("gene_id", *BLOCK).agg(F.countDistinct("tx_id").alias("votes"))
    kept = votes.join(n, "gene_id").filter(F.col("votes") >= F.lit(ratio) * F.col("n_tx")).select("gene_id", *BLOCK)
    chains = I.number_islands(kept, ["gene_id", "chrom"], out="chain")
    dense = run_density(chains.select("gene_id", "chrom", "chain", "start0", "end1"), reads, read_length, ["gene_id", "chrom", "chain"])
    sums = dense.groupBy("gene_id").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_positions").alias("n_positions"), F.count(F.lit(1)).alias("n_chains"))
    return n.join(sums, "gene_id", "left").select("gene_id", "n_tx", "n_chains", "n_reads", "n_positions")


def window_significance(reads: DataFrame, window: int, rate: float | None = None, method: str = "naus") -> DataFrame:
    """Fixed windows (chrom, start0, n_reads) with ``p``, how likely so many reads or more are in some window of the genome.

    ``rate``: reads a base; None takes the reads over the covered span. ``method``: naus (product formula), approx33
    (two-term bound) or alm (declumped Poisson).
    """
    counts = reads.groupBy("chrom", (F.floor(F.col("pos0") / window) * window).alias("start0")).agg(F.count(F.lit(1)).alias("n_reads"))
    span = reads.groupBy("chrom").agg((F.max("pos0") - F.min("pos0") + 1).alias("w"), F.count(F.lit(1)).alias("k")).agg(F.sum("w").alias("span"), F.sum("k").alias("k"))
    rows = counts.join(F.broadcast(span))
    mu = F.lit(rate * window) if rate is not None else F.col("k") / F.col("span") * window
    n, folds = F.col("n_reads"), F.col("span") / window
    log_factorial = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i))
    pmf = lambda k: F.when(k < 0, 0.0).otherwise(F.exp(F.greatest(k, F.lit(0)) * F.log("mu") - F.col("mu") - log_factorial(k)))
    cdf = lambda k: F.when(k < 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")), F.struct(F.exp(-F.col("mu")).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * F.col("mu") / (i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"]))
    rows = rows.withColumns({"mu": mu, "folds": folds})
    upper = F.greatest(1 - cdf(n - 1), F.lit(0.0))
    if method == "alm":
        p = F.when(n <= F.col("mu"), 1.0).otherwise(1 - F.exp(-F.col("folds") * (n - F.col("mu")) * pmf(n)))
    elif method == "approx33":
        p = F.least(F.lit(1.0), F.col("folds") * (F.greatest(n - F.col("mu"), F.lit(0.0)) * pmf(n) + 2 * upper))
    else:
        q2 = cdf(n - 1) ** 2 - (n - 1) * pmf(n) * pmf(n - 2) - (n - 1 - F.col("mu")) * pmf(n) * cdf(n - 3)
        q3 = F.greatest(q2 - F.greatest(n - F.col("mu"), F.lit(0.0)) * pmf(n) * cdf(n - 1), F.lit(1e-300))
        p = 1 - F.greatest(q2, F.lit(1e-300)) * F.pow(F.least(q3 / F.greatest(q2, F.lit(1e-300)), F.lit(1.0)), F.greatest(F.col("folds") - 2, F.lit(0.0)))
    return rows.select("chrom", F.col("start0").cast("long").alias("start0"), "n_reads", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))
