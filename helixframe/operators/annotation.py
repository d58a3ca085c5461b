"""Transcripts to exons, segments, junctions and loci.

``exon_occurrence`` rows are (tx_id, gene_id, chrom, strand, start0, end1, ...), one for each exon of each transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I
from .graph import label_components
from .scans import next_position

EXON = ["chrom", "start0", "end1"]


def merged_strand(c: str = "strand") -> Column:
    """The one strand of a group, or ``=`` where there are several."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise("=")


def exon_occurrence(transcripts: DataFrame) -> DataFrame:
    """One row for each exon, with its part of the coding bounds."""
    e = transcripts.select("tx_id", F.col("gene").alias("gene_id"), "chrom", "strand", "cds_start0", "cds_end1", F.posexplode("exons").alias("rank", "e"))
    coding = e.select("*", F.greatest("e.start0", "cds_start0").alias("c0"), F.least("e.end1", "cds_end1").alias("c1"))
    return coding.select("tx_id", "gene_id", "chrom", "strand", F.col("e.start0").alias("start0"), F.col("e.end1").alias("end1"), F.col("e.frame").alias("frame"), "rank", F.when(F.col("c0") < F.col("c1"), F.col("c0")).alias("coding_start0"), F.when(F.col("c0") < F.col("c1"), F.col("c1")).alias("coding_end1"))


def exons(occ: DataFrame) -> DataFrame:
    """Distinct exons: strand, the number of transcripts and, where known, the tightest coding bounds."""
    extra = [F.max("coding_start0").alias("max_coding_start0"), F.min("coding_end1").alias("min_coding_end1")] if "coding_start0" in occ.columns else []
    return occ.groupBy(*EXON).agg(merged_strand().alias("strand"), F.count(F.lit(1)).alias("n_tx"), *extra)


def gblocks(exon_rows: DataFrame) -> DataFrame:
    """Chromosomes cut at every exon boundary, from 0 to the last: strand (``.`` in gaps) and the number of exons over each."""
    ends = exon_rows.select("chrom", F.explode(F.array(F.col("start0"), F.col("end1"), F.lit(0).cast("long"))).alias("p"))
    own = I.segments(ends)
    cover = I.overlap_join(own, exon_rows.select("chrom", F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1"), "strand"))
    over = cover.groupBy(*EXON).agg(merged_strand().alias("strand"), F.count(F.lit(1)).alias("n_exons"))
    return own.join(over, EXON, "left").select(*EXON, F.coalesce("strand", F.lit(".")).alias("strand"), F.coalesce("n_exons", F.lit(0)).alias("n_exons"))


def gblock_exons(blocks: DataFrame, exon_rows: DataFrame) -> DataFrame:
    """The bridge of segments and the exons that they are part of."""
    return I.overlap_join(blocks.select(*EXON), exon_rows.select("chrom", F.col("start0").alias("exon_start0"), F.col("end1").alias("exon_end1")), right_bounds=("exon_start0", "exon_end1"))


def exon_ranks(occ: DataFrame) -> DataFrame:
    """Ranks of exons in their transcripts from 1, in the direction of transcription."""
    w = Window.partitionBy("tx_id")
    up, down = F.row_number().over(w.orderBy("start0", "end1")), F.row_number().over(w.orderBy(F.desc("start0"), F.desc("end1")))
    return occ.withColumn("exon_rank", F.when(F.col("strand") == "-", down).otherwise(up))


def junctions(occ: DataFrame) -> DataFrame:
    """Edges between consecutive exons of a transcript, once each: strand, transcripts, and edges into the right exon."""
    w = Window.partitionBy("tx_id").orderBy("start0", "end1")
    rows = occ.withColumns({"next_start0": F.lead("start0").over(w), "next_end1": F.lead("end1").over(w)}).filter("next_start0 is not null")
    edges = rows.groupBy(*EXON, "next_start0", "next_end1").agg(merged_strand().alias("strand"), F.count(F.lit(1)).alias("n_tx"))
    into = edges.groupBy("chrom", "next_start0", "next_end1").agg(F.count(F.lit(1)).alias("in_degree"))
    return edges.join(into, ["chrom", "next_start0", "next_end1"])


def gene_junctions(occ: DataFrame, transcript: list[str] | None = None) -> DataFrame:
    """Distinct junctions of each gene; ``transcript`` has the columns that name a transcript, tx_id unless given."""
    w = Window.partitionBy(*(transcript or ["tx_id"])).orderBy("start0", "end1")
    rows = occ.withColumns({"next_start0": F.lead("start0").over(w), "next_end1": F.lead("end1").over(w)}).filter("next_start0 is not null")
    return rows.select("gene_id", "chrom", "strand", "start0", "end1", "next_start0", "next_end1").distinct()


def sibling_groups(exon_rows: DataFrame) -> DataFrame:
    """Overlapping exons in numbered sets, forward ones (``=`` too) before reverse ones."""
    forward = exon_rows.withColumn("pass", F.when(F.col("strand") == "-", 1).otherwise(0))
    return I.number_islands(forward, ["chrom", "pass"], touching=False, out="sibling_set")


def loci(occ: DataFrame, by_name: bool = True, by_exon: bool = False, by_group: bool = False) -> DataFrame:
    """(tx_id, locus): transcripts linked by gene name, by a shared exon of equal strand, or by overlapping exons.

    By name alone the gene is the locus; otherwise links are followed to connected components, named by their least tx_id.
    """
    tx = occ.groupBy("tx_id").agg(F.min("gene_id").alias("gene_id"))
    if by_name and not by_exon and not by_group:
        least = tx.groupBy("gene_id").agg(F.min("tx_id").alias("locus"))
        return tx.join(least, "gene_id").select("tx_id", "locus")
    links = []
    if by_name:
        links.append((tx, ["gene_id"]))
    if by_exon:
        links.append((occ, [*EXON, "strand"]))
    if by_group:
        own = sibling_groups(occ.select(*EXON, "strand").distinct())
        links.append((occ.join(own, [*EXON, "strand"]), ["chrom", "pass", "sibling_set"]))
    edges = None
    for rows, keys in links:  # each member to the least of its group: as many edges as rows
        least = rows.groupBy(*keys).agg(F.min("tx_id").alias("b"))
        part = rows.join(least, keys).select(F.col("tx_id").alias("a"), "b").filter("a <> b").distinct()
        edges = part if edges is None else edges.unionByName(part)
    return label_components(tx.select(F.col("tx_id").alias("node")), edges).select(F.col("node").alias("tx_id"), F.col("label").alias("locus"))


def locus_summary(occ: DataFrame, membership: DataFrame) -> DataFrame:
    """One row per locus: place, names (sorted), transcripts, exons, and the most and fewest exons of a transcript."""
    rows = occ.join(membership, "tx_id")
    per_tx = rows.groupBy("locus", "tx_id").agg(F.count(F.lit(1)).alias("k"))
    sizes = per_tx.groupBy("locus").agg(F.count(F.lit(1)).alias("n_tx"), F.max("k").alias("max_exons"), F.min("k").alias("min_exons"))
    place = rows.groupBy("locus").agg(F.min("chrom").alias("chrom"), F.min("start0").alias("start0"), F.max("end1").alias("end1"), merged_strand().alias("strand"), F.array_sort(F.collect_set(F.col("gene_id").cast("string"))).alias("names"), F.countDistinct("chrom", "start0", "end1").alias("n_exons"))
    return place.join(sizes, "locus")


def loci_by_name(summary: DataFrame, name: str) -> DataFrame:
    return summary.filter(F.array_contains("names", name))


def locus_only_from(transcripts: DataFrame, membership: DataFrame, source: str) -> DataFrame:
    """Transcripts of loci whose every transcript comes from one source."""
    rows = transcripts.select("tx_id", "anno_source").join(membership, "tx_id")
    pure = rows.groupBy("locus").agg(F.bool_and(F.col("anno_source") == source).alias("pure")).filter("pure")
    return rows.join(pure, "locus", "left_semi").select("tx_id", "locus")


def exon_count_threshold(occ: DataFrame, percentile: float | None = None, from_max: int | None = None, from_min: int | None = None) -> DataFrame:
    """(gene_id, threshold): the exon count at floor(n*p)-1 of the sorted counts, max - k (at least 1), or min + k."""
    counts = occ.groupBy("gene_id", "tx_id").agg(F.count(F.lit(1)).alias("k"))
    if percentile is not None:
        own = counts.groupBy("gene_id").agg(F.sort_array(F.collect_list("k")).alias("ks"))
        at = F.greatest(F.floor(F.size("ks") * F.lit(percentile)) - 1, F.lit(0)).cast("int")
        return own.select("gene_id", F.get("ks", at).alias("threshold"))
    if from_max is not None:
        return counts.groupBy("gene_id").agg(F.greatest(F.max("k") - from_max, F.lit(1)).alias("threshold"))
    return counts.groupBy("gene_id").agg((F.min("k") + (from_min or 0)).alias("threshold"))


def tss_windows(occ: DataFrame, up: int, down: int) -> DataFrame:
    """Distinct windows around transcription starts, strand aware, numbered within their gene."""
    tx = occ.groupBy("gene_id", "tx_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start0").alias("s"), F.max("end1").alias("e"))
    minus = F.col("strand") == "-"
    start = F.when(minus, F.col("e") - 1 - down).otherwise(F.col("s") - up)
    win = tx.select("gene_id", "chrom", "strand", F.greatest(start, F.lit(0)).cast("long").alias("start0"), (start + up + down + 1).alias("end1")).distinct()
    return win.withColumn("n", F.row_number().over(Window.partitionBy("gene_id").orderBy("chrom", "start0", "end1", "strand")).cast("long"))


def nonexonic_gaps(exon_rows: DataFrame, occ: DataFrame | None = None) -> DataFrame:
    """Regions between merged exon clusters; with ``occ`` labelled by what flanks them.

    ``Intron i,j`` where one transcript has consecutive exons i and j at the two sides, ``Promoter`` where a transcript
    starts at a side, ``3'UTR`` where one ends, in this order.
    """
    cluster = I.islands(exon_rows.select(*EXON), ["chrom"], touching=True).drop("n")
    gaps = next_position(cluster, ["chrom"], "start0", "next0").filter("next0 is not null").select("chrom", F.col("end1").alias("start0"), F.col("next0").alias("end1"))
    if occ is None:
        return gaps
    w = Window.partitionBy("tx_id")
    r = exon_ranks(occ).withColumns({"n": F.count(F.lit(1)).over(w), "next0": F.lead("start0").over(w.orderBy("start0", "end1"))})
    r = r.withColumn("next_rank", F.col("exon_rank") + F.when(F.col("strand") == "-", -1).otherwise(1))
    intron = r.filter("next0 is not null").select("chrom", F.col("end1").alias("a"), F.col("next0").alias("b"), F.concat(F.lit("Intron "), F.least("exon_rank", "next_rank"), F.lit(","), F.greatest("exon_rank", "next_rank")).alias("label"))
    spans = I.overlap_join(gaps, intron, right_bounds=("a", "b")).filter("a <= start0 and b >= end1").groupBy(*EXON).agg(F.min("label").alias("intron"))
    ends = r.filter("exon_rank = 1 or exon_rank = n").select("chrom", "strand", "start0", "end1", (F.col("exon_rank") == 1).alias("first"))
    left = ends.select("chrom", F.col("end1").alias("gs"), F.when(F.col("first") & (F.col("strand") == "-"), 2).when(~F.col("first") & (F.col("strand") != "-"), 1).otherwise(0).alias("k")).groupBy("chrom", "gs").agg(F.max("k").alias("lk"))
    right = ends.select("chrom", F.col("start0").alias("ge"), F.when(F.col("first") & (F.col("strand") != "-"), 2).when(~F.col("first") & (F.col("strand") == "-"), 1).otherwise(0).alias("k")).groupBy("chrom", "ge").agg(F.max("k").alias("rk"))
    out = gaps.join(spans, EXON, "left").join(left.withColumnRenamed("gs", "start0"), ["chrom", "start0"], "left").join(right.withColumnRenamed("ge", "end1"), ["chrom", "end1"], "left")
    kind = F.greatest(F.coalesce("lk", F.lit(0)), F.coalesce("rk", F.lit(0)))
    return out.select(*EXON, F.coalesce("intron", F.when(kind == 2, "Promoter").when(kind == 1, "3'UTR").otherwise("Intergenic")).alias("label"))


#: What the reading-frame test of an exon pair reads: -1 for a non-coding exon, else the bases of a codon begun before it.
CODING = ["frame", "cds_start0", "cds_end1"]


def keeps_frame(up: Column, down: Column, strand: Column) -> Column:
    """Whether translation goes on from one exon into another that follows it in transcript direction.

    ``up`` and ``down`` are structs of bounds and CODING. A coding exon hands on the bases since its coding region began
    (frame 0), or since the codon that it was entered in did; the next exon has to begin with as many. From a non-coding one
    the next is non-coding too, or has the place where the first one's transcript starts to code.
    """
    plus = strand != "-"
    begin = F.when(plus, up["cds_start0"]).otherwise(up["cds_end1"])
    run = F.when(plus, up["end1"] - begin).otherwise(begin - up["start0"])
    handed = F.when(up["frame"] == 0, run).otherwise(up["end1"] - up["start0"] + up["frame"])
    return F.when(up["frame"] == -1, (down["frame"] == -1) | begin.between(down["start0"], down["end1"])).otherwise(down["frame"] == F.pmod(handed, F.lit(3)))


def denovo_pairs(exon_rows: DataFrame, dist: int, min_intron: int = 50, in_frame: bool | None = None) -> DataFrame:
    """Exon pairs of one strand whose gap is from ``min_intron`` to ``dist`` bases.

    With exons that have the columns CODING, ``in_frame`` False adds whether a pair keeps the reading frame and True keeps
    those that do.
    """
    more = [] if in_frame is None else CODING
    exon = F.struct("start0", "end1", *more)
    a = exon_rows.select("chrom", "strand", exon.alias("_a"), (F.col("end1") + min_intron).alias("from0"), (F.col("end1") + dist + 1).alias("to1"))
    b = exon_rows.select("chrom", "strand", F.col("start0").alias("next_start0"), exon.alias("_b"))
    pairs = I.point_join(b, a, "next_start0", ("from0", "to1"), ["chrom", "strand"])
    out = ["chrom", "strand", F.col("_a.start0").alias("start0"), F.col("_a.end1").alias("end1"), "next_start0", F.col("_b.end1").alias("next_end1")]
    if in_frame is None:
        return pairs.select(*out)
    minus = F.col("strand") == "-"
    kept = keeps_frame(F.when(minus, F.col("_b")).otherwise(F.col("_a")), F.when(minus, F.col("_a")).otherwise(F.col("_b")), F.col("strand"))
    told = pairs.select(*out, kept.alias("in_frame"))
    return told.filter("in_frame") if in_frame else told


def utr_runs(blocks: DataFrame, min_blocks: int = 2) -> DataFrame:
    """Runs of a gene's consecutive blocks that touch or overlap, numbered, with at least ``min_blocks`` each."""
    w = Window.partitionBy("gene_id").orderBy("start0", "end1")
    seen = F.max("end1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = blocks.withColumn("_new", F.when(seen.isNull() | (F.col("start0") > seen), 1).otherwise(0))
    runs = flagged.withColumn("run", F.sum("_new").over(w)).drop("_new")
    return runs.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("gene_id", "run"))).filter(F.col("_k") >= min_blocks).drop("_k")


def coding_clip(locus_blocks: DataFrame, exon_rows: DataFrame) -> DataFrame:
    """Blocks cut to the coding part of their exons; a block that any of its exons leaves outside goes.

    ``locus_blocks``: (chrom, start0, end1, exon_start0, exon_end1); ``exon_rows`` have the tightest coding bounds.
    """
    e = exon_rows.select("chrom", F.col("start0").alias("exon_start0"), F.col("end1").alias("exon_end1"), "max_coding_start0", "min_coding_end1")
    cut = locus_blocks.join(e, ["chrom", "exon_start0", "exon_end1"]).withColumns({"c0": F.greatest("start0", "max_coding_start0"), "c1": F.least("end1", "min_coding_end1")})
    bad = F.max(F.when(F.col("max_coding_start0").isNull() | F.col("min_coding_end1").isNull() | (F.col("c0") >= F.col("c1")), 1).otherwise(0))
    return cut.groupBy(*EXON).agg(F.max("c0").alias("c0"), F.min("c1").alias("c1"), bad.alias("bad")).filter("bad = 0 and c0 < c1").select("chrom", F.col("c0").alias("start0"), F.col("c1").alias("end1"))


def drop_ambiguous(df: DataFrame) -> DataFrame:
    """Rows whose strand isn't ``=``."""
    return df.filter("strand <> '='")


def same_locus(edges: DataFrame) -> DataFrame:
    """Edges within one locus."""
    return edges.filter("left_locus = right_locus")


def exon_xref(exon_rows: DataFrame) -> DataFrame:
    """(exon name, place) as text for a cross reference."""
    return exon_rows.select(F.concat_ws(":", "chrom", F.concat_ws("-", F.col("start0") + 1, "end1"), "strand").alias("exon"), *EXON, "strand")


def transcript_xref(occ: DataFrame) -> DataFrame:
    """(tx_id, gene_id, exons): exon places in order, joined by commas."""
    held = occ.groupBy("tx_id", "gene_id").agg(F.sort_array(F.collect_list(F.struct("start0", "end1"))).alias("e"))
    return held.select("tx_id", "gene_id", F.array_join(F.transform("e", lambda x: F.concat_ws("-", x["start0"], x["end1"])), ",").alias("exons"))


def locus_exon_bounds(locus_exon: DataFrame) -> DataFrame:
    """BED rows of a locus's exons, named by their boundary group."""
    return locus_exon.select("chrom", "start0", "end1", F.concat_ws("_", F.concat(F.lit("L"), "left_group"), F.concat(F.lit("R"), "right_group")).alias("name"), F.lit(0).alias("score"), "strand")
