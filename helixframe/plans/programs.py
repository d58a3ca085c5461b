"""Whole analyses by name, each a chain of operators over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignments as R
from ..operators import annotation as A
from ..operators import events as E
from ..operators import intervals as I
from ..operators import quantify as Q
from ..operators import variants as V
from ..operators.indels import realigned_indels
from ..operators.variant_filter import variant_filter

PROGRAMS: dict[str, Callable] = {}


def program(f: Callable) -> Callable:
    PROGRAMS[f.__name__] = f
    return f


@program
def prepare_annotation(occ: DataFrame, by_name: bool = True, by_exon: bool = False, by_group: bool = False, read_length: int = 36, min_span: int = 4) -> dict[str, DataFrame]:
    """Exon occurrences to membership, loci, exons, segments, junctions, known junction tags and their blocks."""
    member = A.loci(occ, by_name, by_exon, by_group)
    ex = A.exons(occ)
    tags = E.known_junctions(occ, read_length, min_span).withColumn("tag_id", F.xxhash64("chrom", "strand", "blocks"))
    return {"membership": member, "loci": A.locus_summary(occ, member), "exons": ex, "gblocks": A.gblocks(ex), "junctions": A.junctions(occ), "tags": tags, "tag_blocks": E.tag_blocks(tags, read_length, min_span)}


def locus_tables(occ: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exons and junctions of each locus."""
    own = occ.join(member, "tx_id").withColumn("gene_id", F.col("locus"))
    return own.select("locus", "chrom", "strand", "start0", "end1").distinct(), A.gene_junctions(own).withColumnRenamed("gene_id", "locus")


@program
def path_events(occ: DataFrame, reads: DataFrame, jnx_counts: DataFrame, a: tuple[int, int] = (1, 1), b: tuple[int, int] = (2, 2), member: DataFrame | None = None) -> DataFrame:
    """Quantified pair-path events; (1,1),(2,2) are skipped exons. ``jnx_counts``: locus, end1, next_start0, n_reads, n_positions."""
    member = A.loci(occ) if member is None else member
    lx, j = locus_tables(occ, member)
    ev = E.drop_iso_bound(E.aep_events(E.splice_paths(j, b[1]), E.bound_groups(lx), a, b)).withColumn("event_id", F.xxhash64("locus", "exc", "inc"))
    ex = lx.select("chrom", "start0", "end1").distinct()
    held = I.point_join(Q.read_starts(reads), ex).groupBy("chrom", "start0", "end1").agg(F.sum("n").alias("n_reads"))
    counts = lx.join(held, ["chrom", "start0", "end1"], "left").select("locus", "start0", "end1", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), (F.col("end1") - F.col("start0")).alias("n_positions")).distinct()
    return E.quantify(ev, counts, jnx_counts)


@program
def expression(occ: DataFrame, reads: DataFrame, ratio: float = 0.5, read_length: int = 36, from_max: int | None = None) -> DataFrame:
    """Constitutive reads and positions of each gene, and reads per thousand positions."""
    e = Q.constitutive_expression(occ, A.gblocks(A.exons(occ)), reads, ratio, read_length, from_max)
    return e.withColumn("density", F.try_divide(F.col("n_reads") * 1000.0, F.col("n_positions")))


@program
def call_variants(aln: DataFrame, sequences: DataFrame, model: str = "soap", **filters) -> DataFrame:
    """VCF columns of the SNPs and the realigned indels of alignments that pass the variant filter."""
    snps = V.call_snps(V.consensus(V.read_likelihoods(aln, model)), sequences)
    none = {"a1": F.lit("*"), "a2": F.lit("*"), "cnt1": F.lit(0).cast("long"), "cnt2": F.lit(0).cast("long")}
    cols = ["chrom", "pos1", "ref", "cons", "cons_q", "snp_q", "rms_mapq", "depth", *none]
    both = snps.withColumns(none).select(*cols).unionByName(realigned_indels(aln, sequences).select(*cols))
    passed = variant_filter(V.variants_only(both), **filters).filter("reason = ''")
    return V.to_vcf(passed, sequences)


@program
def alignment_report(aln: DataFrame, contigs: DataFrame) -> dict[str, DataFrame]:
    """Counters, counts per contig and duplicates per library."""
    return {"flagstat": R.flagstat(aln), "idxstats": R.idxstats(aln, contigs), "duplicates": R.dup_report(aln)}
