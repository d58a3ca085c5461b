"""Indel genotypes from reads aligned anew to each candidate haplotype of a site."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as L
from . import intervals as I
from .alignments import mask_reads
from .graph import reliable
from .sequences import fetch_sequence
from .variants import SCALE, SITE, read_indels

#: Bases on either side of a site that its haplotypes hold.
WINDOW = 50
#: By so much each further step between two candidates' lengths adds less to what one read can tell.
DEPENDENCE = 0.9
#: What a heterozygote pays for each read, a fixed value.
HET_READ = 3
_FAR = 1 << 28
#: Alignments that are worked on side by side.
SLAB = 4096


def banded_costs(reads: list[bytes], quals: list[bytes], haps: list[bytes], offset: np.ndarray, band: int, gap_open: int = 40, gap_extend: int = 40, most: int = 30) -> np.ndarray:
    """The least cost of each read inside its haplotype, all reads at once.

    A mismatch costs the base's quality, ``most`` at most, and nothing against N; a gap ``gap_open`` for its first base and
    ``gap_extend`` for each other; the haplotype's ends are free, the read is aligned whole. Places are looked for up to
    ``band`` bases from ``offset``. One step is one base of all reads; a row holds costs by distance from the diagonal.
    """
    n, width = len(reads), 2 * band + 1
    long, wide = max(map(len, reads), default=0), max(map(len, haps), default=0)
    r, q, h = np.zeros((n, long), np.uint8), np.zeros((n, long), np.int32), np.full((n, wide + 1), ord("N"), np.uint8)
    for k in range(n):
        r[k, : len(reads[k])] = np.frombuffer(reads[k], np.uint8)
        q[k, : len(quals[k])] = np.frombuffer(quals[k], np.uint8)
        h[k, : len(haps[k])] = np.frombuffer(haps[k], np.uint8)
    q = np.minimum(np.maximum(q - 33, 0), most)
    size, ends = np.array([len(x) for x in reads]), np.array([len(x) for x in haps])
    at = np.arange(width)
    j = offset[:, None] + at - band  # haplotype bases used so far, by distance
    best = np.where((j >= 0) & (j <= ends[:, None]), 0, _FAR).astype(np.int32)
    inserted = np.full((n, width), _FAR, np.int32)
    for i in range(long):
        j = j + 1
        inside = (j >= 1) & (j <= ends[:, None])
        base = np.take_along_axis(h, np.clip(j - 1, 0, wide), axis=1)
        cost = np.where((base == r[:, i : i + 1]) | (base == ord("N")), 0, q[:, i : i + 1])
        step = np.where(inside, best + cost, _FAR)
        gap = np.full((n, width), _FAR, np.int32)
        gap[:, :-1] = np.minimum(best[:, 1:] + gap_open, inserted[:, 1:] + gap_extend)
        gap[(j < 0) | (j > ends[:, None])] = _FAR
        now = np.minimum(step, gap)
        open_ = np.minimum.accumulate(now - gap_extend * at, axis=1)  # a deletion starts at any place before
        now[:, 1:] = np.minimum(now[:, 1:], np.where(inside[:, 1:], open_[:, :-1] + gap_open - gap_extend + gap_extend * at[1:], _FAR))
        on = (i < size)[:, None]
        best, inserted = np.where(on, now, best), np.where(on, gap, inserted)
    return best.min(axis=1)


def read_segments(aln: DataFrame) -> DataFrame:
    """``aln`` with one row for each part of a read between skips: ``segment`` (stretches s, e, q and kind M or D) from ``s0`` to ``e1``."""
    stretch = "array<struct<s:bigint,e:bigint,q:bigint,k:string>>"
    none = F.array().cast(stretch)
    start = F.struct(F.col("pos0").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast(f"array<{stretch}>").alias("done"), none.alias("open"))

    def step(a: Column, x: Column) -> Column:
        base, gone, skip, extra = x["op"].isin("M", "=", "X"), x["op"] == "D", x["op"] == "N", x["op"].isin("I", "S")
        piece = F.array(F.struct(a["r"].alias("s"), (a["r"] + x["len"]).alias("e"), a["q"].alias("q"), F.when(gone, "D").otherwise("M").alias("k")))
        return F.struct(
            F.when(base | gone | skip, a["r"] + x["len"]).otherwise(a["r"]).alias("r"),
            F.when(base | extra, a["q"] + x["len"]).otherwise(a["q"]).alias("q"),
            F.when(skip, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(skip, none).when(base | gone, F.concat(a["open"], piece)).otherwise(a["open"]).alias("open"),
        )

    parts = F.aggregate(L.parse_cigar(F.col("cigar")), start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    rows = aln.withColumn("segment", F.explode(F.filter(parts, lambda p: F.size(p) > 0)))
    return rows.withColumns({"s0": F.get("segment", F.lit(0))["s"], "e1": F.element_at("segment", -1)["e"]})


def candidates(found: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(chrom, pos0, types): candidate lengths of each site, ascending, with the bases that insertions of a length have in most reads.

    ``found`` are read_indels' rows; ``proposed`` (chrom, pos0, length) adds sites and lengths. No indel is always one. Where
    no read shows a base it is N; of bases that as many reads show the alphabet's first counts.
    """
    size = F.when(F.col("kind").startswith("+"), F.length("kind") - 1).otherwise(F.col("kind").cast("int")).cast("int")
    each = found.groupBy(*SITE, "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("length", size)
    bases = each.filter("length > 0").select(*SITE, "length", "n", F.posexplode(F.split(F.substr("kind", F.lit(2)), "")).alias("k", "base")).filter(F.col("base").isin(*"ACGT"))
    votes = bases.groupBy(*SITE, "length", "k", "base").agg(F.sum("n").alias("n")).groupBy(*SITE, "length", "k").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("base"))
    letters = votes.groupBy(*SITE, "length").agg(F.map_from_entries(F.collect_list(F.struct("k", "base"))).alias("b"))
    lengths = each.select(*SITE, "length")
    if proposed is not None:
        lengths = lengths.unionByName(proposed.select("chrom", F.col("pos0").cast("long").alias("pos0"), F.col("length").cast("int").alias("length")))
    lengths = lengths.unionByName(lengths.select(*SITE).distinct().withColumn("length", F.lit(0))).distinct()
    known = lengths.join(letters, [*SITE, "length"], "left")
    ins = F.when(F.col("length") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.coalesce(F.try_element_at("b", k), F.lit("N"))), "")).otherwise("")
    return known.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("length", ins.alias("bases")))).alias("types"))


def haplotypes(sites: DataFrame, sequences: DataFrame) -> DataFrame:
    """``sites`` of ``candidates`` with ``left``, ``right``, ``most_deleted``, ``ref`` and ``haps``, the reference around a site with each candidate in it.

    Bases that some candidate deletes are N in the others, so that no haplotype gains by them.
    """
    most = -F.least(F.array_min(F.transform("types", lambda t: t["length"])), F.lit(0))
    own = sites.withColumns({"most_deleted": most, "left": F.greatest(F.col("pos0") - WINDOW, F.lit(0)), "contig": F.col("chrom"), "start0": F.greatest(F.col("pos0") - WINDOW, F.lit(0))})
    own = own.withColumn("right", F.col("pos0") + WINDOW + F.col("most_deleted")).withColumn("end1", F.col("right") + F.col("most_deleted") + WINDOW)
    before = (F.col("pos0") - F.col("left") + 1).cast("int")
    hap = lambda t: F.concat(F.substr("ref", F.lit(1), before), t["bases"], F.repeat(F.lit("N"), F.col("most_deleted") + F.least(t["length"], F.lit(0))), F.substr("ref", before + F.col("most_deleted") + 1))
    return fetch_sequence(sequences, own).withColumn("ref", F.upper("seq")).withColumn("haps", F.transform("types", hap)).drop("seq", "contig", "start0", "end1")


def _cost_column(gap_open: int, gap_extend: int, most: int):
    @F.pandas_udf("array<int>")
    def costs(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for haps, read, qual, offset, band in batches:
            many = haps.map(len).to_numpy(int)
            row, out = np.repeat(np.arange(len(haps)), many), np.zeros(int(many.sum()), np.int64)
            flat = [h.encode() for own in haps for h in own]
            r, q = [x.encode() for x in read], [x.encode() for x in qual]
            at, wide = offset.to_numpy(int)[row], band.to_numpy(int)[row]
            for b in np.unique(wide):
                own = np.flatnonzero(wide == b)
                own = own[np.argsort([len(r[i]) for i in row[own]], kind="stable")]
                for k in range(0, len(own), SLAB):
                    part = own[k : k + SLAB]
                    out[part] = banded_costs([r[i] for i in row[part]], [q[i] for i in row[part]], [flat[i] for i in part], at[part], int(b), gap_open, gap_extend, most)
            yield pd.Series(np.split(out, np.cumsum(many)[:-1]))

    return costs


def scored_reads(aln: DataFrame, sites: DataFrame, found: DataFrame, mask: int = L.DEFAULT_MASK, gap_open: int = 40, gap_extend: int = 40, r_snp: float = 0.001) -> DataFrame:
    """(chrom, pos0, ordinal, mapq, own, costs): each read over a site with its own indel's length and its cost on each haplotype of ``sites``.

    A read's bases inside the site's window count; what lies behind a skip doesn't.
    """
    reads = read_segments(mask_reads(aln, mask).select("ordinal", F.col("rname").alias("chrom"), "pos0", "cigar", "mapq", F.upper("seq").alias("seq"), "qual")).drop("pos0", "cigar")
    over = I.point_join(sites.select(*SITE, "left", "right", "haps", "types", "most_deleted"), reads, "pos0", ("s0", "e1"))
    part = F.filter("segment", lambda x: (x["k"] == "M") & (x["e"] > F.col("left")) & (x["s"] < F.col("right")))
    met = over.withColumn("part", part).filter(F.size("part") > 0)
    a, z = F.get("part", F.lit(0)), F.element_at("part", -1)
    begin, end = F.greatest(a["s"], F.col("left")), F.least(z["e"], F.col("right"))
    q0, q1 = a["q"] + begin - a["s"], z["q"] + end - z["s"]
    piece = lambda c: F.substr(c, (q0 + 1).cast("int"), (q1 - q0).cast("int"))
    spread = F.array_max(F.transform("types", lambda t: F.abs(t["length"])))
    cost = _cost_column(gap_open, gap_extend, int(-SCALE * math.log(r_snp) + 0.499))
    costs = cost(F.col("haps"), piece("seq"), piece("qual"), (begin - F.col("left")).cast("int"), (2 * spread + 2).cast("int"))
    size = F.when(F.col("kind").startswith("+"), F.length("kind") - 1).otherwise(F.col("kind").cast("int")).cast("int")
    shown = found.select(*SITE, "ordinal", size.alias("own"))
    return met.select(*SITE, "ordinal", "mapq", costs.alias("costs")).join(shown, [*SITE, "ordinal"], "left").withColumn("own", F.coalesce("own", F.lit(0)))


def realigned_indels(
    aln: DataFrame, sequences: DataFrame, proposed: DataFrame | None = None, q_indel: int = 40, r_indel: float = 0.00015, r_snp: float = 0.001, gap_extend: int | None = None, mask: int = L.DEFAULT_MASK
) -> DataFrame:
    """Indel rows of a consensus pileup, each read over a site being scored against every candidate haplotype there.

    The two candidates that all reads together cost least are the alleles (of equal ones the shorter); a read speaks for the
    one that costs it less, with at most what a gap of the candidates' distance is worth. A heterozygote costs HET_READ a read
    and the prior ``r_indel``. cons_q is the distance to the next genotype, snp_q that to the reference. Deletions are written
    with their bases. cnt1, cnt2 and cnt_other count reads whose own alignment shows the first, the second or another length.

    Sites and candidates come from the reads' own alignments and from ``proposed``. Scores are kept as files, since they are
    summed by candidate first and by the two chosen then; both sums are made where the rows are before they are dealt.
    """
    found = read_indels(aln, mask)
    sites = reliable(haplotypes(candidates(found, proposed), sequences))
    scores = reliable(scored_reads(aln, sites, found, mask, q_indel, q_indel if gap_extend is None else gap_extend, r_snp))
    sums = scores.select(*SITE, F.posexplode("costs").alias("i", "cost")).groupBy(*SITE, "i").agg(F.sum("cost").alias("cost"))
    order = sums.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("cost", "i"))).alias("o"))
    two = order.filter(F.size("o") > 1).select(*SITE, F.get("o", F.lit(0))["i"].alias("i1"), F.get("o", F.lit(1))["i"].alias("i2"))
    chosen = sites.select(*SITE, "types", "ref", "left").join(two, SITE).select(
        *SITE, "i1", "i2", F.get("types", "i1").alias("t1"), F.get("types", "i2").alias("t2"), F.substr("ref", (F.col("pos0") - F.col("left") + 2).cast("int")).alias("after")
    )
    steps = F.abs(F.col("i1") - F.col("i2")) + 1
    limit = F.floor(q_indel * (1 - F.pow(F.lit(DEPENDENCE), steps)) / (1 - DEPENDENCE))
    told = scores.join(chosen.select(*SITE, "i1", "i2", "t1.length", F.col("t2.length").alias("length2"), limit.alias("limit")), SITE)
    s1, s2 = F.get("costs", "i1"), F.get("costs", "i2")
    per = told.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("depth"),
        F.sum(F.col("mapq") * F.col("mapq")).alias("sq"),
        F.sum(F.when(s1 > s2, F.least(s1 - s2, "limit")).otherwise(0)).alias("g1"),
        F.sum(F.when(s1 > s2, 0).otherwise(F.least(s2 - s1, "limit"))).alias("g2"),
        F.sum((F.col("own") == F.col("length")).cast("long")).alias("cnt1"),
        F.sum(((F.col("own") == F.col("length2")) & (F.col("own") != F.col("length"))).cast("long")).alias("cnt2"),
    )
    prior = int(-SCALE * math.log(r_indel) + 0.5)
    g = per.join(chosen, SITE).withColumn("g3", F.col("depth") * HET_READ + prior)
    none1, none2 = F.col("t1.length") == 0, F.col("t2.length") == 0
    ranked = F.array_sort(F.array(*(F.struct(F.col(c).alias("v"), F.lit(k).alias("k")) for k, c in enumerate(("g1", "g2", "g3")))))
    g = g.withColumn("r", ranked).withColumns({"gt": F.get("r", F.lit(0))["k"], "cons_q": F.get("r", F.lit(1))["v"] - F.get("r", F.lit(0))["v"]})
    ref = F.when(F.col("gt") == 2, F.when(none1, F.col("g1") - F.col("g3")).otherwise(F.col("g2") - F.col("g3")))
    ref = ref.when(F.col("gt") == 0, F.when(none1, 0).otherwise(F.col("g2") - F.col("g1") - prior - HET_READ)).otherwise(F.when(none2, 0).otherwise(F.col("g1") - F.col("g2") - prior - HET_READ))
    text = lambda t: F.when(t["length"] > 0, F.concat(F.lit("+"), t["bases"])).when(t["length"] < 0, F.concat(F.lit("-"), F.substr("after", F.lit(1), -t["length"]))).otherwise("*")
    a1, a2 = text(F.col("t1")), text(F.col("t2"))
    both = F.when(none1 | (~none2 & (F.col("t1.length") < F.col("t2.length"))), F.concat_ws("/", a1, a2)).otherwise(F.concat_ws("/", a2, a1))
    cons = F.when(F.col("gt") == 0, F.concat_ws("/", a1, a1)).when(F.col("gt") == 1, F.concat_ws("/", a2, a2)).otherwise(both)
    q = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")
    return g.select(
        "chrom", (F.col("pos0") + 1).alias("pos1"), F.lit("*").alias("ref"), cons.alias("cons"), q(F.col("cons_q")).alias("cons_q"), q(ref).alias("snp_q"), F.floor(F.sqrt(F.col("sq") / F.col("depth")) + 0.499).cast("int").alias("rms_mapq"),
        "depth", a1.alias("a1"), a2.alias("a2"), "cnt1", "cnt2", (F.col("depth") - F.col("cnt1") - F.col("cnt2")).alias("cnt_other"),
    )
