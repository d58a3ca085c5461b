"""Indel genotypes by realignment, against alignments and genotypes worked out plainly."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import indels as N
from helixframe.operators.variants import read_indels

ALN = "ordinal long, rname string, pos0 long, cigar string, flag int, mapq int, seq string, qual string"


def plain_cost(read, qual, hap, offset, band, gap_open, gap_extend, most):
    """The least cost of the read in the haplotype by a table of all places, gaps of every length tried in turn."""
    n, m = len(read), len(hap)
    far = N._FAR
    ok = lambda i, j: 0 <= j <= m and abs(j - i - offset) <= band
    t = [[0 if i == 0 and ok(0, j) else far for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            if not ok(i, j):
                continue
            best = far
            if j and ok(i - 1, j - 1):
                best = t[i - 1][j - 1] + (0 if hap[j - 1] in (read[i - 1], ord("N")) else min(max(qual[i - 1] - 33, 0), most))
            for k in range(1, i + 1):
                if ok(i - k, j):
                    best = min(best, t[i - k][j] + gap_open + gap_extend * (k - 1))
            t[i][j] = best
        for j in range(m + 1):
            for k in range(1, j + 1):
                if ok(i, j) and ok(i, j - k):
                    t[i][j] = min(t[i][j], t[i][j - k] + gap_open + gap_extend * (k - 1))
    return min(t[n][j] for j in range(m + 1) if ok(n, j)) if n else 0


def test_costs_are_those_of_the_whole_table():
    rng = random.Random(1)
    seq = lambda n: bytes(rng.choice(b"ACGTN" if rng.random() < 0.1 else b"AC") for _ in range(n))
    for gap in ((40, 40), (20, 5), (7, 7)):
        reads, quals, haps, offsets = [], [], [], []
        for _ in range(40):
            hap = seq(rng.randint(6, 24))
            a = rng.randint(0, 4)
            read = bytearray(hap[a : a + rng.randint(1, 16)])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(read) + 1)
                read[at : at + rng.randint(0, 2)] = seq(rng.randint(0, 2))
            read = bytes(read) or b"A"
            reads.append(read)
            quals.append(bytes(rng.randint(33, 80) for _ in read))
            haps.append(hap)
            offsets.append(a)
        for band in (3, 12):
            got = N.banded_costs(reads, quals, haps, np.array(offsets), band, *gap, 30)
            want = [plain_cost(r, q, h, o, band, *gap, 30) for r, q, h, o in zip(reads, quals, haps, offsets, strict=True)]
            assert [min(x, N._FAR) for x in got.tolist()] == [min(x, N._FAR) for x in want]


def simulate(rng, ref, site, genotype, depth, first, error=0.01):
    """Reads of 60 bases over a site, half of each of two alleles (a negative length or inserted bases); some show no indel though they have it."""
    rows = []
    for k in range(depth):
        allele = genotype[k % 2]
        start = site - rng.randint(8, 50)
        m = site + 1 - start
        if isinstance(allele, str) and allele:
            bases, cigar = ref[start : site + 1] + allele + ref[site + 1 :], f"{m}M{len(allele)}I{60 - m - len(allele)}M"
        elif allele:
            bases, cigar = ref[start : site + 1] + ref[site + 1 - allele :], f"{m}M{-allele}D{60 - m}M"
        else:
            bases, cigar = ref[start:], "60M"
        bases = "".join(rng.choice("ACGT") if rng.random() < error else b for b in bases[:60])
        if m > 52 - (len(allele) if isinstance(allele, str) else 0):
            cigar = "60M"  # too near the end for the aligner to have opened a gap
        rows.append((first + k, "c", start, cigar, 0, 60, bases, "I" * 60))
    return rows


def test_genotypes_of_simulated_sites(spark):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(6000))
    truth, rows = {}, []
    for k, genotype in enumerate([(0, -3), (-2, -2), ("GATT", 0), ("CA", "CA"), (-1, -4), (0, 0), ("TTG", 0), (-8, 0)]):
        site = 300 + 600 * k
        truth[site] = genotype
        rows += simulate(rng, ref, site, genotype, 30, len(rows))
    rows += [(9000 + k, "c", 3300 - 20, "21M1D39M", 0, 60, ref[3280:3301] + ref[3302:3341], "I" * 60) for k in range(1)]  # one stray read where nothing is
    rows += [(9500, "c", 3310, "60M", 4, 60, ref[3310:3370], "I" * 60), (9501, "c", 290, "10S20M500N30M", 0, 60, "A" * 10 + ref[290:310] + ref[810:840], "I" * 60)]
    aln = spark.createDataFrame(rows, ALN)
    seqs = spark.createDataFrame([("c", 0, ref.lower())], "contig string, chunk int, seq string")
    got = {r.pos1 - 1: r for r in N.realigned_indels(aln, seqs).collect()}
    name = lambda site, a: f"+{a}" if isinstance(a, str) and a else f"-{ref[site + 1 : site + 1 - a]}" if a else "*"
    for site, genotype in truth.items():
        r = got[site]
        assert set(r.cons.split("/")) == {name(site, a) for a in genotype}, (site, genotype, r)
        assert r.depth == r.cnt1 + r.cnt2 + r.cnt_other and r.rms_mapq == 60 and r.cons_q > 0
        assert (r.snp_q > 0) == any(genotype)
    assert got[300].depth == 31  # the read that ends in a skip counts up to it
    near_end = [r for r in rows if abs(r[2] - 300) < 52 and r[3] == "60M"]
    assert near_end and got[300].cnt1 + got[300].cnt2 >= 30


def test_scores_and_sums(spark):
    """Depth, counts, likelihoods and alleles follow from the scores as stated."""
    rng = random.Random(3)
    ref = "".join(rng.choice("AC") for _ in range(400))
    rows = simulate(rng, ref, 150, (0, -2), 9, 0, 0.05) + simulate(rng, ref, 150, ("ACA", "ACC"), 6, 50, 0.05) + simulate(rng, ref, 20, (-1, 0), 5, 100)
    rows = [r if r[2] >= 0 else (*r[:2], 0, "60M", *r[4:6], ref[:60], r[7]) for r in rows]
    aln = spark.createDataFrame(rows, ALN)
    seqs = spark.createDataFrame([("c", 0, ref)], "contig string, chunk int, seq string")
    found = read_indels(aln)
    sites = N.haplotypes(N.candidates(found, spark.createDataFrame([("c", 300, 2), ("c", 150, -2)], "chrom string, pos0 int, length int")), seqs)
    held = {r.pos0: r for r in sites.collect()}
    assert [(t.length, t.bases) for t in held[300].types] == [(0, ""), (2, "NN")]
    assert [t.length for t in held[150].types] == [-2, 0, 3] and held[150].types[2].bases in ("ACA", "ACC")
    assert held[150].haps[1] == ref[100:151] + "NN" + ref[153:254] and held[150].haps[0] == ref[100:151] + ref[153:254]
    each = {}
    for r in N.scored_reads(aln, sites, found).collect():
        each.setdefault(r.pos0, []).append(r)
    for r in N.realigned_indels(aln, seqs).collect():
        own, site = each[r.pos1 - 1], held[r.pos1 - 1]
        total = sorted((sum(x.costs[i] for x in own), i) for i in range(len(site.types)))
        i1, i2 = total[0][1], total[1][1]
        limit = math.floor(40 * (1 - 0.9 ** (abs(i1 - i2) + 1)) / 0.1 + 1e-9)
        g1 = sum(min(x.costs[i1] - x.costs[i2], limit) for x in own if x.costs[i1] > x.costs[i2])
        g2 = sum(min(x.costs[i2] - x.costs[i1], limit) for x in own if x.costs[i1] <= x.costs[i2])
        v = sorted([g1, g2, 3 * len(own) + 38])
        assert r.cons_q == min(255, v[1] - v[0]) and r.depth == len(own)
        assert r.cnt1 == sum(x.own == site.types[i1].length for x in own) and r.cnt2 == sum(x.own == site.types[i2].length for x in own)
    assert N.realigned_indels(aln.limit(0), seqs).count() == 0


def test_segments_end_at_skips(spark):
    df = spark.createDataFrame([(0, "c", 5, "3S4M2D3M10N6M1I2M", 0, 60, "A" * 19, "I" * 19), (1, "c", 5, "*", 0, 60, "A", "I"), (2, "c", 5, "5N4M", 0, 60, "AAAA", "IIII")], ALN)
    got = {(r.ordinal, r.s0): (r.e1, [tuple(x) for x in r.segment]) for r in N.read_segments(df).collect()}
    assert got == {(0, 5): (14, [(5, 9, 3, "M"), (9, 11, 7, "D"), (11, 14, 7, "M")]), (0, 24): (32, [(24, 30, 10, "M"), (30, 32, 17, "M")]), (2, 10): (14, [(10, 14, 0, "M")])}
    assert N.read_segments(df).filter(F.col("s0") > F.col("e1")).count() == 0
