"""Likelihoods and consensus calls speak for reads of every CIGAR."""

import collections
import math
import os
import re

import pytest

from helixframe.operators import variants as V
from helixframe.plans import registry
from helixframe.plans.queries_alignments import with_bases

DIR = "/root/testdata/sf0.001"


def brute(reads):
    sites = collections.defaultdict(list)
    for r in reads:
        if r.flag & 1796:
            continue
        at, q = r.pos0, 0
        for n, op in re.findall(r"(\d+)(\D)", r.cigar):
            for _ in range(int(n)):
                if op in "MD":
                    sites[r.rname, at].append((r.seq[q] if op == "M" else None, bool(r.flag & 16), ord(r.qual[q]) - 33 if op == "M" else 0, r.mapq, r.ordinal))
                at, q = at + (op in "MDN"), q + (op in "MIS")
    out = {}
    for site, rows in sites.items():
        err, n, rank = collections.Counter(), collections.Counter(), collections.Counter()
        each = [(b, m, 4 if min(q, mq) < 4 and q > 0 else min(q, mq), q, o) for b, m, q, mq, o in rows if b]
        for b, m, w, _, _ in sorted(each, key=lambda x: (-x[2], -x[3], x[4])):
            k = rank[b, m]
            rank[b, m] += 1
            if w > 0:
                err[b] += w * (1.0 if k == 0 else 0.85**k * 0.97 + 0.03)
                n[b] += 1
        v = [sum(err[b] for b in "ACGT" if b not in g) + (V.SCALE * math.log(2) * (n[g[0]] + n[g[1]]) if g[0] != g[1] else 0) for g in V.GENOTYPES]
        out[site] = (len(rows), [x - min(v) for x in v])
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_likelihoods_and_consensus_against_brute_force(spark):
    aln = with_bases(spark, DIR)
    want = brute(aln.collect())
    assert len({r.cigar for r in aln.select("cigar").distinct().collect()}) == 5
    q = registry.queries()
    got = {(r.chrom, r.pos0): r for r in q["c01_genotype_likelihoods"](spark, DIR).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        depth, v = want[k]
        assert r.depth == depth and all(abs(a - min(b, 255)) <= 0.5 + 1e-6 for a, b in zip(r.lk, v, strict=True)), (k, r, v)
    maq = {(r.chrom, r.pos0): r.depth for r in q["c01_genotype_likelihoods_maq"](spark, DIR).collect()}
    assert maq == {k: d for k, (d, _) in want.items()}
    prior = V.heterozygote_prior()
    for r in q["c02_consensus"](spark, DIR).collect():
        k = (r.chrom, r.pos0)
        ranked = sorted((x + (prior if g[0] != g[1] else 0), i, g) for i, (x, g) in enumerate(zip(got[k].lk, V.GENOTYPES, strict=True)))
        assert r.depth == want[k][0] and r.cons == V.bases_of.__globals__["IUPAC"].get("".join(sorted(set(ranked[0][2]))), "N")


def test_likelihoods_are_dealt_as_stretches_and_told_in_batches(spark):
    """Behind one shuffle of stretches; depths beyond 255 and 256 equal bases; qualities of either strand apart."""
    plan = V.genotype_likelihoods(V.site_elements(with_bases(spark, DIR)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan
    rows = [("c", 5, i, "A" if i % 3 else "C", i % 2 == 0, 5 + i % 40, 30) for i in range(2000)] + [("c", 6, 0, None, True, 0, 9)]
    e = spark.createDataFrame(rows, "chrom string, pos0 long, ordinal long, base string, minus boolean, base_q int, mapq int")
    err = {}
    for b in "AC":
        for m in (True, False):
            qs = sorted((min(x[5], 30) for x in rows if x[3] == b and x[4] == m), reverse=True)
            err[b] = err.get(b, 0) + sum(q * (0.85 ** min(k, 255) * 0.97 + 0.03) for k, q in enumerate(qs))
    got = {r.pos0: r for r in V.genotype_likelihoods(e).collect()}
    want = {"AA": err["C"], "CC": err["A"], "AC": 4.343 * math.log(2) * 255, "GG": err["A"] + err["C"]}
    for g, v in want.items():
        assert abs(got[5].lk[V.GENOTYPES.index(g)] - min(255, v - min(want.values()))) <= 4, (g, v, got[5])
    assert got[6].depth == 1 and got[6].lk == [0] * 10
