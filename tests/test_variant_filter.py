"""The cascade of dense SNPs: one ordered scan, whatever the chain's length."""

import random

from helixframe.operators import variant_filter as V

CNS = "chrom string, pos1 long, ref string, cons string, cons_q int, snp_q int, rms_mapq int, depth int, a1 string, a2 string, cnt1 int, cnt2 int"


def snp(chrom, pos, mapq=60):
    return (chrom, pos, "A", "G", 50, 50, mapq, 20, "*", "*", 0, 0)


def jobs(spark, rows):
    """How many jobs the filter takes, and its reasons."""
    tracker, group = spark.sparkContext.statusTracker(), f"filter-{len(rows)}-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = {(r.chrom, r.pos1): r.reason for r in V.variant_filter(spark.createDataFrame(rows, CNS)).collect()}
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("none", "")
    return n, out


def dense(positions, low, width=10, most=2):
    """Places that are dense: by the order of places, each with the counted ones before it."""
    counted, out = [], set()
    for p in positions:
        k = sum(p - width <= x for x in counted)
        if k >= most:
            out.add(p)
        if k >= most or p not in low:
            counted.append(p)
    return out


def test_long_chains_take_as_many_jobs_as_short_ones(spark):
    chain = lambda n: [snp("c", 100 + 5 * k, 60 if k < 2 else 10) for k in range(n)]
    few, short = jobs(spark, chain(10))
    many, long = jobs(spark, chain(1000))
    assert set(long.values()) == {"W"} and set(short.values()) == {"W"}
    assert many <= few + 2  # only the scan's own sizes may differ


def test_cascade_against_a_plain_scan(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in ("c1", "c2"):
        at, places, low = 0, [], set()
        for _ in range(400):
            at += rng.choice([1, 3, 4, 6, 9, 11, 30])
            places.append(at)
            if rng.random() < 0.5:
                low.add(at)
        rows += [snp(c, p, 10 if p in low else 60) for p in places]
        own = dense(places, low)
        for p in places:
            near = any(x in own and p < x <= p + 10 for x in places)
            want[c, p] = "W" if p in own or (near and p not in low) else "Q" if p in low else ""
    _, got = jobs(spark, rows)
    assert got == want and set(want.values()) == {"W", "Q", ""}
