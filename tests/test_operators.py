import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions import alignment as L
from helixframe.functions import bounds as B
from helixframe.functions import sequence as X
from helixframe.operators import annotation as A
from helixframe.operators import events as E
from helixframe.operators import intervals as I
from helixframe.operators import quantify as Q
from helixframe.operators import scans


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.reverse_complement(lit("ACGTNa"))) == "tNACGT"
    assert one(spark, X.normalize_bases(lit("acguRx"))) == "ACGTNN"
    assert one(spark, X.split_nonempty(lit("a,,b,"), ",")) == ["a", "b"]
    assert one(spark, X.replace_last(lit("a.b.c"), ".", "-")) == "a.b-c" and one(spark, X.replace_last(lit("abc"), ".", "-")) == "abc"
    assert one(spark, X.common_prefix(lit("abcd"), lit("abxd"))) == "ab" and one(spark, X.common_prefix(lit(""), lit("a"))) == ""
    assert one(spark, X.strip(lit(" \ta b\n"))) == "a b" and one(spark, X.escape_text(lit('a\t"\\'))) == 'a\\t\\"\\\\'
    assert sorted(one(spark, X.shuffle_characters(lit("hello")))) == sorted("hello")
    assert one(spark, X.parse_int(lit("x"))) is None and one(spark, X.parse_float(lit("1.5"))) == 1.5
    assert one(spark, X.iupac_of(lit("AG"))) == "R" and one(spark, X.bases_of(lit("k"))) == "GT"


def test_bound_functions(spark):
    r = one(spark, B.parse_region(F.lit("chr1:1,000-2,000")))
    assert tuple(r) == ("chr1", 999, 2000)
    assert tuple(one(spark, B.parse_region(F.lit("chr1")))) == ("chr1", 0, None) and tuple(one(spark, B.parse_region(F.lit("c:5")))) == ("c", 4, None)
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, B.overlap_bound(n(1), n(5), n(5), n(9))) is None and tuple(one(spark, B.overlap_bound(n(1), n(5), n(4), n(9)))) == (4, 5)
    for s, e in ((0, 1), (16383, 16385), (1 << 20, (1 << 20) + 5), (0, 1 << 28)):
        b = one(spark, B.bin_of(n(s), n(e)))
        assert b in one(spark, B.candidate_bins(n(s), n(e)))


def test_alignment_functions(spark):
    c = L.parse_cigar(F.lit("3S10M2I4D5N6M1H"))
    assert [one(spark, f(c)) for f in (L.reference_length, L.query_length, L.alignment_length)] == [25, 21, 18]
    assert one(spark, L.parse_cigar(F.lit("*"))) == []
    assert one(spark, L.flag_letters(F.lit(1 | 16 | 64 | 1024))) == "pr1d"
    assert one(spark, L.quality_sum(L.decode_quality(F.lit("I!0")))) == 40 + 15
    assert one(spark, L.solexa_to_sanger(F.array(F.lit(-5), F.lit(40), F.lit(120)))) == [1, 40, 93]


def intervals(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start0 long, end1 long")


def test_scans_over_stretches(spark):
    import random

    rng = random.Random(1)
    pos = rng.sample(range(500), 80)
    df = spark.createDataFrame([("a", p, rng.randrange(9)) for p in pos], "chrom string, start0 long, v long")
    rows = sorted(map(tuple, df.select("start0", "v").collect()))
    nx = {r.start0: r.n for r in scans.next_position(df, ["chrom"], "start0", "n", 16).collect()}
    mx = {r.start0: r.n for r in scans.running_max_before(df, ["chrom"], ["start0"], "v", "n", 16).collect()}
    sm = {r.start0: r.n for r in scans.running_sum(df, ["chrom"], ["start0"], "v", "n", 16).collect()}
    for i, (p, _) in enumerate(rows):
        assert nx[p] == (rows[i + 1][0] if i + 1 < len(rows) else None)
        assert mx[p] == max((v for _, v in rows[:i]), default=None)
        assert sm[p] == sum(v for _, v in rows[: i + 1])


def test_interval_sets(spark):
    a = intervals(spark, [("c", 0, 10), ("c", 10, 20), ("c", 30, 40), ("c", 35, 50)])
    assert sorted(tuple(r) for r in I.merge_bounds(a).collect()) == [("c", 0, 10), ("c", 10, 20), ("c", 30, 50)]
    assert sorted((r.start0, r.end1, r.n) for r in I.islands(a, ["chrom"]).collect()) == [(0, 20, 2), (30, 50, 2)]
    b = intervals(spark, [("c", 2, 4), ("c", 6, 8), ("c", 45, 60)])
    assert sorted((r.start0, r.end1) for r in I.subtract(a, b).collect()) == [(0, 2), (4, 6), (8, 10), (10, 20), (30, 40), (35, 45)]
    assert sorted((r.start0, r.end1) for r in I.intersect(a, b).collect()) == [(2, 4), (6, 8), (45, 50)]
    assert {(r.start0, r.end1): r.overlap for r in I.set_overlap_length(a, b).collect()} == {(0, 10): 4, (10, 20): 0, (30, 40): 0, (35, 50): 5}
    assert I.merge_bounds(a.limit(0)).count() == 0
    wide = intervals(spark, [("c", 0, 100_000)]).select("chrom", F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1"))
    assert I.overlap_join(a, wide).count() == 4


def test_hand_drawn_splicing(spark):
    # t1: A-B-C, t2: A-C, t3: A-B2-C with a longer donor of A
    rows = [("t1", 1, 0, 10), ("t1", 1, 20, 30), ("t1", 1, 40, 50), ("t2", 1, 0, 10), ("t2", 1, 40, 50), ("t3", 1, 0, 12), ("t3", 1, 40, 50)]
    occ = spark.createDataFrame([(t, g, "c", "+", s, e) for t, g, s, e in rows], "tx_id string, gene_id long, chrom string, strand string, start0 long, end1 long")
    lx = occ.select(F.col("gene_id").alias("locus"), "chrom", "strand", "start0", "end1").distinct()
    j = A.gene_junctions(occ).withColumnRenamed("gene_id", "locus")
    g = E.bound_groups(lx)
    assert {(r.start0, r.end1): (r.left_group, r.right_group) for r in g.collect()} == {(0, 10): (1, 1), (0, 12): (1, 1), (20, 30): (2, 2), (40, 50): (3, 3)}
    ev = E.aep_events(E.splice_paths(j, 2), g)
    assert {(r.exc[0].end1, r.inc[1].start0) for r in ev.collect()} == {(10, 20), (12, 20)}
    assert E.drop_iso_bound(ev).count() == 2
    ss = E.a53ss_events(j, g).collect()
    assert [(r.type, r.short.end1, r.long.end1) for r in ss] == [("A5SS", 10, 12)]
    minus = E.a53ss_events(j.withColumn("strand", F.lit("-")), g)
    assert [r.type for r in minus.collect()] == ["A3SS"]
    term = E.bound_groups(lx, terminal=True, junctions=j)
    assert {(r.start0, r.end1): (r.left_group, r.right_group) for r in term.collect()} == {(0, 10): (0, 1), (0, 12): (0, 1), (20, 30): (2, 2), (40, 50): (3, 0)}
    with pytest.raises(ValueError):
        E.aep_events(E.splice_paths(j, 2), g, (2, 2), (1, 1))


def test_bayes_psi(spark):
    def plain(el, en, cl, cn):
        rate = el * cn / cl
        p = [math.exp(-rate * i / 100) * (rate * i / 100) ** en for i in range(101)]
        return sum(x * i / 100 for i, x in enumerate(p)) / sum(p)

    for args in ((100, 7, 200, 30), (50, 0, 100, 10), (300, 40, 100, 12)):
        assert abs(one(spark, E.bayes_psi(*(F.lit(x) for x in args))) - plain(*args)) < 1e-9
    assert one(spark, E.bayes_psi(F.lit(0), F.lit(1), F.lit(5), F.lit(5))) is None and one(spark, E.naive_psi(F.lit(10), F.lit(5), F.lit(10), F.lit(0))) is None


def test_utr_isoforms(spark):
    df = spark.createDataFrame([(1, 1, 0, 100, 10), (1, 1, 1, 50, 10), (1, 1, 2, 10, 10)], "gene_id long, run long, idx long, n_reads long, n_positions long")
    got = {r.idx: (r.bits, round(r.psi, 9), r.cum_reads) for r in E.utr_isoforms(df).collect()}
    assert got == {0: ("100", 0.5, 100), 1: ("110", 0.4, 150), 2: ("111", 0.1, 160)}


def test_window_significance_orders_windows(spark):
    reads = spark.createDataFrame([("c", i * 50) for i in range(200)] + [("c", 5000 + i) for i in range(60)], "chrom string, pos0 long")
    for method in ("naus", "approx33", "alm"):
        p = {r.start0: r.p for r in Q.window_significance(reads, 500, method=method).collect()}
        assert p[5000] < 1e-6 and all(0 <= x <= 1 for x in p.values()) and p[0] > 0.5


def test_loci_by_links(spark):
    rows = [(1, "a", 0, 10, "+"), (2, "b", 0, 10, "+"), (3, "c", 0, 10, "-"), (4, "d", 5, 20, "+"), (5, "b", 90, 99, "+")]
    occ = spark.createDataFrame([(t, g, "c", k, s, e) for t, g, s, e, k in rows], "tx_id long, gene_id string, chrom string, strand string, start0 long, end1 long")
    label = lambda **k: {r.tx_id: r.locus for r in A.loci(occ, **k).collect()}
    assert label() == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
    assert label(by_exon=True) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert label(by_name=False, by_group=True) == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_collapse_wig(spark):
    rows = [("c", 0, 10, 100.0), ("c", 15, 25, 20.0), ("c", 60, 70, 5.0), ("c", 200, 210, 90.0), ("c", 216, 226, 30.0), ("c", 232, 242, 95.0), ("d", 0, 5, 1.0)]
    df = spark.createDataFrame(rows, "chrom string, start0 long, end1 long, score double")
    got = sorted(map(tuple, I.collapse_wig(df, (80, 5), [(10, 15, 1), (40, 50, 2)]).collect()))
    assert got == [("c", 0, 25, 120.0), ("c", 200, 242, 215.0)]
    assert I.collapse_wig(df, (80, 5), [(10, 15, 1)], min_length=30).count() == 1


def test_event_sequences(spark):
    ex = lambda *p: list(p)
    schema = f"event_id int, chrom string, strand string, exc {E.EXON}, inc {E.EXON}"
    df = spark.createDataFrame([(1, "c", "+", ex((0, 2), (8, 10)), ex((0, 2), (4, 6), (8, 10))), (2, "c", "-", ex((0, 2), (8, 10)), ex((0, 2), (4, 6), (8, 10)))], schema)
    seqs = spark.createDataFrame([("c", 0, "AACCGTTTGA")], "contig string, chunk int, seq string")
    got = {r.event_id: (r.exc_seq, r.inc_seq, r.inc_up, r.inc_down) for r in E.event_sequences(df, seqs, 2, 1).collect()}
    assert got == {1: ("AA|GA", "AA|GT|GA", "CC"[0:2], "T"), 2: ("TC|TT", "TC|AC|TT", "AA", "G")}


def test_collapse_linear_runs(spark):
    # 0-1-2 in a row, 2 branches to 3 and 4, both go to 5, 5-6 in a row
    rows = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6)]
    df = spark.createDataFrame([("c", a * 10, a * 10 + 10, b * 10, b * 10 + 10) for a, b in rows], "chrom string, start0 long, end1 long, next_start0 long, next_end1 long")
    got = {r.start0: r.run0 for r in E.collapse_linear(df).collect()}
    assert got == {0: 0, 10: 0, 20: 0, 30: 30, 40: 40, 50: 50, 60: 50}
    assert {(r.start0, r.end1, r.score) for r in E.graph_bed(E.collapse_linear(df)).collect()} == {(0, 30, 3), (30, 40, 1), (40, 50, 1), (50, 70, 2)}


def test_recombined_junctions_of_a_large_locus(spark):
    rows = [(1, "c", "+", 10 * i, 10 * i + 5) for i in range(1200)]
    out = E.recombined_junctions(spark.createDataFrame(rows, "locus long, chrom string, strand string, start0 long, end1 long"))
    assert out.count() == 1200 * 1199 // 2
