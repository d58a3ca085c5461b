"""Regions of converted alignments: results of a whole scan, read from few row groups."""

import random

from helixframe.operators.alignments import view_regions
from helixframe.sources import alignments as S


def written(tmp_path, n=40_000):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        pos, skip = rng.randrange(0, 3_000_000), rng.choice([0, 0, 0, 0, 0, 0, 0, 40_000, 300_000])
        rows.append(f"r{k}\t0\tchr{rng.randrange(3)}\t{pos + 1}\t60\t{f'20M{skip}N20M' if skip else '40M'}\t*\t0\t0\t{'ACGT' * 10}\t{'I' * 40}")
    (tmp_path / "a.sam").write_text("\n".join(rows))
    return str(tmp_path / "a.sam")


def scanned(df):
    """Rows that the scan of the files gives to the plan, in the row groups that it reads, after the query ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        for inner in ("plan", "child"):
            if p.nodeName().endswith("QueryStage") and inner == "plan":
                todo.append(p.plan())
        if p.nodeName().startswith("Scan parquet") or "FileScan" in p.toString().split("\n")[0] and p.children().size() == 0:
            if p.metrics().contains("numOutputRows"):
                rows.append((p.metrics().apply("numOutputRows").value(), p.toString()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_regions_prune_row_groups(spark, tmp_path):
    src, dst = written(tmp_path), str(tmp_path / "pq")
    S.convert_alignments(spark, src, dst, row_group_bytes=64 << 10)
    all_ = spark.read.parquet(dst)
    assert all_.count() == 40_000 and {r.reach for r in all_.select("reach").distinct().collect()} <= set(S.REACHES)
    for regions in ([("chr1", 1_000_000, 1_010_000)], [("chr0", 5, 6), ("chr2", 2_500_000, 2_600_000), ("chr2", 2_550_000, None)], [("chr7", 0, 10)], ["chr1:1,000,001-1,010,000"], [("chr1", 100, 100)]):
        df = S.fetch_regions(spark, dst, regions)
        bounds = [("chr1", 1_000_000, 1_010_000)] if isinstance(regions[0], str) else regions
        want = view_regions(all_, spark.createDataFrame(bounds, "chrom string, start0 long, end1 long"))
        cols = ["qname", "r_start0", "r_end1"]
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    df = S.fetch_regions(spark, dst, [("chr1", 1_000_000, 1_010_000)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bin14" in plan[plan.index("PushedFilters") :] and "PartitionFilters: [" in plan
    (read, _), *_ = scanned(df)
    assert df.count() < read < 40_000 / 4


def test_more_regions_than_are_pushed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PUSHED_REGIONS", 2)
    src, dst = written(tmp_path, 3000), str(tmp_path / "pq")
    S.convert_alignments(spark, src, dst)
    regions = [("chr1", 1000 * k, 1000 * k + 500) for k in range(40)] + [("chr2", 2_900_000, 2_950_000)]
    want = view_regions(spark.read.parquet(dst), spark.createDataFrame(regions, "chrom string, start0 long, end1 long"))
    got = S.fetch_regions(spark, dst, regions)
    assert sorted((r.qname, r.r_start0) for r in got.collect()) == sorted((r.qname, r.r_start0) for r in want.collect())


def test_tags_and_bins_are_told_once_a_row(spark, tmp_path):
    tags = "NM:i:1\tXX:Z:a\tNM:i:2\tbad\tXY:Z:"
    (tmp_path / "b.sam").write_text(f"r1\t0\tchr1\t16384\t60\t5S1M16384N1M2I1D\t*\t0\t0\tACGT\tIIII\t{tags}\nr2\t0\tchr1\t1\t60\t*\t*\t0\t0\tA\tI\n")
    aln = S.read_sam(spark, str(tmp_path / "b.sam"))[0]
    rows = S.binned(aln)
    r1, r2 = rows.orderBy("qname").collect()
    assert {k: tuple(v) for k, v in r1.aux.items()} == {"NM": ("i", "1"), "XX": ("Z", "a"), "XY": ("Z", "")} and r2.aux == {}
    assert (r1.bin14, r1.reach, r2.bin14, r2.reach) == (0, 2, 0, 0)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_extract_all") == 1
