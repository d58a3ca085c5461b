"""What the plans of queries on many rows shuffle."""

import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def exchanges(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan), plan


def test_reads_on_tags_are_made_behind_the_shuffle(spark):
    for name in ("a08_junction_density", "j02_reads_to_tag_blocks"):
        keys, plan = exchanges(spark, name)
        assert "Generate explode" in plan and not any("pos0" in k for k in keys)


def test_tags_alone_on_their_junction_are_not_cut_into_windows(spark):
    from helixframe.operators import junction_tags as J

    block, path = "struct<start0:bigint,end1:bigint>", "struct<left_path:array<struct<start0:bigint,end1:bigint>>,right_path:array<struct<start0:bigint,end1:bigint>>>"
    rows = [("c", "+", [(0, 10)], [(k, k + 10)], [([(0, 10)], [(k, k + 10)])]) for k in (20, 40)] + [("c", "+", [(5, 10)], [(40, 50)], [([(5, 10)], [(40, 50)])]), ("c", "-", [(0, 4), (2, 10)], [(20, 30)], [])]
    tags = spark.createDataFrame(rows, f"chrom string, strand string, `left` array<{block}>, `right` array<{block}>, exon_paths array<{path}>")
    out = J.resolve_shared(tags, 8)
    got = sorted((r.strand, r.acceptor, r.nth, tuple(map(tuple, r.blocks)), r.n_tags, r.n_windows, len(r.exon_paths)) for r in out.collect())
    assert got[:3] == [("+", 20, 1, ((0, 10), (20, 30)), 1, 13, 1), ("+", 40, 1, ((5, 10), (40, 50)), 2, 8, 2), ("+", 40, 2, ((0, 10), (40, 42)), 1, 5, 1)]
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Generate" not in plan.children().head().toString()


def test_tags_are_shuffled_before_they_are_cut_into_windows(spark):
    import random
    import re

    from helixframe.operators import events as E

    rng, rows = random.Random(3), []
    for _ in range(200):
        at, blocks = rng.randrange(5), []
        for _ in range(rng.randrange(1, 6)):
            blocks.append((at, at + rng.choice([0, 1, 2, 3, 5, 9])))
            at = blocks[-1][1] + rng.choice([0, 1, 5])
        rows.append((rng.randrange(150), f"c{rng.randrange(2)}", blocks))
    want = {}
    for tag, chrom, blocks in rows:
        bases = [p for a, z in blocks for p in range(a, z)]
        spans, here = [], 0
        for a, z in blocks:
            spans.append((here, here + z - a, a))
            here += z - a
        for o in range(len(bases) - 4):
            window = tuple((a + max(o - s, 0), min(a + e - s, a + o + 5 - s)) for s, e, a in spans if s < o + 5 and e > o)
            if len(window) > 1:
                want.setdefault((chrom, window), set()).add(tag)
    df = E.shared_windows(spark.createDataFrame(rows, "tag_id long, chrom string, blocks array<struct<start0:bigint,end1:bigint>>"), 5)
    assert {(r.chrom, tuple(map(tuple, r.window))): (r.n_tags, r.tag_id) for r in df.collect()} == {k: (len(v), min(v)) for k, v in want.items()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: [m.start() for m in re.finditer("Generate explode", plan)][0]]
