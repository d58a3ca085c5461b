"""Events whose junctions carry groups and counts, against the joins that look them up."""

import random

from pyspark.sql import functions as F

from helixframe.operators import events as E

BOUNDS = "locus long, chrom string, strand string, start0 long, end1 long"


def tables(spark):
    rng = random.Random(5)
    exons, jnx = set(), set()
    for locus in range(12):
        for _ in range(6):
            tx = [(k * 100 + rng.choice([0, 10]), k * 100 + 50 + rng.choice([0, 10])) for k in range(5) if rng.random() < 0.8]
            exons |= {(locus, "c", "+-"[locus % 2], *x) for x in tx}
            jnx |= {(locus, "c", "+-"[locus % 2], *a, *b) for a, b in zip(tx, tx[1:], strict=False)}
    lx = spark.createDataFrame(sorted(exons), BOUNDS)
    j = spark.createDataFrame(sorted(jnx), BOUNDS + ", next_start0 long, next_end1 long")
    xc = lx.select("locus", "start0", "end1", (F.col("start0") % 7).alias("n_reads"), (F.col("end1") - F.col("start0")).alias("n_positions"))
    # some junctions aren't counted, and some have no reads
    jc = j.select("locus", "end1", "next_start0").distinct().filter("(end1 + next_start0) % 3 > 0").withColumns({"n_reads": F.col("end1") % 4, "n_positions": F.lit(32).cast("long")})
    return lx, j, xc, jc


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_carried_counts_are_the_joined_ones(spark):
    lx, j, xc, jc = tables(spark)
    groups = E.bound_groups(lx)
    for steps in (((1, 1), (2, 2)), ((2, 2), (2, 2)), ((1, 2), (2, 3))):
        joined = E.quantify(E.aep_events(E.splice_paths(j, steps[1][1]), groups, *steps).withColumn("event_id", F.xxhash64("locus", "exc", "inc")), xc, jc).drop("event_id")
        counted = groups.join(xc, ["locus", "start0", "end1"])
        carried = E.quantify_carried(E.aep_events(E.grouped_paths(E.grouped_junctions(j, counted, jc), steps[1][1]), None, *steps))
        assert set(carried.columns) == set(joined.columns)
        want = rows(joined, joined.columns)
        assert len(want) > 20 and rows(carried, joined.columns) == want


def test_groups_take_one_shuffle(spark):
    """Boundaries were made distinct, swept and joined to both sides of the exons, in five shuffles."""
    lx = spark.range(50).select(F.floor(F.col("id") / 25).alias("locus"), F.lit("c").alias("chrom"), F.lit("+").alias("strand"), (F.col("id") * 10).alias("start0"), (F.col("id") * 10 + 15).alias("end1"))
    plan = E.bound_groups(lx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    told = {(r.start0, r.left_group, r.right_group) for r in E.bound_groups(lx.limit(3)).collect()}
    assert told == {(0, 1, 1), (10, 1, 2), (20, 2, 2)}
