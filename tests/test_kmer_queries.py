"""Queries on k-mers do their whole job."""

import random

import pyarrow as pa
import pytest

from helixframe.operators import packed_kmers as P
from helixframe.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_kmers_are_sorted(spark):
    q = registry.queries()
    rows = q["t04_sort_kmers"](spark, SF)
    assert rows.count() == q["m01_kmer_rows"](spark, SF).count() == sum(r.n for r in q["m01_kmers"](spark, SF).collect())
    assert {r.c for r in rows.selectExpr("left(kmer, 1) AS c").distinct().collect()} >= set("ACGT")
    assert all("LIKE" not in registry.oracle_sql()[name] for name in ("t04_sort_kmers", "t04_sort_kmers_whole"))


def test_chunks_are_shuffled_once_and_kmers_dealt_packed(spark):
    """The bases that follow a chunk come with it, not by a join with all chunks; counts deal different k-mers packed."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan("m01_kmer_rows").count("Exchange hashpartitioning") == 1 and "Join" not in plan("m01_kmer_rows")
        counts = plan("m01_kmers")
        assert counts.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(bucket" in counts and "Join" not in counts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("k", [1, 4, 16, 30])
def test_counts_however_few_kmers_are_held(k, monkeypatch):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "AC") for _ in range(n)) for n in (0, 3, 40, 90, 200, 31)] * 2
    want = {s[i : i + k] for s in seqs for i in range(len(s) - k + 1)}
    rows = pa.RecordBatch.from_arrays([pa.array(["c"] * len(seqs)), pa.array([100 * i for i in range(len(seqs))]), pa.array([s.encode() for s in seqs])], names=["contig", "start", "seq"])
    for held in ({}, {"BASES": 50, "PENDING": 8, "HELD": 30}):
        for name, value in held.items():
            monkeypatch.setattr(P, name, value)
        dealt = sorted((r for b in P._dealt_different(iter([rows]), k) for r in b.to_pylist()), key=lambda r: r["bucket"])
        (got,) = [r for b in P._counted(iter([pa.RecordBatch.from_pylist(dealt)]), k) for r in b.to_pylist()]
        n = sum(max(0, len(s) - k + 1) for s in seqs)
        assert got == {"n": n, "n_distinct": len(want), "pos_sum": sum(100 * j + i + 1 for j, s in enumerate(seqs) for i in range(len(s) - k + 1))}


@pytest.mark.parametrize("k", [1, 3, 16, 30])
def test_kmers_are_in_order_over_all_ranges(spark, k, monkeypatch):
    """Ranges that end inside equal k-mers, and stretches in several folds."""
    monkeypatch.setattr(P, "SAMPLED", 8)
    monkeypatch.setattr(P, "FILLED", 3)
    rng = random.Random(k)
    seqs = {f"c{i}": "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "A") for _ in range(rng.choice([0, 3, 40, 90]))) for i in range(20)}
    chunk = 40
    df = spark.createDataFrame([(c, i, s[chunk * i : chunk * i + chunk]) for c, s in seqs.items() for i in range(max(1, -(-len(s) // chunk)))], "contig string, chunk int, seq string").repartition(5)
    flip = str.maketrans("ACGT", "TGCA")
    want = sorted((x, c, i + 1, strand) for c, s in seqs.items() for i in range(len(s) - k + 1) for x, strand in ((s[i : i + k], "+"), (s[i : i + k].translate(flip)[::-1], "-")))
    got = P.ordered_kmer_rows(df, k, chunk)
    assert [(r.kmer, r.contig, r.pos1, r.strand) for r in got.collect()] == want
    assert got.rdd.getNumPartitions() > 10


def test_kmers_are_dealt_packed_to_be_sorted(spark):
    plan = registry.queries()["t04_sort_kmers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange rangepartitioning" not in plan
