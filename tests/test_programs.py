import os

import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignments as R
from helixframe.plans import programs as P
from helixframe.plans.fixtures import view

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_annotation_and_events(spark):
    occ, reads = view(spark, DIR, "fx_exon_occ"), view(spark, DIR, "fx_read")
    t = P.PROGRAMS["prepare_annotation"](occ)
    assert all(df.limit(1).count() for df in t.values())
    _, j = P.locus_tables(occ, t["membership"])
    counts = j.select("locus", "end1", "next_start0").distinct().withColumns({"n_reads": F.lit(4).cast("long"), "n_positions": F.lit(32).cast("long")})
    ev = P.path_events(occ, reads, counts)
    assert ev.count() > 0 and ev.filter("psi < 0 or psi > 1 or ir < 0 or ir > 1").count() == 0
    assert P.expression(occ, reads).filter("density is not null").count() > 0


def test_call_variants(spark):
    ref = "ACGTTGCAAC" * 6
    rows = [(i, "c", 5, "20M", i % 2 * 16, 60, (ref[5:15] + "A" + ref[16:25]), "I" * 20) for i in range(12)]
    rows += [(50 + i, "c", 30, "10M2D10M", 0, 60, ref[30:40] + ref[42:52], "I" * 20) for i in range(12)]
    aln = spark.createDataFrame(rows, "ordinal long, rname string, pos0 long, cigar string, flag int, mapq int, seq string, qual string")
    seqs = spark.createDataFrame([("c", 0, ref)], "contig string, chunk int, seq string")
    got = {(r.POS, r.REF, r.ALT, r.SAMPLE.split(":")[0]) for r in P.call_variants(aln, seqs).collect()}
    assert ref[15] != "A" and got == {(16, ref[15], "A", "1/1"), (40, ref[39], "D2", "1/1")}


def test_view_runs_on_a_stream(spark, tmp_path):
    aln = view(spark, DIR, "fx_aln")
    aln.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(aln.schema).parquet(str(tmp_path / "in"))
    q = R.view(stream, 1, 4, 10).select("ordinal", "flag").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == R.view(aln, 1, 4, 10).count()
