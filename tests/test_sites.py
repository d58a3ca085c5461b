"""Sites that are told by arrays against those told row by row, whatever batches reads come in."""

import random
from functools import partial

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from helixframe.operators import alignments as R
from helixframe.operators import sites as S
from helixframe.operators import variants as V

READS = "ordinal long, qname string, rname string, pos0 long, cigar string, flag int, mapq int, seq string, qual string"
CIGARS = ["10M", "5M1D5M", "3S7M", "4M2I4M", "3M2000N7M", "4M1I1D4M", "2M3D0M5M", "5M30N2D5M", "*", "1D9M", "6=1X3M"]


def some(seed, n=300):
    rng = random.Random(seed)
    one = lambda i: (i, "q", rng.choice(["c", "d", "*"]), rng.randrange(1000, 1060), rng.choice(CIGARS), rng.choice([0, 16, 16, 4]), rng.choice([2, 30, 60, 99, None]), rng.choice(["", "*", None]) if rng.random() < 0.03 else "".join(rng.choice("ACGTNac") for _ in range(10)), rng.choice(["*", None]) if rng.random() < 0.03 else "".join(chr(33 + rng.randrange(60)) for _ in range(10)))
    return [one(i) for i in range(n)]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("model", ["soap", "maq"])
def test_likelihoods_of_reads_are_those_of_their_elements(spark, small_batches, model):
    aln = spark.createDataFrame(some(1), READS)
    rows = lambda df: sorted((r.chrom, r.pos0, r.depth, r.rms_mapq, tuple(r.lk)) for r in df.collect())
    with_bases = aln.filter("cigar <> '1D9M'")  # a batch without bases was an error there
    assert rows(V.read_likelihoods(with_bases, model)) == rows(V.genotype_likelihoods(V.site_elements(with_bases), model))
    assert len(rows(V.read_likelihoods(aln, model))) >= len(rows(V.read_likelihoods(with_bases, model)))


def test_sites_without_bases_and_counts_that_round_up(spark):
    deleted = spark.createDataFrame([(1, "q", "c", 5, "2D", 0, 60, "", "")], READS)
    assert [(r.pos0, r.depth, r.lk) for r in V.read_likelihoods(deleted, "maq").orderBy("pos0").collect()] == [(5, 1, [0] * 10), (6, 1, [0] * 10)]
    odd = spark.createDataFrame([(i, "q", "c", 5, "1M", 0, 60, "A" if i < 127 else "C" if i < 254 else "G" if i < 381 else "T", "I") for i in range(508)], READS)
    assert V.read_likelihoods(odd, "maq").collect()[0].depth == 508


@pytest.mark.parametrize("name", ["c01_genotype_likelihoods", "c01_genotype_likelihoods_maq", "c02_consensus", "a12_pileup_strings", "j09_mpileup"])
def test_positions_are_laid_out_in_arrays(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan and "MapInArrow" in plan[: plan.index("Exchange")]


@pytest.mark.parametrize(("wanted", "fold"), [(("depth", "indels"), S._summed), (("depth", "bases", "quals", "mapqs", "read_pos", "indels"), None)])
def test_sites_are_told_whole_however_few_elements_are_held(wanted, fold, monkeypatch):
    rows = sorted(((*(r[2:4] if r[2] != "*" else ("c", r[3])), *r) for r in some(2)), key=lambda r: (r[0], r[1] >> S.SITE_SHIFT, r[1]))
    data = [{"rname": r[0], "site_bin": b, "pos0": r[1], "cigar": r[6], "seq": r[9], "ordinal": r[2], "flag": r[7], "mapq": r[8], "qual": r[10]} for r in rows for b in (r[1] >> S.SITE_SHIFT,)]
    schema = pa.schema([("rname", pa.string()), ("site_bin", pa.int64()), ("pos0", pa.int64()), ("cigar", pa.string()), ("seq", pa.string()), ("ordinal", pa.int64()), ("flag", pa.int32()), ("mapq", pa.int32()), ("qual", pa.string())])

    def told(size, held):
        monkeypatch.setattr(S, "HELD", held)
        batches = [pa.RecordBatch.from_pylist(data[i : i + size], schema) for i in range(0, len(data), size)]
        out = list(S.swept(iter(batches), partial(S._shown, wanted=frozenset(wanted)), partial(S._piled, wanted=wanted, samples=[]), fold=fold))
        return sorted((x for b in out for x in b.to_pylist()), key=lambda x: (x["rname"], x["pos0"])), len(out)

    want, one = told(len(data), 1 << 20)
    got, several = told(9, 20)
    assert got == want and several > one and len({(x["rname"], x["pos0"]) for x in got}) == len(got)


def test_tied_reads_are_in_the_order_of_their_places(spark):
    rows = [(7, "a", "c", 1, "2M", 0, 10 + k, "AC", "II") for k in (3, 1, 2)]
    tied = spark.createDataFrame(rows, READS).withColumn("place", 100 - R.F.col("mapq"))
    assert [r.mapqs for r in R.pileup(tied, columns=("mapqs",)).collect()] == [".-,"] * 2
    assert [r.mapqs for r in R.pileup(tied.drop("place"), columns=("mapqs",)).collect()] == [",-."] * 2


def test_batches_are_laid_out_in_slices():
    """However long reads are, a slice has a bounded number of positions."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    for each in (36, S.SIZE):
        laid, seen = [0], []
        for b in S._steps(iter([batch, batch]), laid):
            laid[0] = each * b.num_rows
            seen.append(b.num_rows)
        assert sum(seen) == 20_000 and max(seen) * each <= 2 * S.STEP
