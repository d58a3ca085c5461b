"""Queries on sequences read whole texts, over the borders of chunks."""

import hashlib
import random

import pytest

from helixframe.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = {1: "".join(rng.choice("acgt") for _ in range(40_000)), 2: "acg", 3: ""}
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    code = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return str(d), {f"d{i}": t.translate(code) for i, t in texts.items()}


def test_whole_texts_are_read(spark, tables):
    d, seq = tables
    q = {k.removesuffix("_whole"): f for k, f in registry.queries().items() if k.endswith("_whole")}
    rows = lambda name: q[name](spark, d).collect()
    long = seq["d1"]
    assert {r.strand: (r.n, r.pos_sum) for r in rows("m01_kmers")} == dict.fromkeys("+-", (len(long) - 11, (len(long) - 11) * (len(long) - 10) // 2))
    assert {r.contig: r.md5 for r in rows("a18_sequence_digests")} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in seq.items()}
    assert {r.contig: len(r.rc) for r in rows("x01_reverse_complement")} == {k: len(v) for k, v in seq.items()}
    got = {(r.contig, r.start0): r.seq for r in rows("s11_fetch_sequence")}
    assert ("d1", 16384 - 12) in got and all(v == seq[c][s : s + 25] for (c, s), v in got.items())
    assert all(r.ref == (seq[r.contig][r.pos0 : r.pos0 + 1] or "N") for r in rows("j14_reference_base"))
    assert {r.md[:2] + r.md[3:] for r in rows("c07_recompute_md")} == {"1019"} and len(rows("c07_recompute_md")) == 10
    assert max(r.end1 for r in rows("m02_mappable_runs")) > 39_000 and max(r.pos1 for r in rows("t04_sort_kmers")) > 39_000
    assert sum(r.n for r in rows("a13_kmer_fold")) > 70_000
