from pyspark.sql import functions as F

from helixframe.sources.fasta import read_fasta
from helixframe.operators import alignments as R
from helixframe.operators import annotation as A
from helixframe.operators import kmers as M
from helixframe.operators import variants as V
from helixframe.operators.sequences import fetch_sequence, with_ref_base
from helixframe.operators.variant_filter import variant_filter
from helixframe.sources import alignments as S
from helixframe.sources import annotations as N

SAM = """@HD\tVN:1.0
@SQ\tSN:c1\tLN:45
@SQ\tSN:c2\tLN:30
@RG\tID:g1\tLB:libA
r1\t163\tc1\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTA\t*\tRG:Z:g1\tNM:i:3
r2\t0\tc1\t9\t30\t1S2I6M1P1I4M2I\t*\t0\t0\tAAAAGATAAGGATAAA\t*
r3\t0\tc1\t9\t30\t5H6M\t*\t0\t0\tAGCTAA\t*
r4\t0\tc1\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*
r3\t16\tc1\t29\t30\t6H5M\t*\t0\t0\tTAGGC\t*
r1\t83\tc1\t37\t30\t9M\t=\t7\t-39\tCAGCGCCAT\t*
r9\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII
"""


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def sam(spark, tmp_path):
    return S.read_sam(spark, write(tmp_path, "a.sam", SAM))


def test_read_and_write_sam(spark, tmp_path):
    aln, contigs, groups = sam(spark, tmp_path)
    rows = {(r.qname, r.flag): r for r in aln.collect()}
    assert len(rows) == 7
    r = rows[("r1", 163)]
    assert (r.pos0, r.mrnm, r.mpos0, r.isize, r.rg, r.aux["NM"]["value"]) == (6, "c1", 36, 39, "g1", "3")
    assert [tuple(c) for c in contigs.orderBy("tid").collect()] == [(0, "c1", 45), (1, "c2", 30)]
    assert [tuple(g) for g in groups.collect()] == [("g1", "libA")]
    assert {r.library for r in R.with_library(aln, groups).collect()} == {"libA", None}
    body = [x for x in SAM.splitlines() if not x.startswith("@")]
    assert sorted(r.value for r in S.sam_lines(aln).collect()) == sorted(body)
    S.write_sam(aln, str(tmp_path / "out"), "letters")
    assert {x.value.split("\t")[1] for x in spark.read.text(str(tmp_path / "out")).collect()} >= {"pPR2", "u", ""}
    S.convert_alignments(spark, str(tmp_path / "a.sam"), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 7


def test_toy_pileup_and_depth(spark, tmp_path):
    aln, contigs, _ = sam(spark, tmp_path)
    ends = {(r.qname, r.flag): r.end0 for r in R.with_end(aln).collect()}
    assert ends[("r1", 163)] == 22 and ends[("r4", 0)] == 40 and ends[("r1", 83)] == 45
    depth = {r.pos0: r.depth for r in R.depth(aln).collect()}
    assert depth[6] == 1 and depth[8] == 3 and depth[18] == 2 and depth[28] == 1 and 22 not in depth and sum(depth.values()) == 16 + 10 + 6 + 11 + 5 + 9
    pile = {r.pos0: r for r in R.pileup(aln).collect()}
    assert pile[18].bases == "*G" and pile[18].depth == 2
    assert pile[13].indels >= 1 and "+2AG" in pile[13].bases
    assert pile[6].bases.startswith("^?") and pile[44].bases.endswith("$")
    idx = {r.name: (r.length, r.mapped, r.unmapped) for r in R.idxstats(aln, contigs).collect()}
    assert idx == {"c1": (45, 6, 0), "c2": (30, 0, 0), "*": (0, 0, 1)}
    stat = R.flagstat(aln).first()
    assert (stat.total, stat.mapped, stat.paired, stat.proper, stat.read1, stat.read2) == (7, 6, 2, 2, 1, 1)
    fixed = {(r.qname, r.pos0): r for r in R.fix_mates(aln).collect()}
    assert (fixed[("r1", 6)].mpos0, fixed[("r1", 6)].isize, fixed[("r1", 36)].isize) == (36, 39, -39)
    assert fixed[("r2", 8)].mrnm == "*" and fixed[("r9", -1)].isize == 0


def test_fasta_and_sequences(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">one first\nacgtn\nACGTAC\n>two\nGG\n>none\n")
    seqs = read_fasta(spark, path, chunk=4)
    assert {(r.contig, r.chunk): r.seq for r in seqs.collect()} == {("one", 0): "ACGT", ("one", 1): "NACG", ("one", 2): "TAC", ("two", 0): "GG", ("none", 0): ""}
    regions = spark.createDataFrame([("one", 2, 9), ("one", 9, 99), ("two", 0, 1), ("zzz", 0, 5)], "contig string, start0 long, end1 long")
    assert {(r.contig, r.start0): r.seq for r in fetch_sequence(seqs, regions, 4).collect()} == {("one", 2): "GTNACGT", ("one", 9): "AC", ("two", 0): "G", ("zzz", 0): ""}
    sites = spark.createDataFrame([("one", 4), ("one", 10), ("one", 11)], "contig string, pos0 long")
    assert {r.pos0: r.ref for r in with_ref_base(sites, seqs, 4).collect()} == {4: "N", 10: "C", 11: "N"}
    import hashlib

    md5 = {"one": "ACGTNACGTAC", "two": "GG", "none": ""}
    digests = M.sequence_digests(seqs)
    assert {r.contig: r.md5 for r in digests.collect()} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in md5.items()}
    x = 0
    for v in md5.values():
        x ^= int(hashlib.md5(v.encode()).hexdigest(), 16)
    assert M.digest_xor(digests).first().md5_xor == f"{x:032x}"
    whole = spark.createDataFrame([("one", "ACGTNACGTAC")], "contig string, seq string")
    assert sorted(map(tuple, M.kmers_of_chunks(seqs.filter("contig = 'one'"), 3, 4).collect())) == sorted(map(tuple, M.kmers(whole, 3).collect()))


def test_genepred_and_annotations(spark, tmp_path):
    rows = "#bin\tname\n" + "\n".join(
        ["0\tt1\tchr1\t+\t10\t90\t20\t80\t2\t10,50,\t30,90,\t0\tg1\tcmpl\tcmpl\t0,1,", "0\tt2\tchr1\t-\t10\t30\t10\t10\t1\t10,\t30,\t0\tg2\tnone\tnone\t-1,"]
    )
    path = write(tmp_path, "a.txt", rows)
    t = N.read_annotations(spark, {"ref": path})
    assert {(r.name, r.gene, len(r.exons), r.anno_source) for r in t.collect()} == {("t1", "g1", 2, "ref"), ("t2", "g2", 1, "ref")}
    write(tmp_path, "m.txt", f"#prefix\t{tmp_path}/\nref\ta.txt\n")
    assert N.read_manifest(spark, str(tmp_path / "m.txt")).count() == 2
    occ = A.exon_occurrence(t)
    ex = {(r.start0, r.end1): (r.strand, r.max_coding_start0, r.min_coding_end1) for r in A.exons(occ).collect()}
    assert ex == {(10, 30): ("=", 20, 30), (50, 90): ("+", 50, 80)}
    blocks = {(r.start0, r.end1): (r.strand, r.n_exons) for r in A.gblocks(A.exons(occ)).collect()}
    assert blocks == {(0, 10): (".", 0), (10, 30): ("=", 1), (30, 50): (".", 0), (50, 90): ("+", 1)}


def test_round_trips(spark, tmp_path):
    loci = spark.createDataFrame([("chr1", 1, 9, "+", ["a", "b"], [1, 2], [5])], "chrom string, start0 long, end1 long, strand string, names array<string>, tx_ids array<long>, exon_ids array<long>")
    N.write_loci(loci, str(tmp_path / "l"))
    assert N.read_loci(spark, str(tmp_path / "l")).collect() == loci.collect()
    exons = spark.createDataFrame([(5, "chr1", 0, 4)], "exon_id long, chrom string, start0 long, end1 long")
    assert N.check_loci(loci, exons).count() == 1
    g = spark.createDataFrame([("chr1", 1, 9, "+", [1, 2]), ("chr1", 9, 10, ".", [])], "chrom string, start0 long, end1 long, strand string, exon_ids array<long>")
    N.write_gblocks(g, str(tmp_path / "g"))
    assert sorted(map(tuple, N.read_gblocks(spark, str(tmp_path / "g")).drop("block_id").collect())) == sorted(map(tuple, g.collect()))
    tags = spark.createDataFrame([("chr1|s:4", "chr1", "+", 64, [(1, 32), (101, 132)], [[1, 2], [1, 3, 2]])], "tag_id string, chrom string, strand string, length int, bounds array<struct<start1:long,end1:long>>, exon_paths array<array<long>>")
    N.write_jnxinfo(tags, str(tmp_path / "j"))
    back = N.read_jnxinfo(spark, str(tmp_path / "j"))
    assert back.collect() == tags.collect()
    assert sorted((r.path, r.step, r.left_exon, r.right_exon) for r in N.tag_exon_edges(back).collect()) == [(0, 1, 1, 2), (1, 1, 1, 3), (1, 2, 3, 2)]
    groups = spark.createDataFrame([(1, [3, 4]), (2, [5])], "set_id long, exon_ids array<long>")
    N.write_exon_groups(groups, str(tmp_path / "e"))
    assert sorted(map(tuple, N.read_exon_groups(spark, str(tmp_path / "e")).collect())) == [(1, 3), (1, 4), (2, 5)]
    N.split_by_chromosome(g, str(tmp_path / "s"), forward_only=True)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_intervals_and_conserved(spark, tmp_path):
    wig = write(tmp_path, "w", "track x\nbrowser y\n# c\nchr1\t10\t20\t1.5\nchr1 30 40 2\n")
    assert [tuple(r) for r in N.read_wig(spark, wig).orderBy("start0").collect()] == [("chr1", 10, 20, 1.5), ("chr1", 30, 40, 2.0)]
    cb = write(tmp_path, "c", "7 chr1 100 106 chr9 5 12 + 33.5 AC-GTAC ACTG-AC\n")
    blocks = N.read_conserved_blocks(spark, cb)
    regions = spark.createDataFrame([("chr1", 102, 105), ("chr2", 0, 9)], "chrom string, start0 long, end1 long")
    assert [tuple(r) for r in N.conserved_in(blocks, regions).collect()] == [(7, "chr1", 102, 105, "-GTA", "TG-A")]


def test_other_aligners(spark, tmp_path):
    bow = write(tmp_path, "b", "q1\t+\tc1\t4\tACGT\tIIII\t0\t1:A>C\nq1\t-\tc1\t9\tACGT\tIIII\t0\t0:A>C,2:G>T\nq2\t-\tc2\t1\tACGT\tIIII\t0\t0:A>C\nq2\t+\tc2\t5\tACGT\tIIII\t0\t1:A>C\n")
    got = {r.qname: (r.flag, r.pos0, r.mapq, r.md) for r in S.normalize_bowtie(spark, bow).collect()}
    assert got == {"q1": (0, 4, 15, "1A2"), "q2": (16, 1, 0, "3A0")}
    soap = write(tmp_path, "s", "p/1\tACGT\tIIII\t1\ta\t4\t+\tc1\t11\t0\np/2\tACGT\tIIII\t2\tb\t4\t-\tc1\t31\t0\n")
    s = {r.pos0: r for r in S.normalize_soap(spark, soap).collect()}
    assert (s[10].mapq, s[30].mapq, s[10].isize, s[30].isize) == (30, 0, 24, -24)
    assert s[10].flag & 1 and s[10].flag & 64 and s[30].flag & 128 and s[10].flag & 32
    zoom = write(tmp_path, "z", "p\tACGT\tc1\t7\t-\n")
    assert [(r.flag, r.pos0, r.mapq) for r in S.normalize_zoom(spark, zoom).collect()] == [(16, 7, 30)]
    novo = write(tmp_path, "n", "@n\tS\tACGG\tABCD\tU\t10\t33\t>c1\t5\tR\t.\t.\t.\t50\n# x\n@m\tS\tACGG\tABCD\tNM\n")
    assert [(r.qname, r.flag, r.pos0, r.mapq, r.seq, r.qual) for r in S.normalize_novo(spark, novo).collect()] == [("n", 16, 4, 50, "CCGT", "DCBA")]
    exp = ["m", "1", "1", "2", "3", "4", "0", "1", "ACGT", "hhhh", "c1.fa", "", "12", "F", "4", "77", "90", "", "", "", "", "Y"]
    bad = [*exp[:21], "N"]
    path = write(tmp_path, "e", "\t".join(exp) + "\n" + "\t".join(bad) + "\n")
    assert [(r.rname, r.pos0, r.mapq, r.qual) for r in S.normalize_export(spark, path).collect()] == [("c1", 11, 90, "IIII")]
    assert S.normalize_export(spark, path, keep_failed=True).count() == 2
    psl = "20 1 0 0 1 2 1 5 + q 30 3 26 t 900 100 126 2 10,11, 3,15, 100,115,"
    r = S.normalize_psl(spark, write(tmp_path, "p", psl.replace(" ", "\t") + "\n")).first()
    assert (r.cigar, r.pos0, r.score) == ("3H10M2I5D11M4H", 100, 20 - 3 - 10 - 14 if 20 - 3 - 10 - 14 > 0 else 0)
    mv = write(tmp_path, "mv", "\t".join(["r", "c1", "9", "+", "0", "0", "44", "0", "0", "2", "0", "0", "0", "4", "ACGT", "IIII"]) + "\n")
    assert [tuple(x) for x in S.read_mapview(spark, mv).collect()] == [("r", "c1", 8, "+", 44, 2)]
    assert [tuple(x) for x in S.read_contigs(spark, write(tmp_path, "ct", "b 9\na 3\n")).collect()] == [(0, "b", 9), (1, "a", 3)]


CNS = """c7	510	G	G	41	0	88	2	.,	II
c7	640	*	+T/+T	47	130	55	6	+T	*	5	1	0
c7	733	*	-TT/-TT	29	150	58	12	-TT	*	6	6	0
c7	901	*	*/-ACCA	4	4	47	8	*	-ACCA	6	2	0
c7	5000	A	R	40	50	60	20	x	x
"""


def test_consensus_pileup_to_vcf_and_filter(spark, tmp_path):
    cns = S.read_cns_pileup(spark, write(tmp_path, "cns", CNS))
    vcf = {r.POS: (r.REF, r.ALT, r.SAMPLE) for r in V.to_vcf(cns).collect()}
    assert vcf == {640: ("N", "IT", "1/1:47:6"), 733: ("N", "D2", "1/1:29:12"), 901: ("N", "D4", "0/1:4:8"), 5000: ("A", "G", "0/1:40:20")}
    assert V.to_vcf(cns, keep_ref=True, indels=False).count() == 2
    S.write_vcf(V.to_vcf(cns), str(tmp_path / "v"), "me")
    lines = [x.value for x in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines.count("##fileformat=VCFv3.3") == 1 and len(lines) == 6 + 4
    assert {r.pos1: r.reason for r in variant_filter(cns).collect()} == {640: "", 733: "", 901: "", 5000: ""}


def test_variant_filter_reasons(spark):
    row = lambda pos, ref="A", cons="G", snp=50, rms=60, depth=20, a1="*", c1=0: ("c", pos, ref, cons, 50, snp, rms, depth, a1, "*", c1, 0)
    rows = [row(100, depth=2), row(200, depth=101), row(300, rms=24), row(400), row(404), row(408), row(500, "*", "+T/+T", 60, 60, 20, "+T", 3), row(505), row(600), row(607, "*", "-AC/*", 30, 60, 20, "-AC", 2), row(620, "*", "+G/*", 200, 60, 20, "+G", 5)]
    df = spark.createDataFrame(rows, "chrom string, pos1 long, ref string, cons string, cons_q int, snp_q int, rms_mapq int, depth int, a1 string, a2 string, cnt1 int, cnt2 int")
    got = {r.pos1: r.reason for r in variant_filter(df).collect()}
    assert got == {100: "d", 200: "D", 300: "Q", 400: "W", 404: "W", 408: "W", 500: "", 505: "G", 600: "G", 607: "g", 620: ""}


def test_genotypes_and_consensus(spark):
    rows = [("c", 1, i, b, False, q, 60) for i, (b, q) in enumerate([("A", 30)] * 10)] + [("c", 2, i, b, i % 2 == 0, 30, 60) for i, b in enumerate("ACACACACAC")] + [("c", 3, 0, None, False, 0, 60)]
    e = spark.createDataFrame(rows, "chrom string, pos0 long, ordinal long, base string, minus boolean, base_q int, mapq int")
    for model in ("soap", "maq"):
        c = {r.pos0: r for r in V.consensus(V.genotype_likelihoods(e, model)).collect()}
        assert c[1].cons == "A" and c[2].cons == "M" and c[1].depth == 10 and c[1].rms_mapq == 60
    lk = {r.pos0: r.lk for r in V.genotype_likelihoods(e).collect()}
    damped = sum((0.85**n * 0.97 + 0.03 if n else 1) * 30 for n in range(10))
    assert lk[1][0] == 0 and lk[1][4] == min(255, int(damped + 0.5)) and lk[1][1] == int(4.343 * 10 * 0.6931471805599453 + 0.5)
    assert {r.pos0: r.cons for r in V.cheap_consensus(e, "union").collect()} == {1: "A", 2: "M"}
    seqs = spark.createDataFrame([("c", 0, "TATA")], "contig string, chunk int, seq string")
    snps = {r.pos1: (r.ref, r.cons, r.snp_q > 0) for r in V.call_snps(V.consensus(V.genotype_likelihoods(e)), seqs).collect()}
    assert snps[2] == ("A", "A", False) and snps[3] == ("T", "M", True)


def test_consensus_fastq(spark):
    rows = [("c", 2, "A", "A", 30, 0, 60, 10), ("c", 3, "A", "R", 40, 30, 10, 10), ("c", 12, "*", "+T/+T", 40, 60, 60, 10), ("c", 15, "C", "C", 50, 0, 60, 10)]
    df = spark.createDataFrame(rows, "chrom string, pos1 long, ref string, cons string, cons_q int, snp_q int, rms_mapq int, depth int")
    got = {r.chunk: (r.seq, r.qual) for r in V.consensus_fastq(df, l=4, chunk=10).collect()}
    assert got == {0: ("nArnnnnnnn", "!?I!!!!!!!"), 1: ("nnnnc", "!!!!S")}


def test_indel_calls(spark):
    rows = [(i, "c", 10, "5M1D5M" if i < 6 else "10M", 0, 60, "ACGTAGTACG", "I" * 10) for i in range(12)] + [(20 + i, "c", 100, "5M2I3M", 0, 60, "ACGTATTACG", "I" * 10) for i in range(8)] + [(40, "c", 200, "5M1D5M", 0, 60, "ACGTAGTACG", "I" * 10)] + [(41 + i, "c", 200, "10M", 0, 60, "ACGTAGTACG", "I" * 10) for i in range(9)]
    aln = spark.createDataFrame(rows, "ordinal long, rname string, pos0 long, cigar string, flag int, mapq int, seq string, qual string")
    seqs = spark.createDataFrame([("c", 0, "G" * 300)], "contig string, chunk int, seq string")
    got = {r.pos1: r for r in V.indel_calls(aln, seqs).collect()}
    assert {p: r.cons for p, r in got.items()} == {15: "*/-G", 105: "+TT/+TT", 205: "*/*"}
    assert (got[15].depth, got[15].cnt1, got[15].cnt2, got[15].rms_mapq) == (12, 6, 6, 60) and got[105].snp_q == 255 and got[205].snp_q == 0
    assert {r.POS: r.ALT for r in V.to_vcf(V.indel_calls(aln, seqs).filter("snp_q > 0"), seqs).collect()} == {15: "D1", 105: "ITT"}
