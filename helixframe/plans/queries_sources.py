"""Queries of sources, sinks and scalar functions: fixture rows are written as text and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as L
from ..functions import bounds as B
from ..functions import sequence as Q
from ..operators import annotation as A
from ..operators import intervals as I
from ..operators import kmers as M
from ..operators import variants as V
from ..session import scratch
from ..sources import alignments as S
from ..sources import annotations as N
from .fixtures import sql, view, whole_chunks
from .queries_alignments import aln, with_bases
from .queries_annotation import exon_rows, occ
from .queries_variants import CNS, WHOLE, calls, places
from .registry import query


def text_of(s, d, body: str | DataFrame, first: tuple[str, ...] = ()) -> str:
    """The path of a text that holds ``first`` and the lines of a query."""
    path = scratch(s, "text")
    rows = sql(s, d, body) if isinstance(body, str) else body
    if first:
        rows = s.createDataFrame([(x,) for x in first], "value string").coalesce(1).unionByName(rows.toDF("value"))
    rows.write.text(path)
    return path


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


TX = "SELECT tx_id, min(gene_id) AS gene_id, min(chrom) AS chrom, min(strand) AS strand, min(start0) AS s, max(end1) AS e, count(*) AS n FROM fx_exon_occ GROUP BY tx_id"


def genepred_lines(s, d, keep: str = "true") -> DataFrame:
    exons = occ(s, d).filter(keep).groupBy("tx_id").agg(F.min("gene_id").alias("g"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start0", "end1"))).alias("x"))
    part = lambda k: F.concat(F.array_join(F.transform("x", lambda x: x[k].cast("string")), ","), F.lit(","))
    low, high = F.array_min(F.transform("x", lambda x: x["start0"])), F.array_max(F.transform("x", lambda x: x["end1"]))
    fields = [F.lit("585"), F.concat(F.lit("t"), "tx_id"), "chrom", "strand", low, high, low + 50, high - 50, F.size("x"), part("start0"), part("end1"), F.lit("0"), F.concat(F.lit("g"), "g"), F.lit("cmpl"), F.lit("cmpl"), F.repeat(F.lit("0,"), F.size("x"))]
    return exons.select(F.concat_ws("\t", *(c if isinstance(c, str) else c.cast("string") for c in fields)).alias("value"))


@query(
    "s01_read_genepred",
    "SELECT 't' || tx_id AS name, chrom, strand, s AS tx_start0, e AS tx_end1, s + 50 AS cds_start0, e - 50 AS cds_end1, 'g' || gene_id AS gene, x AS exons FROM tx JOIN (SELECT tx_id, string_agg(start0 || '-' || end1, ',' ORDER BY start0, end1) AS x FROM fx_exon_occ GROUP BY tx_id) USING (tx_id)",
    {"tx": TX},
)
def _(s, d):
    t = N.read_genepred(s, text_of(s, d, genepred_lines(s, d), ("#bin\tname\tchrom",)))
    exons = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start0"], x["end1"])), ",")
    return t.select("name", "chrom", "strand", "tx_start0", "tx_end1", "cds_start0", "cds_end1", "gene", exons.alias("exons"))


@query("s02_read_annotations", "SELECT CASE strand WHEN '+' THEN 'fwd' ELSE 'rev' END AS anno_source, 't' || tx_id AS name, CAST(n AS INT) AS n_exons FROM tx", {"tx": TX})
def _(s, d):
    base = scratch(s, "text")
    for name, strand in (("plus", "+"), ("minus", "-")):
        genepred_lines(s, d, f"strand = '{strand}'").write.text(f"{base}/{name}")
    t = N.read_manifest(s, text_of(s, d, s.createDataFrame([("fwd\tplus",), ("rev\tminus",)], "value string").coalesce(1), (f"#prefix\t{base}/",)))
    return t.select("anno_source", "name", F.size("exons").alias("n_exons"))


@query("s03_read_loci", "SELECT chrom, start0, end1, strand, 'g' || gene_id AS names, tx_ids, exon_ids FROM (SELECT gene_id, min(chrom) AS chrom, min(start0) AS start0, max(end1) AS end1, min(strand) AS strand, array_to_string(list_sort(list(DISTINCT tx_id)), ',') AS tx_ids, array_to_string(list_sort(list(DISTINCT start0)), ',') AS exon_ids FROM fx_exon_occ GROUP BY gene_id)")
def _(s, d):
    ids = lambda c: F.array_sort(F.collect_set(c))
    loci = occ(s, d).groupBy("gene_id").agg(F.min("chrom").alias("chrom"), F.min("start0").alias("start0"), F.max("end1").alias("end1"), F.min("strand").alias("strand"), ids("tx_id").alias("tx_ids"), ids("start0").alias("exon_ids"))
    path = scratch(s, "text")
    N.write_loci(loci.withColumn("names", F.array(F.concat(F.lit("g"), "gene_id"))), path)
    return N.read_loci(s, path).select("chrom", "start0", "end1", "strand", joined("names").alias("names"), joined("tx_ids").alias("tx_ids"), joined("exon_ids").alias("exon_ids"))


@query("s04_read_gblocks", "SELECT chrom, start0, end1, '.' AS strand, CASE WHEN n_exons = 0 THEN '' ELSE array_to_string(range(start0, start0 + n_exons), ',') END AS exon_ids FROM fx_gblock")
def _(s, d):
    blocks = A.gblocks(exon_rows(s, d)).withColumns({"strand": F.lit("."), "exon_ids": F.when(F.col("n_exons") > 0, F.sequence("start0", F.col("start0") + F.col("n_exons") - 1)).otherwise(F.array().cast("array<bigint>"))})
    path = scratch(s, "text")
    N.write_gblocks(blocks, path)
    return N.read_gblocks(s, path).select("chrom", "start0", "end1", "strand", joined("exon_ids").alias("exon_ids"))


TAGGED = {"tg": "SELECT chrom, chrom || '|k:' || end1 || '_' || next_start0 AS tag_id, end1, next_start0, min(strand) AS strand, list_sort(list(DISTINCT [start0, next_start0])) AS paths FROM fx_jnx GROUP BY chrom, end1, next_start0"}


def jnx_tags(s, d, repeat: bool = False) -> DataFrame:
    """Junctions of one donor and acceptor as tags, one path for each left exon, as read from their text form."""
    g = view(s, d, "fx_jnx").groupBy("chrom", "end1", "next_start0").agg(F.min("strand").alias("strand"), F.array_sort(F.collect_set(F.array("start0", "next_start0"))).alias("exon_paths"))
    bound = lambda a, b: F.struct(a.alias("start1"), b.alias("end1"))
    paths = F.concat("exon_paths", "exon_paths") if repeat else F.col("exon_paths")
    tags = g.select(F.concat("chrom", F.lit("|k:"), "end1", F.lit("_"), "next_start0").alias("tag_id"), "strand", F.lit(70).alias("length"), F.array(bound(F.col("end1") - 34, F.col("end1")), bound(F.col("next_start0") + 1, F.col("next_start0") + 35)).alias("bounds"), paths.alias("exon_paths"))
    path = scratch(s, "text")
    N.write_jnxinfo(tags, path)
    return N.read_jnxinfo(s, path)


def paths_text() -> F.Column:
    return F.array_join(F.transform("exon_paths", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), "|").alias("paths")


PATHS_SQL = "array_to_string(list_transform(paths, lambda p: p[1] || ',' || p[2]), '|') AS paths"


@query("s05_read_jnxinfo", f"SELECT tag_id, chrom, strand, CAST(70 AS INT) AS length, (end1 - 34) || '-' || end1 || ',' || (next_start0 + 1) || '-' || (next_start0 + 35) AS bounds, {PATHS_SQL} FROM tg", TAGGED)
def _(s, d):
    return jnx_tags(s, d).select("tag_id", "chrom", "strand", "length", F.array_join(F.transform("bounds", lambda b: F.concat_ws("-", b["start1"], b["end1"])), ",").alias("bounds"), paths_text())


@query("j15_tag_exon_edges", "SELECT tag_id, CAST(i - 1 AS INT) AS path, CAST(1 AS INT) AS step, paths[i][1] AS left_exon, paths[i][2] AS right_exon FROM (SELECT *, unnest(range(1, len(paths) + 1)) AS i FROM tg)", TAGGED)
def _(s, d):
    return N.tag_exon_edges(jnx_tags(s, d))


@query("u08_distinct_paths", f"SELECT tag_id, {PATHS_SQL} FROM tg", TAGGED)
def _(s, d):
    return N.distinct_paths(jnx_tags(s, d, repeat=True)).select("tag_id", paths_text())


@query("s06_read_exon_groups", "SELECT DISTINCT gene_id AS set_id, start0 AS exon_id FROM fx_exon_occ")
def _(s, d):
    path = scratch(s, "text")
    N.write_exon_groups(occ(s, d).groupBy(F.col("gene_id").alias("set_id")).agg(F.array_sort(F.collect_set("start0")).alias("exon_ids")), path)
    return N.read_exon_groups(s, path)


SAM = {
    "sm": "SELECT ordinal, qname, flag, rname, pos0 + 1 AS pos1, mapq, cigar, mrnm, pos0 + isize + 1 AS mpos1, isize, repeat(substr('ACGTACGT', CAST(ordinal % 4 + 1 AS INT), 4), 9) AS seq, repeat(chr(mapq % 40 + 33), 36) AS qual, mapq % 7 AS nm, 'g' || (mapq % 3) AS rg FROM fx_aln",
}


def tagged(s, d) -> DataFrame:
    tag = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    aux = F.create_map(F.lit("NM"), tag("i", F.col("mapq") % 7), F.lit("RG"), tag("Z", F.concat(F.lit("g"), F.col("mapq") % 3)))
    return with_bases(s, d).withColumns({"mpos0": F.col("pos0") + F.col("isize"), "aux": aux})


HEADER = ("@HD\tVN:1.0", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chr2\tLN:2000", "@RG\tID:g0\tLB:libA", "@RG\tID:g1")


@query("s07_read_sam", "SELECT qname, flag, rname, pos1 - 1 AS pos0, mapq, cigar, mrnm, mpos1 - 1 AS mpos0, CAST(isize AS BIGINT) AS isize, seq, qual, CAST(nm AS BIGINT) AS nm, rg FROM sm", SAM)
def _(s, d):
    rows, _, _ = S.read_sam(s, text_of(s, d, S.sam_lines(tagged(s, d)), HEADER))
    return rows.select("qname", "flag", "rname", "pos0", "mapq", "cigar", "mrnm", "mpos0", "isize", "seq", "qual", L.tag_int(F.col("aux"), "NM").alias("nm"), "rg")


@query("x10_tag_accessors", "SELECT ordinal, CAST(nm AS BIGINT) AS nm, CAST(nm AS DOUBLE) AS as_float, rg AS as_text, CAST(NULL AS BIGINT) AS none FROM sm", SAM)
def _(s, d):
    return tagged(s, d).select("ordinal", L.tag_int(F.col("aux"), "NM").alias("nm"), L.tag_float(F.col("aux"), "NM").alias("as_float"), L.tag_text(F.col("aux"), "RG").alias("as_text"), L.tag_int(F.col("aux"), "XX").alias("none"))


@query("s08_sam_lines", "SELECT concat_ws(chr(9), qname, '0x' || lower(to_hex(flag)), rname, pos1, mapq, cigar, CASE WHEN mrnm = rname THEN '=' ELSE mrnm END, mpos1, isize, seq, qual, 'NM:i:' || nm, 'RG:Z:' || rg) AS value FROM sm", SAM)
def _(s, d):
    path = scratch(s, "text")
    S.write_sam(tagged(s, d), path, "hex")
    return s.read.text(path)


@query("s24_convert_alignments", "SELECT rname, pos0 >> 14 AS bin14, count(*) AS n FROM fx_aln GROUP BY ALL")
def _(s, d):
    path = scratch(s, "columns")
    S.convert_alignments(s, text_of(s, d, S.sam_lines(tagged(s, d)), HEADER), path)
    return s.read.parquet(path).groupBy("rname", "bin14").agg(F.count(F.lit(1)).alias("n"))


@query("s24_converted_rows", """SELECT qname, flag, rname, CAST(pos0 AS BIGINT) AS pos0, mapq, cigar, CAST(pos0 >> 14 AS BIGINT) AS bin14, CAST(((e1 - 1) >> 14) - (pos0 >> 14) AS INT) AS reach FROM (SELECT *, pos0 + CASE cigar WHEN '36M' THEN 36 WHEN '20M1D16M' THEN 37 WHEN '18M2I16M' THEN 34 WHEN '10M100N26M' THEN 136 ELSE 32 END AS e1 FROM fx_aln)""")
def _(s, d):
    path = scratch(s, "columns")
    S.convert_alignments(s, text_of(s, d, S.sam_lines(tagged(s, d)), HEADER), path)
    return s.read.parquet(path).select("qname", "flag", "rname", "pos0", "mapq", "cigar", "bin14", "reach")


REGIONS = ("chr1:1-20,000", "chr1:15001-30000", "chr2:100001", "chr3:40000-40001", "chr9:1-10")


@query("f03_fetch_regions", """SELECT qname, flag, rname, CAST(pos0 AS BIGINT) AS pos0, cigar, r_start0, r_end1 FROM (SELECT *, pos0 + CASE cigar WHEN '36M' THEN 36 WHEN '20M1D16M' THEN 37 WHEN '18M2I16M' THEN 34 WHEN '10M100N26M' THEN 136 ELSE 32 END AS e1 FROM fx_aln)
JOIN (VALUES ('chr1', CAST(0 AS BIGINT), CAST(20000 AS BIGINT)), ('chr1', 15000, 30000), ('chr2', 100000, 536870912), ('chr3', 39999, 40001), ('chr9', 0, 10)) r(chrom, r_start0, r_end1) ON rname = chrom AND pos0 < r_end1 AND e1 > r_start0""")
def _(s, d):
    path = scratch(s, "columns")
    S.convert_alignments(s, text_of(s, d, S.sam_lines(tagged(s, d)), HEADER), path)
    return S.fetch_regions(s, path, list(REGIONS)).select("qname", "flag", "rname", "pos0", "cigar", "r_start0", "r_end1")


@query("s09_read_mapview", "SELECT qname, chrom, pos0, strand, mapq, CAST(mapq % 4 AS INT) AS nm FROM fx_read")
def _(s, d):
    fields = "qname, chrom, pos0 + 1, strand, 0, 0, mapq, 0, 0, mapq % 4, 0, 0, 0, 0, 'ACGT', 'IIII'"
    return S.read_mapview(s, text_of(s, d, f"SELECT concat_ws('\t', {fields}) AS value FROM fx_read"))


@query("s10_read_fasta", "SELECT contig, CAST(i AS INT) AS chunk, substr(seq, CAST(i * 16384 + 1 AS INT), 16384) AS seq FROM (SELECT contig, seq, unnest(range(0, greatest((length(seq) + 16383) // 16384, 1))) AS i FROM fx_whole)")
def _(s, d):
    from ..sources.fasta import read_fasta

    whole = view(s, d, "fx_whole").select(F.concat(F.lit(">"), "contig", F.lit(" c.76A>T of a document > other\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value"))
    return read_fasta(s, text_of(s, d, whole), range_bytes=1 << 18)


WIG = {"wg": "SELECT chrom, CAST(floor(pos0 / 30) AS BIGINT) * 30 AS start0, CAST(floor(pos0 / 30) AS BIGINT) * 30 + 30 AS end1, CAST(count(*) AS DOUBLE) AS score FROM fx_read GROUP BY ALL"}


def wig(s, d) -> DataFrame:
    body = f"SELECT concat_ws(' ', chrom, start0, end1, score) AS value FROM ({WIG['wg']})"
    return N.read_wig(s, text_of(s, d, body, ("track name=reads", "browser position chr1:1-2", "# comment", "")))


@query("s12_read_wig", "SELECT * FROM wg", WIG)
def _(s, d):
    return wig(s, d)


@query(
    "w05_collapse_wig",
    "SELECT chrom, min(start0) AS start0, max(end1) AS end1, sum(score) AS score FROM (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY start0) AS island FROM (SELECT *, CASE WHEN start0 - lag(end1) OVER (PARTITION BY chrom ORDER BY start0) <= 60 THEN 0 ELSE 1 END AS nw FROM wg)) GROUP BY chrom, island HAVING max(end1) - min(start0) >= 90",
    WIG,
)
def _(s, d):
    return I.collapse_wig(wig(s, d), (0.0, 0.0), [(60, 0.0, 0.0)], min_length=90)


SITES = {"st": "SELECT DISTINCT chrom, start0 FROM fx_exon"}


def conserved(s, d) -> DataFrame:
    body = f"SELECT concat_ws(' ', start0, chrom, start0, start0 + 12, 'z1', 5, 16, '-', 77.5, 'ACGT--ACGTACGT', 'ACG-TTACGTACG-') AS value FROM ({SITES['st']})"
    return N.read_conserved_blocks(s, text_of(s, d, body, ("# aligned blocks",)))


@query("s13_read_conserved_blocks", "SELECT start0 AS aln_no, chrom AS chrom1, start0 AS start1, start0 + 12 AS end1, 'z1' AS chrom2, CAST(5 AS BIGINT) AS start2, CAST(16 AS BIGINT) AS end2, '-' AS strand, CAST(77.5 AS DOUBLE) AS score, 'ACGT--ACGTACGT' AS seq1, 'ACG-TTACGTACG-' AS seq2 FROM st", SITES)
def _(s, d):
    return conserved(s, d)


@query("j11_conserved_in", "SELECT start0 AS aln_no, chrom, start0 + 3 AS start0, start0 + 9 AS end1, 'T--ACGTA' AS seq1, '-TTACGTA' AS seq2 FROM st", SITES)
def _(s, d):
    regions = exon_rows(s, d).select("chrom", (F.col("start0") + 3).alias("start0"), (F.col("start0") + 9).alias("end1")).distinct()
    return N.conserved_in(conserved(s, d), regions)


def cns_text(s, d) -> str:
    snp = F.concat_ws("\t", "chrom", "pos1", "ref", "cons", "cons_q", "snp_q", "rms_mapq", "depth", F.lit("^~,"), F.lit("AB"))
    gap = F.concat_ws("\t", "chrom", "pos1", "ref", "cons", "cons_q", "snp_q", "rms_mapq", "depth", "a1", "a2", "cnt1", "cnt2", F.lit(3), F.lit(0), F.lit(0))
    return text_of(s, d, calls(s, d).select(F.when(F.col("ref") == "*", gap).otherwise(snp).alias("value")))


@query("s14_read_cns_pileup", "SELECT chrom, pos1, ref, cons, cons_q, CAST(snp_q AS INT) AS snp_q, rms_mapq, depth, CASE WHEN ref = '*' THEN a1 ELSE '*' END AS a1, '*' AS a2, CAST(CASE WHEN ref = '*' THEN 1 END AS INT) AS cnt1, CAST(CASE WHEN ref = '*' THEN 2 END AS INT) AS cnt2, CAST(CASE WHEN ref = '*' THEN 3 END AS INT) AS cnt_other FROM cn", CNS)
def _(s, d):
    return S.read_cns_pileup(s, cns_text(s, d))


@query(
    "s16_write_vcf",
    """SELECT concat_ws(chr(9), chrom, pos1, '.', ref, CASE WHEN length(b) = 1 THEN b WHEN b[1] = ref THEN b[2] WHEN b[2] = ref THEN b[1] ELSE b[1] || ',' || b[2] END, snp_q, '0', 'DP=' || depth, 'GT:GQ:DP', CASE WHEN length(b) = 1 THEN '1/1' WHEN b[1] = ref OR b[2] = ref THEN '0/1' ELSE '1/2' END || ':' || cons_q || ':' || depth) AS value
FROM (SELECT *, CASE cons WHEN 'M' THEN 'AC' WHEN 'R' THEN 'AG' WHEN 'W' THEN 'AT' WHEN 'S' THEN 'CG' WHEN 'Y' THEN 'CT' WHEN 'K' THEN 'GT' ELSE cons END AS b FROM cn WHERE ref <> '*' AND ref <> cons)
UNION ALL SELECT * FROM (VALUES ('##fileformat=VCFv3.3'), ('##INFO=DP,1,Integer,"Total Depth"'), ('##FORMAT=GT,1,String,"Genotype"'), ('##FORMAT=GQ,1,Integer,"Genotype Quality"'), ('##FORMAT=DP,1,Integer,"Read Depth"')) h(value)
UNION ALL SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'reads')""",
    CNS,
)
def _(s, d):
    path = scratch(s, "text")
    S.write_vcf(V.to_vcf(calls(s, d), indels=False), path, "reads")
    return s.read.text(path)


@query("s18_split_by_chromosome", "SELECT qname, chrom, pos0 FROM fx_read WHERE chrom = 'chr2' AND strand <> '-'")
def _(s, d):
    path = scratch(s, "columns")
    N.split_by_chromosome(view(s, d, "fx_read"), path, forward_only=True)
    return s.read.parquet(path).filter("chrom = 'chr2'").select("qname", "chrom", "pos0")


@query("s21_normalize_bowtie", "SELECT qname, nm, CASE WHEN ties > 1 THEN 0 WHEN next THEN 15 ELSE 25 END AS mapq FROM (SELECT qname, CAST(min(mapq % 4) AS INT) AS nm, count(*) FILTER (mapq % 4 = least) AS ties, count(*) FILTER (mapq % 4 = least + 1) > 0 AS next FROM (SELECT qname, mapq, min(mapq % 4) OVER (PARTITION BY qname) AS least FROM fx_aln) GROUP BY qname)")
def _(s, d):
    edits = F.element_at(F.array(F.lit(""), F.lit("3:A>C"), F.lit("3:A>C,7:G>T"), F.lit("3:A>C,7:G>T,11:T>A")), F.col("mapq") % 4 + 1)
    rows = with_bases(s, d).select(F.concat_ws("\t", "qname", F.when(L.has(F.col("flag"), L.REVERSE), "-").otherwise("+"), "rname", "pos0", "seq", "qual", F.lit(0), edits).alias("value"))
    return S.normalize_bowtie(s, text_of(s, d, rows)).select("qname", "nm", "mapq")


#: Two mates a name: one forward at pos0, one in reverse 100 bases on, as lines of each program (name, line of a mate).
MATES = "SELECT ordinal, qname, rname, mapq, pos0 + 100 * m AS p0, m, repeat(substr('ACGTACGT', CAST(ordinal % 4 + 1 AS INT), 4), 9) AS seq FROM fx_aln, (SELECT 0 AS m UNION ALL SELECT 1 AS m) t"
PAIRED = "SELECT 'p' || ordinal AS qname, CAST(CASE m WHEN 0 THEN 97 ELSE 145 END AS INT) AS flag, rname, p0 AS pos0, {q} AS mapq, p0 + 100 - 200 * m AS mpos0, CAST(136 - 272 * m AS BIGINT) AS isize FROM mt"
PAIR = ["qname", "flag", "rname", "pos0", "mapq", "mpos0", "isize"]


@query("s22_normalize_soap", PAIRED.format(q="CAST(CASE WHEN mapq % 2 = 0 THEN 30 ELSE 0 END AS INT)"), {"mt": MATES})
def _(s, d):
    body = f"SELECT concat_ws('\t', concat('p', ordinal, '/', m + 1), seq, repeat('I', 36), 1 + mapq % 2, CASE m WHEN 0 THEN 'a' ELSE 'b' END, 36, CASE m WHEN 0 THEN '+' ELSE '-' END, rname, p0 + 1) AS value FROM ({MATES})"
    return S.normalize_soap(s, text_of(s, d, body)).select(*PAIR)


@query("s22_normalize_zoom", PAIRED.format(q="CAST(30 AS INT)"), {"mt": MATES})
def _(s, d):
    body = f"SELECT concat_ws('\t', concat('p', ordinal, '/', m + 1), seq, rname, p0, CASE m WHEN 0 THEN '+' ELSE '-' END) AS value FROM ({MATES})"
    return S.normalize_zoom(s, text_of(s, d, body)).select(*PAIR)


@query("s22_normalize_novo", PAIRED.format(q="CAST(greatest(mapq, 20) AS INT)"), {"mt": MATES})
def _(s, d):
    body = f"SELECT concat_ws('\t', concat('@p', ordinal, '/', m + 1), CASE m WHEN 0 THEN 'L' ELSE 'R' END, seq, repeat('I', 36), 'U', '0', mapq, concat('>', rname), p0 + 1, CASE m WHEN 0 THEN 'F' ELSE 'R' END, '.', '.', '.', 20) AS value FROM ({MATES})"
    return S.normalize_novo(s, text_of(s, d, body, ("# made by a test",))).select(*PAIR)


@query("s22_normalize_export", "SELECT 'm:1:' || ordinal || ':5:6' AS qname, CAST(CASE m WHEN 0 THEN 97 ELSE 145 END AS INT) AS flag, rname, p0 AS pos0, CAST(least(254, greatest(mapq * 6, 20)) AS INT) AS mapq, p0 + 100 - 200 * m AS mpos0, CAST(136 - 272 * m AS BIGINT) AS isize FROM mt WHERE mapq % 9 <> 0", {"mt": MATES})
def _(s, d):
    body = f"SELECT concat_ws('\t', 'm', 'run', 1, ordinal, 5, 6, '', m + 1, seq, repeat('h', 36), concat(rname, '.fa'), '', p0 + 1, CASE m WHEN 0 THEN 'F' ELSE 'R' END, '36', mapq * 6, 20, '', '', '', '', CASE WHEN mapq % 9 = 0 THEN 'N' ELSE 'Y' END) AS value FROM ({MATES})"
    return S.normalize_export(s, text_of(s, d, body)).select(*PAIR)


@query("s23_normalize_psl", "SELECT 'p' || ordinal AS qname, CAST(flag & 16 AS INT) AS flag, rname, pos0, CASE mapq % 3 WHEN 0 THEN '2H10M20M4H' WHEN 1 THEN '2H10M3D20M4H' ELSE '2H10M5I20M4H' END AS cigar, CAST(greatest(30 - 3 * (mapq % 12) - CASE mapq % 3 WHEN 0 THEN 0 WHEN 1 THEN 11 ELSE 15 END, 0) AS INT) AS score FROM fx_aln")
def _(s, d):
    gap = "CASE mapq % 3 WHEN 2 THEN 5 ELSE 0 END"
    body = f"SELECT concat_ws('\t', 30, mapq % 12, 0, 0, 0, 0, 0, 0, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END, concat('p', ordinal), 36 + {gap}, 2, 32, rname, 99999, pos0, pos0 + 30, 2, '10,20,', concat('2,', 12 + {gap}, ','), concat(pos0, ',', pos0 + 10 + CASE mapq % 3 WHEN 1 THEN 3 ELSE 0 END, ',')) AS value FROM fx_aln"
    return S.normalize_psl(s, text_of(s, d, body, ("psLayout version 3",))).select("qname", "flag", "rname", "pos0", "cigar", "score")


@query("s26_read_contigs", "SELECT CAST(row_number() OVER (ORDER BY chrom) - 1 AS INT) AS tid, chrom AS name, max(end1) AS length FROM fx_exon GROUP BY chrom")
def _(s, d):
    rows = exon_rows(s, d).groupBy("chrom").agg(F.max("end1").alias("n")).orderBy("chrom").coalesce(1)  # five lines
    return S.read_contigs(s, text_of(s, d, rows.select(F.concat_ws("\t", "chrom", "n").alias("value"))))


@query("m05_tile_segments", "SELECT contig AS chrom, b AS start0, b + 60 AS end1, b + j AS pos0, substr(seq, CAST(b + j + 1 AS INT), 36) AS seq FROM (SELECT *, unnest(range(0, 25)) AS j FROM pl WHERE b + 60 <= length(seq))", WHOLE)
def _(s, d):
    blocks = places(s, d).filter("b + 60 <= length(seq)").select(F.col("contig").alias("chrom"), F.col("b").alias("start0"), (F.col("b") + 60).alias("end1"))
    return M.tile_segments(blocks, whole_chunks(s, d), 36)


@query(
    "x02_text_functions",
    """SELECT p_partkey, upper(p_name) AS up, array_to_string(list_filter(string_split(replace(p_name, 'l', ' '), ' '), lambda x: x <> ''), '|') AS parts, CASE WHEN contains(p_name, 'e') THEN reverse(regexp_replace(reverse(p_name), 'e', '33')) ELSE p_name END AS last_e, trim(p_name, 'cdst') AS stripped,
replace(replace(p_brand || chr(9) || chr(34), chr(9), chr(92) || 't'), chr(34), chr(92) || chr(34)) AS escaped, substr(p_name, 1, CASE WHEN substr(p_name, 1, 1) <> substr(p_type, 1, 1) THEN 0 ELSE 1 END) AS common, length(p_name) AS shuffled FROM part""",
)
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    t = F.col("p_name")
    same = Q.common_prefix(t, F.col("p_type"))
    mixed = Q.shuffle_characters(t, 3)
    again = F.when(F.array_join(F.array_sort(F.split(mixed, "")), "") == F.array_join(F.array_sort(F.split(t, "")), ""), F.length(mixed)).cast("long")
    return p.select("p_partkey", F.upper(t).alias("up"), F.array_join(Q.split_nonempty(F.replace(t, F.lit("l"), F.lit(" ")), " "), "|").alias("parts"), Q.replace_last(t, "e", "33").alias("last_e"), Q.strip(t, "cdst").alias("stripped"), Q.escape_text(F.concat("p_brand", F.lit('\t"'))).alias("escaped"), same.alias("common"), again.alias("shuffled"))


@query("x03_parse_numbers", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS as_int, TRY_CAST(p_retailprice || CASE WHEN p_size % 5 = 0 THEN 'x' ELSE '' END AS DOUBLE) AS as_float, TRY_CAST(p_brand AS BIGINT) AS none FROM part")
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", Q.parse_int(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("as_int"), Q.parse_float(F.concat(F.col("p_retailprice").cast("string"), F.when(F.col("p_size") % 5 == 0, "x").otherwise(""))).alias("as_float"), Q.parse_int(F.col("p_brand")).alias("none"))


BOUNDS = {"bd": "SELECT chrom, start0 AS s1, end1 AS e1, start0 + start0 % 700 AS s2, end1 + start0 % 700 - 50 AS e2 FROM fx_exon"}


@query("x05_bound_columns", "SELECT chrom, s1, e1, CASE WHEN s1 < e2 AND s2 < e1 AND s2 < e2 THEN greatest(s1, s2) END AS common0, CASE WHEN s1 < e2 AND s2 < e1 AND s2 < e2 THEN least(e1, e2) END AS common1, least(s1, s2) AS wide0, greatest(e1, e2) AS wide1, s2 >= s1 AND e2 <= e1 AS inside, e1 <= s2 AS before FROM bd", BOUNDS)
def _(s, d):
    b = sql(s, d, f"SELECT * FROM ({BOUNDS['bd']})")
    c = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    one, wide = B.overlap_bound(*c), B.expand_bound(*c)
    return b.select("chrom", "s1", "e1", one["start0"].alias("common0"), one["end1"].alias("common1"), wide["start0"].alias("wide0"), wide["end1"].alias("wide1"), B.contained_in(c[2], c[3], c[0], c[1]).alias("inside"), B.is_left_of(c[1], c[2]).alias("before"))


@query("x06_reference_end", "SELECT ordinal, pos0 + CASE cigar WHEN '20M1D16M' THEN 37 WHEN '18M2I16M' THEN 34 WHEN '10M100N26M' THEN 136 WHEN '4S32M' THEN 32 ELSE 36 END AS end1, CAST(36 AS BIGINT) AS query_length FROM fx_aln")
def _(s, d):
    c = L.parse_cigar(F.col("cigar"))
    return aln(s, d).select("ordinal", L.reference_end(F.col("pos0"), c).alias("end1"), L.query_length(c).alias("query_length"))


@query("x07_parse_region", "SELECT DISTINCT chrom, start0, CASE start0 % 3 WHEN 0 THEN 0 ELSE start0 END AS region_start0, CASE start0 % 3 WHEN 2 THEN end1 END AS region_end1 FROM fx_exon")
def _(s, d):
    e = exon_rows(s, d)
    text = F.when(F.col("start0") % 3 == 0, F.col("chrom")).when(F.col("start0") % 3 == 1, F.concat("chrom", F.lit(":"), F.format_number(F.col("start0") + 1, 0))).otherwise(F.concat("chrom", F.lit(":"), F.col("start0") + 1, F.lit("-"), F.format_number("end1", 0)))
    p = B.parse_region(text)
    return e.select("chrom", "start0", p["start0"].alias("region_start0"), p["end1"].alias("region_end1")).distinct()


@query("x11_quality_sum", "SELECT ordinal, CAST(CASE WHEN mapq % 40 >= 15 THEN 36 * (mapq % 40) ELSE 0 END AS BIGINT) AS quality FROM fx_aln")
def _(s, d):
    return with_bases(s, d).select("ordinal", L.quality_sum(L.decode_quality(F.col("qual"))).alias("quality"))


@query("x12_iupac", "SELECT chrom, pos1, CASE cons WHEN 'M' THEN 'AC' WHEN 'R' THEN 'AG' WHEN 'W' THEN 'AT' WHEN 'S' THEN 'CG' WHEN 'Y' THEN 'CT' WHEN 'K' THEN 'GT' ELSE cons END AS bases, cons AS code FROM cn WHERE ref <> '*'", CNS)
def _(s, d):
    c = calls(s, d).filter("ref <> '*'")
    return c.select("chrom", "pos1", Q.bases_of(F.lower("cons")).alias("bases"), Q.iupac_of(Q.bases_of(F.col("cons"))).alias("code"))


@query("x13_normalize_bases", "SELECT contig, seq FROM fx_whole")
def _(s, d):
    other = F.replace(F.translate(F.lower("seq"), "t", "u"), F.lit("n"), F.lit("."))
    return view(s, d, "fx_whole").select("contig", Q.normalize_bases(other).alias("seq"))
