"""Queries of alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as L
from ..functions import bounds as B
from ..operators import alignments as R
from .fixtures import PLACED, sql, view
from .registry import query

REF_LEN = "CAST((CASE cigar WHEN '20M1D16M' THEN 37 WHEN '18M2I16M' THEN 34 WHEN '10M100N26M' THEN 136 WHEN '4S32M' THEN 32 ELSE 36 END) AS BIGINT)"
PARTS = {
    "al": f"SELECT *, pos0 + {REF_LEN} AS end0 FROM fx_aln",
    "kp": "SELECT * FROM al WHERE flag & 1796 = 0",
    "st": """SELECT ordinal, rname, mapq, pos0 AS s0, pos0 + CASE cigar WHEN '20M1D16M' THEN 37 WHEN '18M2I16M' THEN 34 WHEN '10M100N26M' THEN 10 WHEN '4S32M' THEN 32 ELSE 36 END AS e1 FROM kp
UNION ALL SELECT ordinal, rname, mapq, pos0 + 110, pos0 + 136 FROM kp WHERE cigar = '10M100N26M'""",
    "px": "SELECT ordinal, rname, mapq, unnest(range(s0, e1)) AS pos0 FROM st",
}
LEAD = "flag & 1 <> 0 AND flag & 12 = 0 AND rname = mrnm AND isize > 0"


def aln(s, d):
    return view(s, d, "fx_aln")


def placed_aln(s, d):
    return sql(s, d, PLACED)


@query("f01_view", "SELECT ordinal, qname, flag FROM fx_aln WHERE flag & 1 = 1 AND flag & 1540 = 0 AND mapq >= 20")
def _(s, d):
    return R.view(aln(s, d), 1, 1540, 20).select("ordinal", "qname", "flag")


GROUPED = "SELECT ordinal, library, CASE WHEN mapq % 5 = 0 THEN NULL ELSE 'g' || (mapq % 3) END AS rg FROM fx_aln"


@query("f02_view_read_groups", "SELECT * FROM g WHERE (rg IS NULL OR rg IN ('g1', 'g2')) AND library = 'lib1'", {"g": GROUPED})
def _(s, d):
    g = aln(s, d).withColumn("rg", F.when(F.col("mapq") % 5 != 0, F.concat(F.lit("g"), F.col("mapq") % 3)))
    return R.view(g, read_groups=["g1", "g2"], library="lib1").select("ordinal", "library", "rg")


REGIONS = {"rg": "SELECT * FROM (VALUES ('chr1', 0, 5000), ('chr1', 3000, 9000), ('chr2', 2000, 536870912), ('chr9', 0, 10)) t(chrom, s0, e1)"}


@query("f03_view_regions", "SELECT ordinal, s0, e1 FROM al JOIN rg ON rname = chrom AND pos0 < e1 AND end0 > s0", {"al": PARTS["al"]} | REGIONS)
def _(s, d):
    regions = s.createDataFrame([("chr1:1-5,000",), ("chr1:3001-9000",), ("chr2:2001",), ("chr9:1-10",)], "r string").select(B.parse_region(F.col("r")).alias("p")).select("p.*")
    return R.view_regions(aln(s, d), regions).select("ordinal", F.col("r_start0").cast("int").alias("s0"), F.col("r_end1").cast("int").alias("e1"))


@query("f05_flag_letters", "SELECT ordinal, " + " || ".join(f"CASE WHEN flag & {1 << i} <> 0 THEN '{x}' ELSE '' END" for i, x in enumerate("pPuUrR12sfd")) + " AS letters, '0x' || lower(to_hex(flag)) AS hex FROM fx_aln")
def _(s, d):
    return aln(s, d).select("ordinal", L.flag_letters(F.col("flag")).alias("letters"), L.flag_hex(F.col("flag")).alias("hex"))


@query("f06_tag_view", "SELECT qname, flag, CAST(mapq % 7 AS VARCHAR) AS value FROM fx_aln WHERE mapq % 4 <> 0")
def _(s, d):
    tag = F.struct(F.lit("i").alias("type"), (F.col("mapq") % 7).cast("string").alias("value"))
    aux = F.when(F.col("mapq") % 4 != 0, F.create_map(F.lit("NM"), tag)).otherwise(F.create_map().cast("map<string,struct<type:string,value:string>>"))
    return R.tag_view(aln(s, d).withColumn("aux", aux), "NM")


@query("f07_solexa_to_sanger", "SELECT ordinal, CAST(least(floor(10 * log10(pow(10, mapq / 10.0) + 1) + 0.499), 93) AS INT) AS q FROM fx_aln")
def _(s, d):
    return aln(s, d).select("ordinal", F.element_at(L.solexa_to_sanger(F.array(F.col("mapq"))), 1).alias("q"))


@query("f09_mask_reads", "SELECT ordinal FROM fx_aln WHERE flag & 1796 = 0")
def _(s, d):
    return R.mask_reads(aln(s, d)).select("ordinal")


@query("f12_alignment_length", "SELECT ordinal, CAST(CASE cigar WHEN '18M2I16M' THEN 36 WHEN '4S32M' THEN 32 ELSE 36 END AS BIGINT) AS alen, " + REF_LEN + " AS rlen, CAST(36 AS BIGINT) AS qlen FROM fx_aln")
def _(s, d):
    c = L.parse_cigar(F.col("cigar"))
    return aln(s, d).select("ordinal", L.alignment_length(c).alias("alen"), L.reference_length(c).alias("rlen"), L.query_length(c).alias("qlen"))


@query("x09_five_prime", "SELECT ordinal, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CASE WHEN flag & 16 <> 0 THEN end0 ELSE pos0 END AS five FROM al", {"al": PARTS["al"]})
def _(s, d):
    return aln(s, d).select("ordinal", L.strand_of(F.col("flag")).alias("strand"), L.five_prime(F.col("pos0"), F.col("flag"), L.parse_cigar(F.col("cigar"))).alias("five"))


@query("a09_flagstat", """SELECT *, round(mapped * 100.0 / total, 2)::DOUBLE AS mapped_pct, round(proper * 100.0 / paired, 2)::DOUBLE AS proper_pct, round(singletons * 100.0 / paired, 2)::DOUBLE AS singletons_pct FROM (SELECT count(*) AS total,
count(*) FILTER (flag & 512 <> 0) AS failed, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1 <> 0) AS paired,
count(*) FILTER (flag & 1 <> 0 AND flag & 64 <> 0) AS read1, count(*) FILTER (flag & 1 <> 0 AND flag & 128 <> 0) AS read2, count(*) FILTER (flag & 1 <> 0 AND flag & 2 <> 0) AS proper,
count(*) FILTER (flag & 1 <> 0 AND flag & 12 = 0) AS both_mapped, count(*) FILTER (flag & 1 <> 0 AND flag & 12 = 8) AS singletons,
count(*) FILTER (flag & 1 <> 0 AND flag & 12 = 0 AND mrnm <> rname) AS other_contig, count(*) FILTER (flag & 1 <> 0 AND flag & 12 = 0 AND mrnm <> rname AND mapq >= 5) AS other_contig_q5 FROM fx_aln)""")
def _(s, d):
    return R.flagstat(aln(s, d))


@query("a10_idxstats", "SELECT name, CAST(CASE name WHEN '*' THEN 0 ELSE 1000000 END AS BIGINT) AS length, count(flag) FILTER (flag & 4 = 0) AS mapped, count(flag) FILTER (flag & 4 <> 0) AS unmapped FROM (VALUES ('chr1'), ('chr2'), ('chr3'), ('chr4'), ('chr5'), ('chr6'), ('*')) t(name) LEFT JOIN fx_aln ON rname = name GROUP BY name")
def _(s, d):
    contigs = s.createDataFrame([(f"chr{i}", 1_000_000) for i in range(1, 7)], "name string, length long")
    return R.idxstats(aln(s, d), contigs)


@query("a11_depth", "SELECT rname, pos0, count(*) AS depth FROM px GROUP BY ALL", PARTS)
def _(s, d):
    return R.depth(aln(s, d))


def with_bases(s, d, rows=aln):
    q = F.col("ordinal") % 4
    base = lambda k: F.element_at(F.array(*map(F.lit, "ACGT")), ((q + k) % 4 + 1).cast("int"))
    return rows(s, d).withColumns({"seq": F.repeat(F.concat(*(base(k) for k in range(4))), 9), "qual": F.repeat(F.char(F.col("mapq") % 40 + 33), 36)})


@query("a12_pileup", "SELECT rname, pos0, count(*) AS depth, string_agg(chr(least(mapq, 93) + 33), '' ORDER BY ordinal) AS mapqs FROM px GROUP BY ALL", PARTS)
def _(s, d):
    return R.pileup(with_bases(s, d, placed_aln), columns=("depth", "mapqs"))


#: Stretches of the five CIGARs (place on the reference, place in the read, length, kind), and what each read shows at each place.
SHOWN = {
    "sr": "SELECT * FROM (VALUES ('36M', 0, 0, 36, 'M', 36), ('20M1D16M', 0, 0, 20, 'M', 37), ('20M1D16M', 20, 20, 1, 'D', 37), ('20M1D16M', 21, 20, 16, 'M', 37), ('18M2I16M', 0, 0, 18, 'M', 34), ('18M2I16M', 18, 20, 16, 'M', 34), ('10M100N26M', 0, 0, 10, 'M', 136), ('10M100N26M', 110, 10, 26, 'M', 136), ('4S32M', 0, 4, 32, 'M', 32)) t(cigar, r, q, n, kind, rl)",
    "sp": "SELECT *, unnest(range(0, n)) AS i, repeat(substr('ACGTACGT', CAST(ordinal % 4 + 1 AS INT), 4), 9) AS sq FROM fx_aln JOIN sr USING (cigar) WHERE flag & 1796 = 0",
    "sh": """SELECT rname, pos0 + r + i AS pos0, ordinal, CASE WHEN r + i = 0 THEN '^' || chr(least(mapq, 93) + 33) ELSE '' END || CASE WHEN kind = 'D' THEN '*' WHEN flag & 16 <> 0 THEN lower(substr(sq, CAST(q + i + 1 AS INT), 1)) ELSE substr(sq, CAST(q + i + 1 AS INT), 1) END
|| CASE WHEN cigar = '18M2I16M' AND r + i = 17 THEN '+2' || substr(sq, 19, 2) ELSE '' END || CASE WHEN r + i = rl - 1 THEN '$' ELSE '' END AS t, CASE WHEN kind = 'D' THEN '!' ELSE chr(mapq % 40 + 33) END AS qc, CASE WHEN (cigar = '18M2I16M' AND r + i = 17) OR (cigar = '20M1D16M' AND r + i = 19) THEN 1 ELSE 0 END AS indel FROM sp""",
}


@query("a12_pileup_strings", "SELECT rname, pos0, count(*) AS depth, string_agg(t, '' ORDER BY ordinal, t, qc) AS bases, string_agg(qc, '' ORDER BY ordinal, t, qc) AS quals, CAST(sum(indel) AS INT) AS indels FROM sh GROUP BY rname, pos0", SHOWN)
def _(s, d):
    return R.pileup(with_bases(s, d), columns=("depth", "bases", "quals", "indels"))


SECOND = {"sr": SHOWN["sr"], "sp": SHOWN["sp"]} | {"sc": "SELECT rname, pos0 + r + i AS pos0, ordinal, CASE WHEN mapq % 3 = 0 THEN 'N' ELSE substr(translate(sq, 'ACGT', 'CGTA'), CAST(q + i + 1 AS INT), 1) END AS b, CASE WHEN mapq % 3 = 0 THEN '!' ELSE chr(mapq % 30 + 40) END AS qc FROM sp WHERE cigar <> '20M1D16M'"}


@query("a12_second_calls", "SELECT rname, pos0, string_agg(b, '' ORDER BY ordinal, b, qc) AS bases2, string_agg(qc, '' ORDER BY ordinal, b, qc) AS quals2 FROM sc GROUP BY rname, pos0", SECOND)
def _(s, d):
    tag = lambda value: F.struct(F.lit("Z").alias("type"), value.alias("value"))
    aux = F.when(F.col("mapq") % 3 != 0, F.create_map(F.lit("E2"), tag(F.translate("seq", "ACGT", "CGTA")), F.lit("U2"), tag(F.repeat(F.char(F.col("mapq") % 30 + 40), 36))))
    rows = with_bases(s, d).filter("cigar <> '20M1D16M'").withColumn("aux", aux)
    return R.pileup(rows, second_call=True, columns=())


@query("j09_mpileup", "SELECT rname, pos0, coalesce(a.n, 0) AS depth_a, coalesce(b.n, 0) AS depth_b FROM (SELECT rname, pos0, count(*) AS n FROM px WHERE ordinal % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT rname, pos0, count(*) AS n FROM px WHERE ordinal % 2 = 1 GROUP BY ALL) b USING (rname, pos0)", PARTS)
def _(s, d):
    a = with_bases(s, d)
    return R.mpileup({"a": a.filter("ordinal % 2 = 0"), "b": a.filter("ordinal % 2 = 1")}, columns=("depth",))


@query("a20_rms_mapq", "SELECT rname, pos0, CAST(floor(sqrt(sum(least(mapq, 60) * least(mapq, 60)) / count(*)) + 0.499) AS BIGINT) AS rms FROM px GROUP BY ALL", PARTS)
def _(s, d):
    return R.rms_mapq(aln(s, d))


@query("w12_pileup_marks", "SELECT p.rname, p.pos0, count(*) FILTER (p.pos0 = k.pos0) AS heads, count(*) FILTER (p.pos0 = k.end0 - 1) AS tails FROM px p JOIN kp k USING (ordinal) GROUP BY ALL", PARTS)
def _(s, d):
    n = lambda c: F.sum(F.col(c).cast("int"))
    return R.pileup_marks(aln(s, d)).groupBy("rname", "site_bin", "pos0").agg(n("is_head").alias("heads"), n("is_tail").alias("tails")).drop("site_bin")


@query("a14_rmdup_pe", "SELECT ordinal FROM fx_aln a WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.ordinal = a.ordinal) AND NOT (flag & 1 <> 0 AND flag & 12 = 0 AND rname = mrnm AND isize < 0 AND EXISTS (SELECT 1 FROM lost WHERE lost.qname = a.qname AND lost.rname = a.rname AND lost.library = a.library))", {"lost": f"SELECT ordinal, qname, rname, library FROM (SELECT *, row_number() OVER (PARTITION BY library, rname, pos0, isize ORDER BY qsum DESC, ordinal) AS r FROM fx_aln WHERE {LEAD}) WHERE r > 1"})
def _(s, d):
    return R.rmdup_pe(aln(s, d)).select("ordinal")


@query("a15_rmdup_se", "SELECT ordinal FROM (SELECT ordinal, row_number() OVER (PARTITION BY library, rname, flag & 16, CASE WHEN flag & 16 <> 0 THEN end0 ELSE pos0 END ORDER BY qsum DESC, ordinal) AS r FROM al WHERE flag & 4 = 0) WHERE r = 1 UNION ALL SELECT ordinal FROM al WHERE flag & 4 <> 0", {"al": PARTS["al"]})
def _(s, d):
    return R.rmdup_se(aln(s, d), force=True).select("ordinal")


@query("a16_dup_report", f"SELECT library, CAST(sum(n) AS BIGINT) AS checked, CAST(sum(n - 1) AS BIGINT) AS removed FROM (SELECT library, rname, pos0, isize, count(*) AS n FROM fx_aln WHERE {LEAD} GROUP BY ALL) GROUP BY library")
def _(s, d):
    return R.dup_report(aln(s, d))


@query("a17_mapping_accuracy", "SELECT *, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(wrong) OVER w AS BIGINT) AS cum_wrong FROM (SELECT CAST(floor(mapq / 10) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (NOT (ordinal % 3 <> 0 AND abs((pos0 + ordinal % 9) - (pos0 - CASE WHEN cigar = '4S32M' THEN 4 ELSE 0 END)) <= 5)) AS wrong FROM fx_aln WHERE flag & 4 = 0 GROUP BY 1) WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    named = aln(s, d).withColumn("qname", F.concat_ws("_", F.when(F.col("ordinal") % 3 == 0, "chrX").otherwise(F.col("rname")), F.col("pos0") + F.col("ordinal") % 9 + 1, F.lit("x")))
    return R.mapping_accuracy(named)


MATES = {
    "o": "SELECT *, CASE WHEN flag & 16 <> 0 THEN end0 ELSE pos0 END AS five, row_number() OVER w - 1 AS n, lead(ordinal) OVER w AS nx, lag(ordinal) OVER w AS pv FROM al WINDOW w AS (PARTITION BY qname ORDER BY ordinal)",
    "m": "SELECT o.*, x.rname AS m_rname, x.pos0 AS m_pos0, x.flag AS m_flag, x.five AS m_five, x.ordinal IS NOT NULL AS has FROM o LEFT JOIN o x ON x.ordinal = CASE WHEN o.n % 2 = 0 THEN o.nx ELSE o.pv END",
}


@query("j10_fix_mates", """SELECT ordinal, coalesce(m_rname, '*') AS mrnm, coalesce(m_pos0, -1) AS mpos0, CAST(CASE WHEN has AND flag & 4 = 0 AND m_flag & 4 = 0 AND rname = m_rname THEN m_five - five ELSE 0 END AS BIGINT) AS isize,
CAST(CASE WHEN NOT has THEN flag & ~42 WHEN flag & 4 <> 0 OR m_flag & 4 <> 0 THEN ((flag & ~40) | (CASE WHEN m_flag & 16 <> 0 THEN 32 ELSE 0 END) | (CASE WHEN m_flag & 4 <> 0 THEN 8 ELSE 0 END)) & ~2 ELSE (flag & ~40) | (CASE WHEN m_flag & 16 <> 0 THEN 32 ELSE 0 END) END AS INT) AS flag FROM m""", {"al": PARTS["al"]} | MATES)
def _(s, d):
    return R.fix_mates(placed_aln(s, d)).select("ordinal", "mrnm", "mpos0", "isize", "flag")


@query("j08_compare_alignments", """SELECT """ + ", ".join(f"count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND {'' if n == 'same' else 'NOT '}(sa = sb AND ra = rb AND abs(pa - pb) < 100) AND {'' if x == 'hi' else 'NOT '}qa >= 10 AND {'' if y == 'hi' else 'NOT '}qb >= 10) AS {n}_{x}_{y}" for n in ("same", "diff") for x in ("hi", "lo") for y in ("hi", "lo")) + """, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM
(SELECT qname, max(ordinal) AS a, arg_max(rname, ordinal) AS ra, arg_max(pos0, ordinal) AS pa, arg_max(flag & 16, ordinal) AS sa, arg_max(mapq, ordinal) AS qa FROM fx_aln WHERE ordinal % 5 <> 0 GROUP BY qname)
FULL JOIN (SELECT qname, max(ordinal) AS b, arg_max(rname, ordinal) AS rb, arg_max(pos0, ordinal) AS pb, arg_max(flag & 16, ordinal) AS sb, arg_max(mapq, ordinal) AS qb FROM fx_aln WHERE ordinal % 7 <> 0 GROUP BY qname) USING (qname)""")
def _(s, d):
    a = aln(s, d)
    return R.compare_alignments(a.filter("ordinal % 5 <> 0"), a.filter("ordinal % 7 <> 0"))


@query("w07_best_hit", "SELECT qname, ordinal, CAST(least(floor(250.0 * (qsum + 1 - coalesce(nx + 1, 0)) / (qsum + 1) + 0.499), 250) AS INT) AS mapq FROM (SELECT *, row_number() OVER w AS r, lead(qsum) OVER w AS nx FROM fx_aln WINDOW w AS (PARTITION BY qname ORDER BY qsum DESC, ordinal)) WHERE r = 1")
def _(s, d):
    return R.best_hit(aln(s, d).withColumn("score", F.col("qsum") + 1)).select("qname", "ordinal", "mapq")


COVERED = {"al": PARTS["al"], "sp": "SELECT rname, pos0 AS s, CASE WHEN flag & 2 <> 0 THEN pos0 + isize ELSE end0 END AS e FROM al WHERE flag & 4 = 0 AND (flag & 2 = 0 OR isize > 0)", "dd": "SELECT rname, pos, sum(dl) AS dl FROM (SELECT rname, s AS pos, 1 AS dl FROM sp UNION ALL SELECT rname, e, -1 FROM sp) GROUP BY ALL"}


@query("w08_physical_coverage", "SELECT rname, CAST(sum(depth * (end1 - start0)) AS BIGINT) AS bases, CAST(max(depth) AS BIGINT) AS top FROM (SELECT rname, pos AS start0, lead(pos) OVER (PARTITION BY rname ORDER BY pos) AS end1, sum(dl) OVER (PARTITION BY rname ORDER BY pos) AS depth FROM dd) WHERE end1 IS NOT NULL GROUP BY rname", COVERED)
def _(s, d):
    c = R.physical_coverage(aln(s, d))
    return c.groupBy("rname").agg(F.sum(F.col("depth") * (F.col("end1") - F.col("start0"))).cast("long").alias("bases"), F.max("depth").cast("long").alias("top"))


@query("w08_coverage_runs", "SELECT rname, start0, end1, CAST(depth AS BIGINT) AS depth FROM (SELECT rname, pos AS start0, lead(pos) OVER (PARTITION BY rname ORDER BY pos) AS end1, sum(dl) OVER (PARTITION BY rname ORDER BY pos) AS depth FROM dd) WHERE end1 IS NOT NULL AND depth > 0", COVERED)
def _(s, d):
    return R.physical_coverage(aln(s, d))


@query("j12_with_library", "SELECT ordinal, CASE WHEN mapq % 4 < 3 THEN 'L' || (mapq % 4) END AS lib FROM fx_aln")
def _(s, d):
    groups = s.createDataFrame([(f"g{i}", f"L{i}") for i in range(3)], "rg_id string, library string")
    return R.with_library(aln(s, d).drop("library").withColumn("rg", F.concat(F.lit("g"), F.col("mapq") % 4)), groups).select("ordinal", F.col("library").alias("lib"))


@query("j07_restrict_sites", "SELECT ordinal, rname, pos0 FROM fx_aln WHERE pos0 % 150 = 10")
def _(s, d):
    a = aln(s, d)
    return R.restrict_sites(a, a.filter("pos0 % 150 = 10").select(F.col("rname").alias("chrom"), (F.col("pos0") + 1).alias("pos1"))).select("ordinal", "rname", "pos0")


@query("t01_sort_coordinate", "SELECT ordinal, rname, pos0 FROM fx_aln ORDER BY rname, pos0, ordinal")
def _(s, d):
    return R.sort_coordinate(aln(s, d)).select("ordinal", "rname", "pos0")


@query("t02_sort_name", "SELECT qname, ordinal FROM fx_aln ORDER BY CAST(substr(qname, 2) AS BIGINT), flag & 192, ordinal")
def _(s, d):
    return R.sort_name(aln(s, d)).select("qname", "ordinal")


@query("t05_merge_alignments", "SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN 'own' WHEN ordinal % 2 = 0 THEN 'a' ELSE 'b' END AS rg FROM fx_aln")
def _(s, d):
    a = aln(s, d).withColumn("rg", F.when(F.col("ordinal") % 3 == 0, "own"))
    return R.merge_alignments({"a": a.filter("ordinal % 2 = 0"), "b": a.filter("ordinal % 2 = 1")}, add_rg=True).select("ordinal", "rg")


@query("t06_top_per_key", "SELECT library, rname, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY library, rname ORDER BY qsum DESC, ordinal) AS r FROM fx_aln) WHERE r = 1")
def _(s, d):
    return R.top_per_key(aln(s, d), ["library", "rname"], [F.desc("qsum"), "ordinal"]).select("library", "rname", "ordinal")


@query("t07_cap_depth", "SELECT rname, pos0, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY rname, pos0 ORDER BY ordinal) AS r FROM fx_aln) WHERE r <= 2")
def _(s, d):
    return R.cap_depth(aln(s, d), 2).select("rname", "pos0", "ordinal")


@query("s15_to_bed", "SELECT rname AS chrom, pos0 AS start0, end0 AS end1, qname AS name, mapq AS score, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM al WHERE flag & 4 = 0", {"al": PARTS["al"]})
def _(s, d):
    return R.to_bed(aln(s, d))


BASES = {"wb": "SELECT *, repeat(substr('ACGTACG', CAST(ordinal % 4 + 1 AS INT), 4), 9) AS seq, repeat(chr(mapq % 40 + 33), 36) AS qual FROM fx_aln"}


@query("s17_to_fastq", "SELECT qname || CASE WHEN flag & 64 <> 0 THEN '/1' WHEN flag & 128 <> 0 THEN '/2' ELSE '' END AS name, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, qual FROM wb", BASES)
def _(s, d):
    return R.to_fastq(with_bases(s, d))
