"""Queries of consensus and variant operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as V
from ..operators.variant_filter import variant_filter
from .fixtures import view, whole_chunks
from .queries_alignments import with_bases
from .registry import alias, query

PLAIN = {
    "el": "SELECT rname AS chrom, pos0 + i AS pos0, ordinal, substr('ACGT', CAST((ordinal % 4 + i) % 4 + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(0, 36)) AS i FROM fx_aln WHERE cigar = '36M' AND flag & 1796 = 0)",
}


def elements(s, d):
    return V.site_elements(with_bases(s, d).filter("cigar = '36M'"))


def all_elements(s, d):
    return V.site_elements(with_bases(s, d))


#: Aligned stretches (place on the reference, place in the read, length) of the five CIGARs.
STRETCHES = {
    "st": "SELECT * FROM (VALUES ('36M', 0, 0, 36), ('20M1D16M', 0, 0, 20), ('20M1D16M', 21, 20, 16), ('18M2I16M', 0, 0, 18), ('18M2I16M', 18, 20, 16), ('10M100N26M', 0, 0, 10), ('10M100N26M', 110, 10, 26), ('4S32M', 0, 4, 32)) t(cigar, r, q, n)",
    "el": "SELECT rname AS chrom, pos0 + r + i AS pos0, ordinal, substr('ACGT', CAST((ordinal % 4 + q + i) % 4 + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(0, n)) AS i FROM fx_aln JOIN st USING (cigar) WHERE flag & 1796 = 0)",
}


@query("c03_first_base_all", "SELECT chrom, pos0, arg_min(base, ordinal) AS cons FROM el GROUP BY ALL", STRETCHES)
def _(s, d):
    return V.cheap_consensus(all_elements(s, d), "first")


CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.bases_of.__globals__["IUPAC"].items())


@query("c03_union_bases_all", f"SELECT chrom, pos0, CASE string_agg(DISTINCT base, '' ORDER BY base) {CODES} END AS cons FROM el GROUP BY ALL", STRETCHES)
def _(s, d):
    return V.cheap_consensus(all_elements(s, d), "union")


@query("c06_indel_sites", "SELECT rname, pos0 FROM (SELECT rname, pos0 + CASE cigar WHEN '20M1D16M' THEN 19 ELSE 17 END AS pos0 FROM fx_aln WHERE flag & 1796 = 0 AND cigar IN ('20M1D16M', '18M2I16M')) GROUP BY ALL")
def _(s, d):
    from ..operators.alignments import pileup

    return V.indel_sites(pileup(with_bases(s, d), columns=("indels",))).select("rname", "pos0")


#: Likelihoods by independent errors: what each base of a site counts with, summed by base, and the ten genotypes.
_ONE = ", ".join(f"sum(CASE WHEN base = '{b}' THEN f * q ELSE 0 END) AS e{b}, sum(CASE WHEN base = '{b}' AND q > 0 THEN 1 ELSE 0 END) AS n{b}" for b in V.BASES)
_TEN = ", ".join(" + ".join(f"e{b}" for b in V.BASES if b not in g) + ("" if g[0] == g[1] else f" + {V.SCALE} * ln(2) * (n{g[0]} + n{g[1]})") for g in V.GENOTYPES)
LIKELY = {
    "sr": "SELECT * FROM (VALUES ('36M', 0, 0, 36, 'M'), ('20M1D16M', 0, 0, 20, 'M'), ('20M1D16M', 20, 20, 1, 'D'), ('20M1D16M', 21, 20, 16, 'M'), ('18M2I16M', 0, 0, 18, 'M'), ('18M2I16M', 18, 20, 16, 'M'), ('10M100N26M', 0, 0, 10, 'M'), ('10M100N26M', 110, 10, 26, 'M'), ('4S32M', 0, 4, 32, 'M')) t(cigar, r, q0, n, kind)",
    "se": "SELECT rname AS chrom, pos0 + r + i AS pos0, ordinal, flag & 16 AS minus, mapq, mapq % 40 AS bq, CASE WHEN kind = 'M' THEN substr('ACGT', CAST((ordinal % 4 + q0 + i) % 4 + 1 AS INT), 1) END AS base FROM (SELECT *, unnest(range(0, n)) AS i FROM fx_aln JOIN sr USING (cigar) WHERE flag & 1796 = 0)",
    "sq": "SELECT *, CASE WHEN base IS NULL THEN 0 WHEN least(bq, mapq) < 4 AND bq > 0 THEN 4 ELSE least(bq, mapq) END AS q FROM se",
    "sf": "SELECT *, CASE WHEN k = 0 THEN 1.0 ELSE pow(0.85, k) * 0.97 + 0.03 END AS f FROM (SELECT *, least(row_number() OVER (PARTITION BY chrom, pos0, minus, base ORDER BY q DESC, bq DESC, ordinal) - 1, 255) AS k FROM sq)",
    "sg": f"SELECT chrom, pos0, count(*) AS depth, CAST(floor(sqrt(avg(least(mapq, 60) * least(mapq, 60))) + 0.499) AS INT) AS rms_mapq, {_ONE} FROM sf GROUP BY chrom, pos0",
    "sv": f"SELECT chrom, pos0, depth, rms_mapq, [{_TEN}] AS v FROM sg",
    "lk": "SELECT chrom, pos0, depth, rms_mapq, list_transform(v, lambda x: CAST(least(floor(x - list_min(v) + 0.5), 255) AS INT)) AS lk FROM sv",
}
_CODES = "['A', 'M', 'R', 'W', 'C', 'S', 'Y', 'G', 'K', 'T']"
CALLED = LIKELY | {
    "rl": f"SELECT chrom, pos0, depth, rms_mapq, list_sort(list_transform(range(1, 11), lambda i: {{'v': lk[i] + CASE WHEN i IN (1, 5, 8, 10) THEN 0 ELSE {V.heterozygote_prior()} END, 'i': i}})) AS r FROM lk",
}


@query("c01_genotype_likelihoods", "SELECT * FROM lk", LIKELY)
def _(s, d):
    return V.read_likelihoods(with_bases(s, d))


@query("c01_genotype_likelihoods_maq")
def _(s, d):
    return V.read_likelihoods(with_bases(s, d), model="maq")


@query("c02_consensus", f"SELECT chrom, pos0, depth, rms_mapq, {_CODES}[r[1].i] AS cons, {_CODES}[r[2].i] AS second, CAST(least(r[2].v - r[1].v, 255) AS INT) AS cons_q, CAST(least(r[3].v - r[2].v, 255) AS INT) AS next_q FROM rl", CALLED)
def _(s, d):
    return V.consensus(V.read_likelihoods(with_bases(s, d)))


CNS = {
    "cn": """SELECT rname AS chrom, pos0 + 1 AS pos1, CASE WHEN ordinal % 6 = 0 THEN '*' ELSE substr('ACGT', CAST(ordinal % 4 + 1 AS INT), 1) END AS ref,
CASE WHEN ordinal % 6 = 0 THEN CASE ordinal % 5 WHEN 0 THEN '*/-AC' WHEN 1 THEN '+T/+T' WHEN 2 THEN '-GG/-G' WHEN 3 THEN '*/*' ELSE '+A/*' END ELSE substr('ACGTMRWSYK', CAST(qsum % 10 + 1 AS INT), 1) END AS cons,
mapq AS cons_q, mapq + 5 AS snp_q, mapq AS rms_mapq, CAST(qsum % 60 AS INT) AS depth, CASE WHEN ordinal % 6 = 0 THEN '+C' ELSE '*' END AS a1, '*' AS a2, 1 AS cnt1, 2 AS cnt2 FROM fx_aln""",
}


def calls(s, d):
    o = F.col("ordinal")
    pick = lambda text, k: F.substr(F.lit(text), (k + 1).cast("int"), F.lit(1))
    gap, n = o % 6 == 0, o % 5
    indel = F.when(n == 0, "*/-AC").when(n == 1, "+T/+T").when(n == 2, "-GG/-G").when(n == 3, "*/*").otherwise("+A/*")
    return view(s, d, "fx_aln").select(
        F.col("rname").alias("chrom"), (F.col("pos0") + 1).alias("pos1"), F.when(gap, "*").otherwise(pick("ACGT", o % 4)).alias("ref"), F.when(gap, indel).otherwise(pick("ACGTMRWSYK", F.col("qsum") % 10)).alias("cons"),
        F.col("mapq").alias("cons_q"), (F.col("mapq") + 5).alias("snp_q"), F.col("mapq").alias("rms_mapq"), (F.col("qsum") % 60).cast("int").alias("depth"), F.when(gap, "+C").otherwise("*").alias("a1"), F.lit("*").alias("a2"), F.lit(1).alias("cnt1"), F.lit(2).alias("cnt2"),
    )


@query("c04_variants_only", "SELECT chrom, pos1, ref, cons FROM cn WHERE ref = '*' OR cons <> ref", CNS)
def _(s, d):
    return V.variants_only(calls(s, d)).select("chrom", "pos1", "ref", "cons")


@query(
    "c09_to_vcf",
    """SELECT chrom AS "CHROM", pos1 AS "POS", ref AS "REF", CASE WHEN length(b) = 1 THEN b WHEN b[1] = ref THEN b[2] WHEN b[2] = ref THEN b[1] ELSE b[1] || ',' || b[2] END AS "ALT", snp_q AS "QUAL", 'DP=' || depth AS "INFO",
CASE WHEN length(b) = 1 THEN '1/1' WHEN b[1] = ref OR b[2] = ref THEN '0/1' ELSE '1/2' END || ':' || cons_q || ':' || depth AS "SAMPLE" FROM (SELECT *, CASE cons WHEN 'M' THEN 'AC' WHEN 'R' THEN 'AG' WHEN 'W' THEN 'AT' WHEN 'S' THEN 'CG' WHEN 'Y' THEN 'CT' WHEN 'K' THEN 'GT' ELSE cons END AS b FROM cn WHERE ref <> '*' AND ref <> cons)
UNION ALL SELECT chrom, pos1, 'N', CASE ordering WHEN 0 THEN 'D2' WHEN 1 THEN 'IT' WHEN 2 THEN 'D2,D1' WHEN 3 THEN 'IC' ELSE 'IA' END, snp_q, 'DP=' || depth, CASE ordering WHEN 1 THEN '1/1' WHEN 2 THEN '1/2' ELSE '0/1' END || ':' || cons_q || ':' || depth FROM (SELECT *, CASE cons WHEN '*/-AC' THEN 0 WHEN '+T/+T' THEN 1 WHEN '-GG/-G' THEN 2 WHEN '*/*' THEN 3 ELSE 4 END AS ordering FROM cn WHERE ref = '*')""",
    CNS,
)
def _(s, d):
    c = calls(s, d)
    one = V.to_vcf(c, indels=False).unionByName(V.to_vcf(c.filter("ref = '*'")))
    return one.select("CHROM", "POS", "REF", "ALT", "QUAL", "INFO", "SAMPLE")


#: The filter's rules read in order of the sites: SNPs of a cluster that no window crosses are taken one after another.
FILTERED = CNS | {
    "vs": "SELECT *, row_number() OVER () AS id, ref = '*' AS gap FROM cn WHERE upper(ref) <> upper(cons) AND cons <> '*/*'",
    "va": """SELECT *, row_number() OVER (PARTITION BY chrom, pos1, gap ORDER BY cons, ref, snp_q, depth, rms_mapq, id) AS seq, CASE WHEN depth < 3 THEN 'd' WHEN depth > 100 THEN 'D' END AS poor, rms_mapq < CASE WHEN gap THEN 10 ELSE 25 END AS low,
CASE cons WHEN '*/-AC' THEN 2 WHEN '-GG/-G' THEN 2 ELSE 0 END AS gone, snp_q + 100 * (CASE WHEN a1 <> '*' THEN cnt1 ELSE 0 END + CASE WHEN a2 <> '*' THEN cnt2 ELSE 0 END) AS score FROM vs""",
    "vg": "SELECT * FROM va WHERE gap AND poor IS NULL",
    "vn": "SELECT a.*, EXISTS (SELECT 1 FROM vg g WHERE g.chrom = a.chrom AND g.score >= 25 AND g.pos1 < a.pos1 AND a.pos1 <= g.pos1 + g.gone + 10) AS after_gap FROM va a WHERE NOT gap AND poor IS NULL",
    "vc": "SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos1, seq) AS cl FROM (SELECT *, CASE WHEN pos1 - lag(pos1) OVER (PARTITION BY chrom ORDER BY pos1, seq) <= 10 THEN 0 ELSE 1 END AS new FROM vn)",
    "vk": "SELECT *, row_number() OVER (PARTITION BY chrom, cl ORDER BY pos1, seq) AS k FROM vc",
    "vd": """WITH RECURSIVE r AS (SELECT DISTINCT chrom, cl, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS id, false AS dense FROM vk
UNION ALL SELECT chrom, cl, k, CASE WHEN NOT low OR after_gap OR dense THEN list_append(seen, pos1) ELSE seen END, id, dense FROM (
  SELECT v.chrom, v.cl, v.k, v.low, v.after_gap, v.pos1, v.id, r.seen, 1 + len(list_filter(r.seen, lambda p: p >= v.pos1 - 10)) > 2 AS dense FROM r JOIN vk v ON v.chrom = r.chrom AND v.cl = r.cl AND v.k = r.k + 1))
SELECT id FROM r WHERE dense""",
    "vl": """SELECT v.id, (SELECT min(x.pos1) FROM vk x JOIN vd USING (id) WHERE x.chrom = v.chrom AND x.pos1 <= v.pos1 + 10 AND (x.pos1 > v.pos1 OR (x.pos1 = v.pos1 AND x.seq > v.seq))) AS lw,
  (SELECT min(g.pos1) FROM vg g WHERE g.chrom = v.chrom AND g.snp_q >= 25 AND g.pos1 BETWEEN v.pos1 AND v.pos1 + 10) AS lg FROM vk v""",
    "vp": "SELECT r.id AS rid, r.score AS own, x.id AS xid, x.score, x.pos1, x.seq FROM vg r JOIN vg x ON x.chrom = r.chrom AND x.pos1 + x.gone + 30 >= r.pos1 AND (x.pos1 < r.pos1 OR (x.pos1 = r.pos1 AND x.seq < r.seq))",
    "vo": "SELECT *, max(CASE WHEN score >= own THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos1, seq) AS stopped FROM vp",
    "vw": "SELECT rid AS id FROM vo WHERE score >= own UNION SELECT xid FROM vo WHERE stopped = 0",
}


@query(
    "w06_variant_filter",
    """SELECT chrom, pos1, ref, cons, CASE WHEN poor IS NOT NULL THEN poor WHEN id IN (SELECT id FROM vw) THEN 'g' WHEN id IN (SELECT id FROM vd) THEN 'W' WHEN after_gap THEN 'G' WHEN low THEN 'Q'
WHEN lw IS NOT NULL AND (lg IS NULL OR lw <= lg) THEN 'W' WHEN lg IS NOT NULL THEN 'G' ELSE '' END AS reason FROM va LEFT JOIN (SELECT id, after_gap FROM vn) USING (id) LEFT JOIN vl USING (id)""",
    FILTERED,
)
def _(s, d):
    return variant_filter(calls(s, d)).select("chrom", "pos1", "ref", "cons", "reason")


FASTQ = CNS | {
    "gn": "SELECT DISTINCT chrom, unnest(range(greatest(pos1 - 10, 1), pos1 + 11)) AS pos1 FROM cn WHERE ref = '*' AND cons <> '*/*' AND snp_q >= 25",
    "bq": "SELECT c.chrom, c.pos1, min(CASE WHEN rms_mapq < 25 OR depth < 3 OR depth > 255 OR gn.pos1 IS NOT NULL THEN lower(cons) ELSE upper(cons) END || chr(least(cons_q, 93) + 33)) AS m FROM cn c LEFT JOIN gn ON gn.chrom = c.chrom AND gn.pos1 = c.pos1 WHERE ref <> '*' GROUP BY ALL",
    "ps": "SELECT chrom, unnest(range(1, top + 1)) AS pos1 FROM (SELECT chrom, max(pos1) AS top FROM bq GROUP BY chrom)",
}


@query("c08_consensus_fastq", "SELECT chrom, (pos1 - 1) // 10000 AS chunk, string_agg(coalesce(m[1], 'n'), '' ORDER BY pos1) AS seq, string_agg(coalesce(m[2], '!'), '' ORDER BY pos1) AS qual FROM ps LEFT JOIN bq USING (chrom, pos1) GROUP BY ALL", FASTQ)
def _(s, d):
    return V.consensus_fastq(calls(s, d))


#: Every 4,096 bases of a sequence a place just before, so that some windows cross the border of two chunks.
WHOLE = {"pl": "SELECT doc_id, contig, seq, i, greatest(i * 4096 - 12, 0) AS b FROM (SELECT doc_id, contig, seq, unnest(range(0, (length(seq) + 4095) // 4096)) AS i FROM fx_whole)"}


def places(s, d):
    n = F.ceil(F.length("seq") / 4096)
    at = view(s, d, "fx_whole").filter("seq <> ''").select("doc_id", "contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return at.withColumn("b", F.greatest(F.col("i") * 4096 - 12, F.lit(0)))


@query("s11_fetch_sequence_whole", "SELECT contig, b AS start0, b + 25 AS end1, substr(seq, CAST(b + 1 AS INT), 25) AS seq FROM pl", WHOLE)
def _(s, d):
    from ..operators.sequences import fetch_sequence

    return fetch_sequence(whole_chunks(s, d), places(s, d).select("contig", F.col("b").alias("start0"), (F.col("b") + 25).alias("end1")))


@query("j14_reference_base_whole", "SELECT contig, b + doc_id % 450 AS pos0, CASE WHEN b + doc_id % 450 < length(seq) THEN substr(seq, CAST(b + doc_id % 450 + 1 AS INT), 1) ELSE 'N' END AS ref FROM pl", WHOLE)
def _(s, d):
    from ..operators.sequences import with_ref_base

    return with_ref_base(places(s, d).select("contig", (F.col("b") + F.col("doc_id") % 450).alias("pos0")), whole_chunks(s, d))


def reads_over(s, d):
    part = lambda at, n: F.substr("seq", (F.col("b") + at).cast("int"), F.lit(n))
    r = F.concat(part(1, 10), F.translate(part(11, 1), "ACGT", "CGTA"), part(12, 19))
    return places(s, d).filter("b + 30 <= length(seq)").select((F.col("doc_id") * 10000 + F.col("i")).alias("ordinal"), F.col("contig").alias("rname"), F.col("b").alias("pos0"), F.lit("30M").alias("cigar"), r.alias("seq"))


@query("c07_recompute_md_whole", "SELECT doc_id * 10000 + i AS ordinal, CASE WHEN substr(seq, CAST(b + 11 AS INT), 1) = 'N' THEN '30' ELSE '10' || substr(seq, CAST(b + 11 AS INT), 1) || '19' END AS md, CAST(CASE WHEN substr(seq, CAST(b + 11 AS INT), 1) = 'N' THEN 0 ELSE 1 END AS INT) AS nm FROM pl WHERE b + 30 <= length(seq)", WHOLE)
def _(s, d):
    return V.recompute_md(reads_over(s, d), whole_chunks(s, d)).select("ordinal", "md", "nm")


#: Reads of 60 bases over a site 60 bases behind each place: every second one deletes one to three bases, or inserts two, the second of which one read shows otherwise.
INDEL_READS = """
SELECT doc_id, contig, seq, i, b, r, CAST(b + 30 + r AS BIGINT) AS pos0, CAST(31 - r AS INT) AS m, (doc_id + i) % 2 = 0 AS gone, CAST(1 + doc_id % 3 AS INT) AS n
FROM (SELECT *, {explode} AS r FROM pl WHERE b + 200 <= length(seq)) t"""
INDEL_SQL = """
SELECT chrom, pos1, count(*) AS depth, '*' AS shorter, max(allele) AS longer, count(*) FILTER (r % 2 = 0) AS cnt_none, count(*) FILTER (r % 2 = 1) AS cnt_indel
FROM (SELECT contig AS chrom, b + 61 AS pos1, r, CASE WHEN gone THEN '-' || substr(seq, CAST(b + 62 AS INT), n) ELSE '+AC' END AS allele FROM ir) GROUP BY chrom, pos1"""


def indel_reads(s, d):
    at = places(s, d).filter("b + 200 <= length(seq)").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(8))))
    gone, n, m = (F.col("doc_id") + F.col("i")) % 2 == 0, (1 + F.col("doc_id") % 3).cast("int"), 31 - F.col("r")
    part = lambda start, size: F.substr("seq", (start + 1).cast("int"), size.cast("int"))
    start, site = F.col("b") + 30 + F.col("r"), F.col("b") + 61
    shown = F.when(F.col("r") % 2 == 0, part(start, F.lit(60))).when(gone, F.concat(part(start, m), part(site + n, 60 - m))).otherwise(F.concat(part(start, m), F.when(F.col("r") == 1, "AG").otherwise("AC"), part(site, 58 - m)))
    cigar = F.when(F.col("r") % 2 == 0, "60M").when(gone, F.format_string("%dM%dD%dM", m, n, 60 - m)).otherwise(F.format_string("%dM2I%dM", m, 58 - m))
    return at.select(((F.col("doc_id") * 10000 + F.col("i")) * 16 + F.col("r")).alias("ordinal"), F.col("contig").alias("rname"), start.alias("pos0"), cigar.alias("cigar"), F.lit(0).alias("flag"), F.lit(60).alias("mapq"), shown.alias("seq"), F.repeat(F.lit("I"), 60).alias("qual"))


@query("c05_realigned_indels", INDEL_SQL, WHOLE | {"ir": INDEL_READS.format(explode="unnest(range(0, 9))")})
def _(s, d):
    from ..operators.indels import realigned_indels

    r = realigned_indels(indel_reads(s, d), whole_chunks(s, d))
    of = lambda none: F.when((F.col("a1") == "*") == none, F.col("cnt1")).otherwise(F.col("cnt2"))
    return r.select("chrom", "pos1", "depth", F.least("a1", "a2").alias("shorter"), F.greatest("a1", "a2").alias("longer"), of(F.lit(True)).alias("cnt_none"), of(F.lit(False)).alias("cnt_indel"))


@query("c05_indel_calls")
def _(s, d):
    return V.indel_calls(with_bases(s, d)).select("chrom", "pos1", "cons", "cons_q", "snp_q", "depth", "cnt1", "cnt2")


for _name, _of in (("c03_first_base", "all"), ("c03_union_bases", "all"), ("s11_fetch_sequence", "whole"), ("j14_reference_base", "whole"), ("c07_recompute_md", "whole")):
    alias(_name, f"{_name}_{_of}")
