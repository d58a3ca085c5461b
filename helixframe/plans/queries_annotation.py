"""Queries of interval, annotation and quantification operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bounds as B
from ..functions import sequence as X
from ..operators import annotation as A
from ..operators import intervals as I
from ..operators import kmers as M
from ..operators import packed_kmers as P
from ..operators import quantify as N
from ..operators import scans
from .fixtures import view, whole_chunks
from .registry import alias, query

OCC, READ, EXON, GBLOCK = "fx_exon_occ", "fx_read", "fx_exon", "fx_gblock"


def occ(s, d):
    return view(s, d, OCC)


def exon_rows(s, d):
    return A.exons(occ(s, d)).select("chrom", "start0", "end1", "strand")


EXON_SQL = "SELECT chrom, start0, end1, CASE WHEN min(strand) = max(strand) THEN min(strand) ELSE '=' END AS strand, count(*) AS n_tx FROM fx_exon_occ GROUP BY ALL"


@query("a01_exons", EXON_SQL)
def _(s, d):
    return A.exons(occ(s, d))


BLOCK_SQL = """SELECT s.chrom, s.start0, s.end1, CASE WHEN count(e.strand) = 0 THEN '.' WHEN min(e.strand) = max(e.strand) THEN min(e.strand) ELSE '=' END AS strand, count(e.strand) AS n_exons
FROM fx_segment s LEFT JOIN ex e ON e.chrom = s.chrom AND e.start0 <= s.start0 AND e.end1 >= s.end1 GROUP BY s.chrom, s.start0, s.end1"""


@query("a02_gblocks", BLOCK_SQL, {"ex": EXON_SQL})
def _(s, d):
    return A.gblocks(exon_rows(s, d))


@query("a02_gblock_exons", "SELECT s.chrom, s.start0, s.end1, e.start0 AS exon_start0, e.end1 AS exon_end1 FROM fx_segment s JOIN fx_exon e ON e.chrom = s.chrom AND e.start0 <= s.start0 AND e.end1 >= s.end1")
def _(s, d):
    e = exon_rows(s, d)
    return A.gblock_exons(A.gblocks(e), e)


@query("a03_loci_by_name", "SELECT tx_id, min(tx_id) OVER (PARTITION BY gene_id) AS locus FROM (SELECT DISTINCT tx_id, gene_id FROM fx_exon_occ)")
def _(s, d):
    return A.loci(occ(s, d))


@query(
    "a03_loci_by_exon",
    "SELECT a.tx_id, min(b.tx_id) AS locus FROM r a JOIN r b ON a.comp = b.comp GROUP BY a.tx_id",
    {
        "n": "SELECT DISTINCT tx_id FROM fx_exon_occ",
        "e": "SELECT DISTINCT a.tx_id AS a, b.tx_id AS b FROM fx_exon_occ a JOIN fx_exon_occ b ON a.chrom = b.chrom AND a.start0 = b.start0 AND a.end1 = b.end1 AND a.strand = b.strand",
        "r": "SELECT n.tx_id, (WITH RECURSIVE w(x) AS (SELECT n.tx_id UNION SELECT e.b FROM w JOIN e ON e.a = w.x) SELECT min(x) FROM w) AS comp FROM n",
    },
)
def _(s, d):
    return A.loci(occ(s, d), by_name=False, by_exon=True)


@query(
    "a04_exonic_stats",
    """SELECT chrom, CAST(coalesce(sum(CASE WHEN n_exons > 0 THEN n END), 0) AS BIGINT) AS exonic_reads, CAST(coalesce(sum(CASE WHEN n_exons > 0 THEN end1 - start0 END), 0) AS BIGINT) AS exonic_positions,
CAST(coalesce(sum(CASE WHEN n_exons = 0 THEN n END), 0) AS BIGINT) AS other_reads, CAST(coalesce(sum(CASE WHEN n_exons = 0 THEN end1 - start0 END), 0) AS BIGINT) AS other_positions
FROM (SELECT g.chrom, g.start0, g.end1, g.n_exons, count(r.pos0) AS n FROM fx_gblock g LEFT JOIN fx_read r ON r.chrom = g.chrom AND r.pos0 >= g.start0 AND r.pos0 < g.end1 GROUP BY ALL) GROUP BY ROLLUP (chrom)""",
)
def _(s, d):
    return N.exonic_stats(A.gblocks(exon_rows(s, d)), view(s, d, READ))


CONST_CTES = {
    "votes": "SELECT o.gene_id, g.chrom, g.start0, g.end1, count(DISTINCT o.tx_id) AS v FROM fx_segment g JOIN fx_exon_occ o ON o.chrom = g.chrom AND o.start0 <= g.start0 AND o.end1 >= g.end1 GROUP BY ALL",
    "ntx": "SELECT gene_id, count(DISTINCT tx_id) AS n_tx FROM fx_exon_occ GROUP BY gene_id",
    "keep": "SELECT gene_id, chrom, start0, end1, sum(nw) OVER (PARTITION BY gene_id, chrom ORDER BY start0) AS chain FROM (SELECT v.gene_id, chrom, start0, end1, CASE WHEN start0 <= lag(end1) OVER (PARTITION BY v.gene_id, chrom ORDER BY start0) THEN 0 ELSE 1 END AS nw FROM votes v JOIN ntx USING (gene_id) WHERE v >= 0.5 * n_tx)",
    "lim": "SELECT gene_id, chrom, chain, start0, CASE WHEN end1 = max(end1) OVER (PARTITION BY gene_id, chrom, chain) THEN greatest(end1 - 36 + 1, start0) ELSE end1 END AS end1 FROM keep",
    "rs": "SELECT gene_id, chrom, chain, start0, end1, (SELECT count(*) FROM fx_read r WHERE r.chrom = lim.chrom AND r.pos0 >= lim.start0 AND r.pos0 < lim.end1) AS n FROM lim",
}


@query(
    "a05_constitutive_expression",
    "SELECT gene_id, n_tx, n_chains, n_reads, n_positions FROM ntx LEFT JOIN (SELECT gene_id, count(DISTINCT (chrom, chain)) AS n_chains, CAST(sum(n) AS BIGINT) AS n_reads, CAST(sum(end1 - start0) AS BIGINT) AS n_positions FROM rs GROUP BY gene_id) USING (gene_id)",
    CONST_CTES,
)
def _(s, d):
    return N.constitutive_expression(occ(s, d), A.gblocks(exon_rows(s, d)), view(s, d, READ), 0.5, 36)


@query("a06_exon_count_percentile", "SELECT gene_id, list_extract(list_sort(list(k)), CAST(greatest(floor(count(*) * 0.75) - 1, 0) + 1 AS INT)) AS threshold FROM (SELECT gene_id, tx_id, count(*) AS k FROM fx_exon_occ GROUP BY ALL) GROUP BY gene_id")
def _(s, d):
    return A.exon_count_threshold(occ(s, d), percentile=0.75)


@query("a06_exon_count_from_max", "SELECT gene_id, greatest(max(k) - 2, 1) AS threshold FROM (SELECT gene_id, tx_id, count(*) AS k FROM fx_exon_occ GROUP BY ALL) GROUP BY gene_id")
def _(s, d):
    return A.exon_count_threshold(occ(s, d), from_max=2)


@query(
    "a07_run_density",
    "SELECT chrom, island, CAST(sum(end1 - start0) AS BIGINT) AS n_positions, CAST(sum(n) AS BIGINT) AS n_reads FROM (SELECT l.*, (SELECT count(*) FROM fx_read r WHERE r.chrom = l.chrom AND r.pos0 >= l.start0 AND r.pos0 < l.end1) AS n FROM l) GROUP BY ALL",
    {
        "k": "SELECT chrom, start0, end1, CAST(sum(nw) OVER (PARTITION BY chrom ORDER BY start0) AS BIGINT) AS island FROM (SELECT chrom, start0, end1, CASE WHEN start0 <= lag(end1) OVER (PARTITION BY chrom ORDER BY start0) THEN 0 ELSE 1 END AS nw FROM fx_gblock WHERE n_exons > 0)",
        "l": "SELECT chrom, island, start0, CASE WHEN end1 = max(end1) OVER (PARTITION BY chrom, island) THEN greatest(end1 - 36 + 1, start0) ELSE end1 END AS end1 FROM k",
    },
)
def _(s, d):
    blocks = A.gblocks(exon_rows(s, d)).filter("n_exons > 0").select("chrom", "start0", "end1")
    return N.run_density(I.number_islands(blocks, ["chrom"]), view(s, d, READ), 36, ["chrom", "island"])


@query(
    "a19_locus_summary",
    """SELECT gene_id AS locus_gene, chrom, start0, end1, strand, n_exons, n_tx, max_exons, min_exons FROM
(SELECT gene_id, min(chrom) AS chrom, min(start0) AS start0, max(end1) AS end1, CASE WHEN min(strand) = max(strand) THEN min(strand) ELSE '=' END AS strand, count(DISTINCT (chrom, start0, end1)) AS n_exons FROM fx_exon_occ GROUP BY gene_id)
JOIN (SELECT gene_id, count(*) AS n_tx, max(k) AS max_exons, min(k) AS min_exons FROM (SELECT gene_id, tx_id, count(*) AS k FROM fx_exon_occ GROUP BY ALL) GROUP BY gene_id) USING (gene_id)""",
)
def _(s, d):
    own = occ(s, d)
    return A.locus_summary(own, A.loci(own)).select(F.element_at("names", 1).cast("long").alias("locus_gene"), "chrom", "start0", "end1", "strand", "n_exons", "n_tx", "max_exons", "min_exons")


@query("f13_loci_by_name", "SELECT min(chrom) AS chrom, min(start0) AS start0, max(end1) AS end1 FROM fx_exon_occ WHERE gene_id = 7 GROUP BY gene_id")
def _(s, d):
    own = occ(s, d)
    return A.loci_by_name(A.locus_summary(own, A.loci(own)), "7").select("chrom", "start0", "end1")


TX_SRC = "SELECT DISTINCT tx_id, gene_id, CASE WHEN tx_id % 11 = 0 THEN 'b' ELSE 'a' END AS src FROM fx_exon_occ"


@query("f08_locus_only_from", "SELECT tx_id, min(tx_id) OVER (PARTITION BY gene_id) AS locus FROM t WHERE gene_id IN (SELECT gene_id FROM t GROUP BY gene_id HAVING bool_and(src = 'a'))", {"t": TX_SRC})
def _(s, d):
    own = occ(s, d)
    tx = own.select("tx_id", F.when(F.col("tx_id") % 11 == 0, "b").otherwise("a").alias("anno_source")).distinct()
    return A.locus_only_from(tx, A.loci(own), "a")


@query("f10_drop_ambiguous", "SELECT chrom, start0, end1, strand FROM ex WHERE strand <> '='", {"ex": EXON_SQL})
def _(s, d):
    return A.drop_ambiguous(exon_rows(s, d))


CDS = {
    "tx": "SELECT tx_id, min(start0) + 50 AS c0, max(end1) - 50 AS c1 FROM fx_exon_occ GROUP BY tx_id",
    "cx": "SELECT chrom, start0, end1, max(CASE WHEN greatest(start0, c0) < least(end1, c1) THEN greatest(start0, c0) END) AS m0, min(CASE WHEN greatest(start0, c0) < least(end1, c1) THEN least(end1, c1) END) AS m1 FROM fx_exon_occ JOIN tx USING (tx_id) GROUP BY ALL",
    "bl": "SELECT s.chrom, s.start0, s.end1, max(greatest(s.start0, m0)) AS b0, min(least(s.end1, m1)) AS b1, bool_or(m0 IS NULL OR m1 IS NULL OR greatest(s.start0, m0) >= least(s.end1, m1)) AS bad FROM fx_segment s JOIN cx e ON e.chrom = s.chrom AND e.start0 <= s.start0 AND e.end1 >= s.end1 GROUP BY ALL",
}


@query("f11_coding_clip", "SELECT chrom, b0 AS start0, b1 AS end1 FROM bl WHERE NOT bad AND b0 < b1", CDS)
def _(s, d):
    own = occ(s, d)
    tx = own.groupBy("tx_id").agg((F.min("start0") + 50).alias("c0"), (F.max("end1") - 50).alias("c1"))
    lo, hi = F.greatest("start0", "c0"), F.least("end1", "c1")
    ex = A.exons(own.join(tx, "tx_id").withColumns({"coding_start0": F.when(lo < hi, lo), "coding_end1": F.when(lo < hi, hi)}))
    return A.coding_clip(A.gblock_exons(A.gblocks(ex), ex), ex)


@query("j01_read_to_segment", "SELECT g.chrom, g.start0, g.end1, count(r.pos0) AS n_reads FROM fx_segment g LEFT JOIN fx_read r ON r.chrom = g.chrom AND r.pos0 >= g.start0 AND r.pos0 < g.end1 GROUP BY ALL")
def _(s, d):
    return N.block_counts(view(s, d, READ), A.gblocks(exon_rows(s, d)))


@query("j01_blind_spots", "SELECT chrom, pos0, count(*) AS n FROM fx_read r WHERE NOT EXISTS (SELECT 1 FROM fx_segment g WHERE g.chrom = r.chrom AND r.pos0 >= g.start0 AND r.pos0 < g.end1) GROUP BY ALL")
def _(s, d):
    return N.assign_reads(view(s, d, READ), A.gblocks(exon_rows(s, d))).filter("start0 is null").select("chrom", "pos0", "n")


TAGS = {
    "tg": "SELECT concat(chrom, '|', CAST(start0 AS STRING), ':', CAST(next_end1 AS STRING), ':', CAST(gene_id AS STRING), ':', CAST(end1 AS STRING), ':', CAST(next_start0 AS STRING)) AS tag_id, chrom, end1 - start0 AS up, (end1 - start0) + (next_end1 - next_start0) AS len FROM fx_jnx",
    "tb": "SELECT tag_id, greatest(up - 32, 0) AS block_start0, least(up - 4, len - 36) + 1 AS block_end1 FROM tg WHERE least(up - 4, len - 36) >= greatest(up - 32, 0)",
    "jr": "SELECT t.tag_id, (l.l_partkey * 13 + l.l_linenumber) % 400 AS pos0 FROM lineitem l JOIN (SELECT tag_id, row_number() OVER (ORDER BY tag_id) - 1 AS k, count(*) OVER () AS n FROM tg) t ON t.k = l.l_orderkey % t.n",
}


def tags(s, d):
    j = view(s, d, "fx_jnx")
    cast = lambda c: F.col(c).cast("string")
    t = j.select(F.concat("chrom", F.lit("|"), cast("start0"), F.lit(":"), cast("next_end1"), F.lit(":"), cast("gene_id"), F.lit(":"), cast("end1"), F.lit(":"), cast("next_start0")).alias("tag_id"), "chrom", (F.col("end1") - F.col("start0")).alias("up"), (F.col("end1") - F.col("start0") + F.col("next_end1") - F.col("next_start0")).alias("len"))
    lo, hi = F.greatest(F.col("up") - 32, F.lit(0)), F.least(F.col("up") - 4, F.col("len") - 36)
    return t, t.filter(lo <= hi).select("tag_id", lo.alias("block_start0"), (hi + 1).alias("block_end1"))


JR = {k: v for k, v in TAGS.items() if k != "jr"} | {"rd": "SELECT tag_id, (up * 7 + len * x + 13 * x) % 400 AS pos0 FROM tg, (SELECT CAST(unnest(range(1, 40)) AS BIGINT) AS x)"}


def jnx_reads(t):
    """39 reads of each tag, made behind the shuffle of tags."""
    return t.repartition("tag_id").select("tag_id", F.explode(F.sequence(F.lit(1), F.lit(39))).alias("x"), "up", "len").select("tag_id", ((F.col("up") * 7 + F.col("len") * F.col("x") + 13 * F.col("x")) % 400).alias("pos0"))


@query("j02_reads_to_tag_blocks", "SELECT tag_id, block_start0, block_end1, count(*) AS n_reads FROM rd JOIN tb USING (tag_id) WHERE pos0 >= block_start0 AND pos0 < block_end1 GROUP BY ALL", JR)
def _(s, d):
    t, b = tags(s, d)
    return N.assign_jnx_reads(jnx_reads(t), b)


@query("a08_junction_density", "SELECT tag_id AS junction_id, CAST(sum(n) AS BIGINT) AS n_reads, CAST(sum(block_end1 - block_start0) AS BIGINT) AS n_positions FROM (SELECT *, (SELECT count(*) FROM rd WHERE rd.tag_id = tb.tag_id AND pos0 >= block_start0 AND pos0 < block_end1) AS n FROM tb) GROUP BY tag_id", JR)
def _(s, d):
    t, b = tags(s, d)
    return N.junction_density(b.withColumn("junction_id", F.col("tag_id")), N.assign_jnx_reads(jnx_reads(t), b))


RUNS = {"rp": "SELECT DISTINCT chrom, pos0 + 1 AS p FROM fx_read", "rn": "SELECT chrom, min(p) AS start1, max(p) + 25 AS end1 FROM (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS g FROM rp) GROUP BY chrom, g"}


def mappable(s, d):
    return I.position_runs(view(s, d, READ).select("chrom", (F.col("pos0") + 1).alias("pos1"))).withColumn("end1", F.col("end1") + 25)


@query("w02_position_runs", "SELECT chrom, start1, end1 - 25 AS end1 FROM rn", RUNS)
def _(s, d):
    return I.position_runs(view(s, d, READ).select("chrom", (F.col("pos0") + 1).alias("pos1")))


@query(
    "j03_mappable_on_segments",
    "SELECT chrom, start0, end1, CAST(coalesce(sum(greatest(least(e, fit) - s, 0)), 0) AS BIGINT) AS pos_l, CAST(coalesce(sum(greatest(e - greatest(s, fit), 0)), 0) AS BIGINT) AS pos_r FROM (SELECT g.chrom, g.start0, g.end1, greatest(g.start0, coalesce(r.start1 - 1, g.end1)) AS s, least(g.end1, coalesce(r.end1, g.start0)) AS e, greatest(g.end1 - 36 + 1, g.start0) AS fit FROM fx_segment g LEFT JOIN rn r ON r.chrom = g.chrom AND r.start1 - 1 < g.end1 AND r.end1 > g.start0) GROUP BY ALL",
    RUNS,
)
def _(s, d):
    return N.mappable_on_blocks(mappable(s, d), A.gblocks(exon_rows(s, d)), 36)


@query("j04_mappable_on_tags", "SELECT tag_id, block_start0, block_end1, CAST(greatest(least(block_end1, 60 + up) - greatest(block_start0, up - 20), 0) AS BIGINT) AS n_positions FROM tb JOIN tg USING (tag_id)", {k: TAGS[k] for k in ("tg", "tb")})
def _(s, d):
    t, b = tags(s, d)
    return N.mappable_on_tags(t.select("tag_id", (F.col("up") - 19).alias("start1"), (F.col("up") + 60).alias("end1")), b)


@query("j05_segments_inside", "SELECT e.chrom, e.start0 AS s0, e.end1 AS e1, g.start0, g.end1 FROM fx_exon e JOIN fx_segment g ON g.chrom = e.chrom AND g.start0 >= e.start0 AND g.end1 <= e.end1")
def _(s, d):
    e = exon_rows(s, d)
    return N.blocks_in(A.gblocks(e), e.select("chrom", F.col("start0").alias("s0"), F.col("end1").alias("e1")))


@query("j05_segments_overlapping", "SELECT e.chrom, e.start0 - 60 AS s0, e.end1 - 60 AS e1, g.start0, g.end1 FROM fx_exon e JOIN fx_segment g ON g.chrom = e.chrom AND g.start0 < e.end1 - 60 AND g.end1 > e.start0 - 60")
def _(s, d):
    e = exon_rows(s, d)
    return N.blocks_in(A.gblocks(e), e.select("chrom", (F.col("start0") - 60).alias("s0"), (F.col("end1") - 60).alias("e1")), complete=False)


LEAD = "SELECT *, lead(start0) OVER w AS next_start0, lead(end1) OVER w AS next_end1 FROM fx_exon_occ WINDOW w AS (PARTITION BY tx_id ORDER BY start0, end1)"
JNX_SQL = "SELECT *, count(*) OVER (PARTITION BY chrom, next_start0, next_end1) AS in_degree FROM (SELECT chrom, start0, end1, next_start0, next_end1, CASE WHEN min(strand) = max(strand) THEN min(strand) ELSE '=' END AS strand, count(*) AS n_tx FROM ld WHERE next_start0 IS NOT NULL GROUP BY ALL)"


@query("j06_junctions", JNX_SQL, {"ld": LEAD})
def _(s, d):
    return A.junctions(occ(s, d))


@query("j13_denovo_pairs", "SELECT a.chrom, a.strand, a.start0, a.end1, b.start0 AS next_start0, b.end1 AS next_end1 FROM ex a JOIN ex b ON a.chrom = b.chrom AND a.strand = b.strand AND b.start0 <= a.end1 + 2000 AND a.end1 <= b.start0 - 50", {"ex": EXON_SQL})
def _(s, d):
    return A.denovo_pairs(exon_rows(s, d), 2000, 50)


#: Coding columns of exons, made of their places.
FRAMED = {
    "ex": EXON_SQL,
    "fe": "SELECT chrom, strand, start0, end1, (start0 // 100 + end1 // 50) % 4 - 1 AS frame, start0 + 1300 * (start0 // 100 % 3) AS cds_start0, end1 - 1300 * (end1 // 100 % 3) AS cds_end1 FROM ex",
    "fp": """SELECT a.chrom, a.strand, a.start0, a.end1, b.start0 AS next_start0, b.end1 AS next_end1, CASE WHEN a.strand <> '-' THEN CASE a.frame WHEN -1 THEN b.frame = -1 OR (a.cds_start0 >= b.start0 AND a.cds_start0 <= b.end1) WHEN 0 THEN b.frame = (((a.end1 - a.cds_start0) % 3) + 3) % 3 ELSE b.frame = (a.end1 - a.start0 + a.frame) % 3 END
ELSE CASE b.frame WHEN -1 THEN a.frame = -1 OR (b.cds_end1 >= a.start0 AND b.cds_end1 <= a.end1) WHEN 0 THEN a.frame = (((b.cds_end1 - b.start0) % 3) + 3) % 3 ELSE a.frame = (b.end1 - b.start0 + b.frame) % 3 END END AS in_frame
FROM fe a JOIN fe b ON a.chrom = b.chrom AND a.strand = b.strand AND b.start0 <= a.end1 + 2000 AND a.end1 <= b.start0 - 50""",
}


def framed(s, d):
    tens = lambda c, n: F.floor(F.col(c) / n)
    return exon_rows(s, d).withColumns({"frame": (tens("start0", 100) + tens("end1", 50)) % 4 - 1, "cds_start0": F.col("start0") + 1300 * (tens("start0", 100) % 3), "cds_end1": F.col("end1") - 1300 * (tens("end1", 100) % 3)})


@query("j13_denovo_frames", "SELECT * FROM fp", FRAMED)
def _(s, d):
    return A.denovo_pairs(framed(s, d), 2000, 50, in_frame=False)


@query("e17_denovo_in_frame", "SELECT chrom, strand, start0, end1, next_start0, next_end1 FROM fp p WHERE in_frame AND NOT EXISTS (SELECT 1 FROM fx_jnx k WHERE k.chrom = p.chrom AND k.end1 = p.end1 AND k.next_start0 = p.next_start0)", FRAMED)
def _(s, d):
    known = A.gene_junctions(occ(s, d)).select("chrom", "end1", "next_start0").distinct()
    return A.denovo_pairs(framed(s, d), 2000, 50, in_frame=True).join(known, ["chrom", "end1", "next_start0"], "left_anti").select("chrom", "strand", "start0", "end1", "next_start0", "next_end1")


@query("e17_denovo_junctions", "SELECT chrom, strand, start0, end1, next_start0, next_end1 FROM (SELECT a.chrom, a.strand, a.start0, a.end1, b.start0 AS next_start0, b.end1 AS next_end1 FROM ex a JOIN ex b ON a.chrom = b.chrom AND a.strand = b.strand AND b.start0 <= a.end1 + 1500 AND a.end1 <= b.start0 - 50) p WHERE NOT EXISTS (SELECT 1 FROM fx_jnx k WHERE k.chrom = p.chrom AND k.end1 = p.end1 AND k.next_start0 = p.next_start0)", {"ex": EXON_SQL})
def _(s, d):
    known = A.gene_junctions(occ(s, d)).select("chrom", "end1", "next_start0").distinct()
    return A.denovo_pairs(exon_rows(s, d), 1500, 50).join(known, ["chrom", "end1", "next_start0"], "left_anti").select("chrom", "strand", "start0", "end1", "next_start0", "next_end1")


@query("w01_exon_ranks", "SELECT tx_id, start0, end1, CASE WHEN strand = '-' THEN row_number() OVER (PARTITION BY tx_id ORDER BY start0 DESC, end1 DESC) ELSE row_number() OVER (PARTITION BY tx_id ORDER BY start0, end1) END AS exon_rank FROM fx_exon_occ")
def _(s, d):
    return A.exon_ranks(occ(s, d)).select("tx_id", "start0", "end1", F.col("exon_rank").cast("long").alias("exon_rank"))


def island_sql(source, keys, cond):
    k = ", ".join(keys)
    return f"SELECT {k}, min(start0) AS start0, max(end1) AS end1, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY start0, end1) AS g FROM (SELECT *, CASE WHEN start0 {cond} max(end1) OVER (PARTITION BY {k} ORDER BY start0, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {source})) GROUP BY {k}, g"


@query("w02_islands", island_sql("fx_exon", ["chrom"], "<="))
def _(s, d):
    return I.islands(view(s, d, EXON), ["chrom"])


@query("w03_sibling_groups", island_sql("(SELECT *, CASE WHEN strand = '-' THEN 1 ELSE 0 END AS pass FROM ex)", ["chrom", "pass"], "<"), {"ex": EXON_SQL})
def _(s, d):
    g = A.sibling_groups(exon_rows(s, d))
    return g.groupBy("chrom", "pass", "sibling_set").agg(F.min("start0").alias("start0"), F.max("end1").alias("end1"), F.count(F.lit(1)).alias("n")).drop("sibling_set")


UTR = {"ub": "SELECT DISTINCT o.gene_id, g.chrom, g.start0, g.end1 FROM fx_segment g JOIN (SELECT gene_id, chrom, start0, end1 FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY start0 DESC, end1 DESC) AS k FROM fx_exon_occ) WHERE k = 1) o ON o.chrom = g.chrom AND o.start0 <= g.start0 AND o.end1 >= g.end1"}


@query("w04_utr_runs", "SELECT gene_id, chrom, start0, end1, run FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, run) AS k FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY gene_id ORDER BY start0, end1) AS BIGINT) AS run FROM (SELECT *, CASE WHEN start0 <= max(end1) OVER (PARTITION BY gene_id ORDER BY start0, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM ub))) WHERE k >= 2", UTR)
def _(s, d):
    return A.utr_runs(utr_blocks(s, d), 2)


def utr_blocks(s, d):
    from pyspark.sql import Window

    own = occ(s, d)
    last = own.withColumn("k", F.row_number().over(Window.partitionBy("tx_id").orderBy(F.desc("start0"), F.desc("end1")))).filter("k = 1")
    rows = last.select("gene_id", "chrom", F.col("start0").alias("r_start0"), F.col("end1").alias("r_end1")).distinct()
    return I.overlap_join(A.gblocks(exon_rows(s, d)).select("chrom", "start0", "end1"), rows).select("gene_id", "chrom", "start0", "end1").distinct()


GAP_CTES = {"isl": island_sql("fx_exon", ["chrom"], "<=")}


@query("w09_nonexonic_gaps", "SELECT chrom, end1 AS start0, nx AS end1 FROM (SELECT chrom, end1, lead(start0) OVER (PARTITION BY chrom ORDER BY start0) AS nx FROM isl) WHERE nx IS NOT NULL", GAP_CTES)
def _(s, d):
    return A.nonexonic_gaps(exon_rows(s, d))


LABELS = GAP_CTES | {
    "gp": "SELECT chrom, end1 AS start0, nx AS end1 FROM (SELECT chrom, end1, lead(start0) OVER (PARTITION BY chrom ORDER BY start0) AS nx FROM isl) WHERE nx IS NOT NULL",
    "rk": "SELECT *, CASE WHEN strand = '-' THEN n + 1 - k ELSE k END AS rank FROM (SELECT *, row_number() OVER w AS k, lead(start0) OVER w AS next0, count(*) OVER (PARTITION BY tx_id) AS n FROM fx_exon_occ WINDOW w AS (PARTITION BY tx_id ORDER BY start0, end1))",
    "il": "SELECT chrom, end1 AS a, next0 AS b, 'Intron ' || CASE WHEN strand = '-' THEN rank - 1 ELSE rank END || ',' || CASE WHEN strand = '-' THEN rank ELSE rank + 1 END AS label FROM rk WHERE next0 IS NOT NULL",
    "sl": "SELECT g.chrom, g.start0, g.end1, min(label) AS intron FROM gp g JOIN il ON il.chrom = g.chrom AND a <= g.start0 AND b >= g.end1 GROUP BY ALL",
    "ll": "SELECT chrom, end1 AS start0, max(CASE WHEN rank = 1 AND strand = '-' THEN 2 WHEN rank <> 1 AND strand <> '-' THEN 1 ELSE 0 END) AS lk FROM rk WHERE rank = 1 OR rank = n GROUP BY ALL",
    "lr": "SELECT chrom, start0 AS end1, max(CASE WHEN rank = 1 AND strand <> '-' THEN 2 WHEN rank <> 1 AND strand = '-' THEN 1 ELSE 0 END) AS rk FROM rk WHERE rank = 1 OR rank = n GROUP BY ALL",
}


@query(
    "w09_labelled_gaps",
    "SELECT chrom, start0, end1, coalesce(intron, CASE greatest(coalesce(lk, 0), coalesce(lr.rk, 0)) WHEN 2 THEN 'Promoter' WHEN 1 THEN '3''UTR' ELSE 'Intergenic' END) AS label FROM gp LEFT JOIN sl USING (chrom, start0, end1) LEFT JOIN ll USING (chrom, start0) LEFT JOIN lr USING (chrom, end1)",
    LABELS,
)
def _(s, d):
    return A.nonexonic_gaps(exon_rows(s, d), occ(s, d))


@query("w10_tss_windows", "SELECT gene_id, chrom, strand, start0, end1, row_number() OVER (PARTITION BY gene_id ORDER BY chrom, start0, end1, strand) AS n FROM (SELECT DISTINCT gene_id, chrom, strand, greatest(CASE WHEN strand = '-' THEN e - 1 - 50 ELSE s - 200 END, 0) AS start0, CASE WHEN strand = '-' THEN e - 1 - 50 ELSE s - 200 END + 251 AS end1 FROM (SELECT gene_id, tx_id, min(chrom) AS chrom, min(strand) AS strand, min(start0) AS s, max(end1) AS e FROM fx_exon_occ GROUP BY ALL))")
def _(s, d):
    return A.tss_windows(occ(s, d), 200, 50)


def _tail(k: str) -> str:
    """The Poisson distribution function of k events of mean mu."""
    return f"CASE WHEN {k} < 0 THEN 0.0 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(i * ln(mu) - mu - lgamma(i + 1)))) END"


SIGNIFICANT = {
    "wn": "SELECT chrom, CAST(floor(pos0 / 1000) AS BIGINT) * 1000 AS start0, count(*) AS n FROM fx_read GROUP BY ALL",
    "sn": "SELECT sum(w) AS span, sum(k) AS k FROM (SELECT max(pos0) - min(pos0) + 1 AS w, count(*) AS k FROM fx_read GROUP BY chrom)",
    "mn": "SELECT chrom, start0, n, k / span * 1000 AS mu, span / 1000 AS folds FROM wn, sn",
    "fn": f"SELECT *, {_tail('n - 1')} AS c1, {_tail('n - 3')} AS c3, exp(n * ln(mu) - mu - lgamma(n + 1)) AS p0, CASE WHEN n < 2 THEN 0.0 ELSE exp((n - 2) * ln(mu) - mu - lgamma(n - 1)) END AS p2 FROM mn",
    "qn": "SELECT *, greatest(c1 * c1 - (n - 1) * p0 * p2 - (n - 1 - mu) * p0 * c3, 1e-300) AS q2, c1 * c1 - (n - 1) * p0 * p2 - (n - 1 - mu) * p0 * c3 - greatest(n - mu, 0) * p0 * c1 AS q3 FROM fn",
}


@query("w11_window_significance", "SELECT chrom, start0, n AS n_reads, round(least(greatest(1 - q2 * pow(least(greatest(q3, 1e-300) / q2, 1.0), greatest(folds - 2, 0)), 0.0), 1.0), 6) AS p FROM qn", SIGNIFICANT)
def _(s, d):
    return N.window_significance(view(s, d, READ), 1000).withColumn("p", F.round("p", 6))


@query("u01_merge_bounds", "SELECT chrom, start0, end1 FROM m", {"m": island_sql("fx_exon", ["chrom"], "<")})
def _(s, d):
    return I.merge_bounds(view(s, d, EXON))


SHIFTED = {"sh": "SELECT DISTINCT chrom, start0 + 150 AS s2, end1 + 50 AS e2 FROM fx_exon"}


def shifted(s, d):
    return view(s, d, EXON).select("chrom", (F.col("start0") + 150).alias("start0"), (F.col("end1") + 50).alias("end1")).distinct()


@query("u02_overlap_length", "SELECT e.chrom, e.start0, e.end1, CAST(coalesce(sum(greatest(least(end1, e2) - greatest(start0, s2), 0)), 0) AS BIGINT) AS overlap FROM fx_exon e LEFT JOIN sh ON sh.chrom = e.chrom AND s2 < end1 AND e2 > start0 GROUP BY ALL", SHIFTED)
def _(s, d):
    return I.set_overlap_length(view(s, d, EXON), shifted(s, d))


@query("u03_intersect", "SELECT DISTINCT e.chrom, greatest(start0, s2) AS start0, least(end1, e2) AS end1 FROM fx_exon e JOIN sh ON sh.chrom = e.chrom AND s2 < end1 AND e2 > start0", SHIFTED)
def _(s, d):
    return I.intersect(view(s, d, EXON), shifted(s, d))


@query(
    "u04_subtract",
    "SELECT DISTINCT chrom, min(x) AS start0, max(x) + 1 AS end1 FROM (SELECT chrom, start0 AS a, end1 AS b, x, x - row_number() OVER (PARTITION BY chrom, start0, end1 ORDER BY x) AS g FROM px WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.chrom = px.chrom AND s2 <= x AND x < e2)) GROUP BY chrom, a, b, g",
    SHIFTED | {"px": "SELECT chrom, start0, end1, unnest(range(start0, end1)) AS x FROM fx_exon"},
)
def _(s, d):
    return I.subtract(view(s, d, EXON), shifted(s, d))


@query("u05_tag_set_union", "SELECT chrom, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_intersect(a, b)) AS i FROM (SELECT chrom, list(DISTINCT start0 % 97) AS a, list(DISTINCT end1 % 89) AS b FROM fx_exon GROUP BY chrom)")
def _(s, d):
    g = view(s, d, EXON).groupBy("chrom").agg(F.collect_set(F.col("start0") % 97).alias("a"), F.collect_set(F.col("end1") % 89).alias("b"))
    return g.select("chrom", F.array_sort(F.array_union("a", "b")).alias("u"), F.array_sort(F.array_intersect("a", "b")).alias("i"))


@query("u06_union_sources", "SELECT 'a' AS anno_source, chrom, start0, end1 FROM fx_exon UNION ALL SELECT 'b', chrom, s2, e2 FROM sh", SHIFTED)
def _(s, d):
    from ..sources.annotations import union_sources

    return union_sources({"a": view(s, d, EXON), "b": shifted(s, d)})


@query("u09_distinct_regions", "SELECT chrom, start0, end1, string_agg(CAST(gene_id AS VARCHAR), ',' ORDER BY CAST(gene_id AS VARCHAR)) AS names FROM (SELECT DISTINCT chrom, start0, end1, gene_id FROM fx_exon_occ) GROUP BY ALL")
def _(s, d):
    return occ(s, d).groupBy("chrom", "start0", "end1").agg(F.array_join(F.array_sort(F.collect_set(F.col("gene_id").cast("string"))), ",").alias("names"))


@query("t03_sort_positions", "SELECT chrom, pos0, qname FROM fx_read ORDER BY chrom, pos0, qname")
def _(s, d):
    return view(s, d, READ).select("chrom", "pos0", "qname").orderBy("chrom", "pos0", "qname")


@query("f04_quality_filter", "SELECT qname, chrom, pos0 FROM fx_read WHERE mapq >= 20 AND mapq % 7 <= 3")
def _(s, d):
    return N.quality_filter(view(s, d, READ).withColumn("nm", F.col("mapq") % 7), 20, 3).select("qname", "chrom", "pos0")


@query("x08_bin_numbers", "SELECT chrom, start0, end1, CASE WHEN start0 >> 14 = (end1 - 1) >> 14 THEN 4681 + (start0 >> 14) WHEN start0 >> 17 = (end1 - 1) >> 17 THEN 585 + (start0 >> 17) WHEN start0 >> 20 = (end1 - 1) >> 20 THEN 73 + (start0 >> 20) WHEN start0 >> 23 = (end1 - 1) >> 23 THEN 9 + (start0 >> 23) WHEN start0 >> 26 = (end1 - 1) >> 26 THEN 1 + (start0 >> 26) ELSE 0 END AS bin FROM fx_exon")
def _(s, d):
    return view(s, d, EXON).select("chrom", "start0", "end1", B.bin_of(F.col("start0"), F.col("end1")).alias("bin"))


@query("x04_bound_functions", "SELECT chrom, start0, end1, end1 - start0 AS len, greatest(least(end1, 20100) - greatest(start0, 1600), 0) AS olen, start0 + 1 AS s11, end1 AS e11, start0 >= 1600 AND end1 <= 20100 AS inside, end1 <= 1600 AS left_of FROM fx_exon")
def _(s, d):
    a, b, lo, hi = F.col("start0"), F.col("end1"), F.lit(1600).cast("long"), F.lit(20100).cast("long")
    s11, e11 = B.convert(a, b, "01", "11")
    return view(s, d, EXON).select("chrom", a, b, B.length(a, b).alias("len"), B.overlap_length(a, b, lo, hi).alias("olen"), s11.alias("s11"), e11.alias("e11"), B.contained_in(a, b, lo, hi).alias("inside"), B.is_left_of(b, lo).alias("left_of"))


WHOLE_KM = {"km": "SELECT contig, i AS pos1, substr(seq, CAST(i AS INT), 12) AS kmer, '+' AS strand FROM (SELECT contig, seq, unnest(range(1, length(seq) - 10)) AS i FROM fx_whole WHERE length(seq) >= 12) UNION ALL SELECT contig, i, reverse(translate(substr(seq, CAST(i AS INT), 12), 'ACGT', 'TGCA')), '-' FROM (SELECT contig, seq, unnest(range(1, length(seq) - 10)) AS i FROM fx_whole WHERE length(seq) >= 12)"}


@query("x01_reverse_complement_whole", "SELECT contig, reverse(translate(seq, 'ACGTU', 'TGCAA')) AS rc FROM fx_whole")
def _(s, d):
    return view(s, d, "fx_whole").select("contig", X.reverse_complement(F.col("seq")).alias("rc"))


@query("m01_kmers_whole", "SELECT strand, count(*) AS n, count(DISTINCT kmer) AS n_distinct, CAST(sum(pos1) AS BIGINT) AS pos_sum FROM km GROUP BY strand", WHOLE_KM)
def _(s, d):
    return P.kmer_counts(whole_chunks(s, d, 11), 12)


@query("m01_kmer_rows", "SELECT contig, pos1, kmer, strand FROM km", WHOLE_KM)
def _(s, d):
    return P.kmer_rows(whole_chunks(s, d, 11), 12)


@query("a13_kmer_fold_whole", "SELECT kmer, count(*) AS n, min((contig, pos1, strand)).contig AS contig, min((contig, pos1, strand)).pos1 AS pos1, min((contig, pos1, strand)).strand AS strand FROM kk GROUP BY kmer HAVING count(*) <= 2".replace("min((contig, pos1, strand))", "min({'contig': contig, 'pos1': pos1, 'strand': strand})"), WHOLE_KM | {"kk": "SELECT * FROM km"})
def _(s, d):
    return P.fold_kmers(whole_chunks(s, d, 11), 12, 2)


@query("m02_mappable_runs_whole", "SELECT contig, min(p) AS start1, max(p) AS end1 FROM (SELECT contig, p, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS g FROM (SELECT contig, pos1 AS p FROM km WHERE strand = '+' AND kmer IN (SELECT kmer FROM km GROUP BY kmer HAVING count(*) = 1))) GROUP BY contig, g", WHOLE_KM)
def _(s, d):
    return P.unique_runs(whole_chunks(s, d, 11), 12)


@query("m03_parse_contig_id", "SELECT tag_id, split_part(tag_id, '|', 1) AS chrom, split_part(split_part(tag_id, '|', 2), ':', 1) AS tag_set, CAST(split_part(split_part(tag_id, '|', 2), ':', 2) AS BIGINT) AS number FROM tg", {"tg": TAGS["tg"]})
def _(s, d):
    t, _ = tags(s, d)
    return t.select("tag_id", M.parse_contig_id(F.col("tag_id")).alias("p")).select("tag_id", "p.chrom", "p.tag_set", "p.number")


@query("t04_sort_kmers_whole", "SELECT kmer, contig, pos1, strand FROM km", WHOLE_KM)
def _(s, d):
    return P.ordered_kmer_rows(whole_chunks(s, d, 11), 12).select("kmer", "contig", "pos1", "strand")


@query("a18_sequence_digests_whole", "SELECT contig, md5(upper(seq)) AS md5 FROM fx_whole")
def _(s, d):
    return M.sequence_digests(whole_chunks(s, d))


@query("s20_transcript_xref", "SELECT tx_id, gene_id, string_agg(start0 || '-' || end1, ',' ORDER BY start0, end1) AS exons FROM fx_exon_occ GROUP BY ALL")
def _(s, d):
    return A.transcript_xref(occ(s, d))


@query("s20_exon_xref", "SELECT chrom || ':' || (start0 + 1) || '-' || end1 || ':' || strand AS exon, chrom, start0, end1, strand FROM ex", {"ex": EXON_SQL})
def _(s, d):
    return A.exon_xref(exon_rows(s, d))


@query("scan_next_position", "SELECT chrom, start0, lead(start0) OVER (PARTITION BY chrom ORDER BY start0) AS nx FROM (SELECT DISTINCT chrom, start0 FROM fx_exon)")
def _(s, d):
    return scans.next_position(view(s, d, EXON).select("chrom", "start0").distinct(), ["chrom"], "start0", "nx", 1 << 14)


for _name in ("x01_reverse_complement", "m01_kmers", "a13_kmer_fold", "m02_mappable_runs", "t04_sort_kmers", "a18_sequence_digests"):
    alias(_name, f"{_name}_whole")
alias("m04_mappable_positions", "j03_mappable_on_segments")
