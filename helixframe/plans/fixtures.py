"""Views over the driver's tables that stand for annotations, reads and alignments (FIXTURES.md), as text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import CHUNK

VIEWS = {
    "fx_exon_occ": """
SELECT l_orderkey AS tx_id,
  CAST(floor(l_orderkey/8) AS BIGINT) AS gene_id,
  concat('chr', CAST(CAST(floor(l_orderkey/8) AS BIGINT) % 5 + 1 AS STRING)) AS chrom,
  CASE WHEN CAST(floor(l_orderkey/8) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(floor(l_orderkey/40) AS BIGINT)*20000 + l_linenumber*1500
    + CASE WHEN min(l_partkey) % 8 = 0 THEN 100 ELSE 0 END AS start0,
  CAST(floor(l_orderkey/40) AS BIGINT)*20000 + l_linenumber*1500 + 300
    + CASE WHEN min(l_suppkey) % 8 = 0 THEN 100 ELSE 0 END AS end1
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING CAST(floor(min(l_quantity)) AS BIGINT) % 5 <> 0""",
    "fx_read": """
SELECT concat(CAST(l_orderkey AS STRING),'_',CAST(l_linenumber AS STRING)) AS qname,
  concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS chrom,
  CAST(floor(l_orderkey/40) AS BIGINT)*20000 + l_linenumber*1500
    + CAST(floor(l_extendedprice*100) AS BIGINT) % 500 AS pos0,
  CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand,
  CAST(floor(l_quantity) AS INT) AS mapq
FROM lineitem""",
    "fx_exon": """
SELECT DISTINCT chrom, start0, end1 FROM fx_exon_occ""",
    "fx_breakpoint": """
SELECT chrom, start0 AS p FROM fx_exon UNION SELECT chrom, end1 AS p FROM fx_exon
UNION SELECT chrom, CAST(0 AS BIGINT) AS p FROM fx_exon""",
    "fx_segment": """
SELECT * FROM (SELECT chrom, p AS start0,
  lead(p) OVER (PARTITION BY chrom ORDER BY p) AS end1 FROM fx_breakpoint) t WHERE end1 IS NOT NULL""",
    "fx_gblock": """
SELECT s.chrom, s.start0, s.end1, count(e.start0) AS n_exons
FROM fx_segment s LEFT JOIN fx_exon e
  ON e.chrom=s.chrom AND e.start0<=s.start0 AND e.end1>=s.end1
GROUP BY s.chrom, s.start0, s.end1""",
    "fx_jnx": """
SELECT DISTINCT gene_id, chrom, strand, start0, end1, next_start0, next_end1 FROM (
  SELECT *, lead(start0) OVER w AS next_start0, lead(end1) OVER w AS next_end1
  FROM fx_exon_occ WINDOW w AS (PARTITION BY tx_id ORDER BY start0, end1)) t
WHERE next_start0 IS NOT NULL""",
    "fx_aln": """
SELECT (l_orderkey*8 + l_linenumber)*1000000
    + (l_partkey*31 + l_suppkey*7 + CAST(floor(l_extendedprice*100) AS BIGINT)) % 1000000 AS ordinal,
  concat('r', CAST(l_orderkey AS STRING)) AS qname,
  CAST(1 + CASE WHEN l_linestatus='O' THEN 2 ELSE 0 END
    + CASE WHEN l_partkey % 50 = 0 THEN 4 ELSE 0 END
    + CASE WHEN l_partkey % 50 = 1 THEN 8 ELSE 0 END
    + CASE WHEN l_returnflag='R' THEN 16 ELSE 0 END
    + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
    + CASE WHEN l_suppkey % 17 = 0 THEN 512 ELSE 0 END
    + CASE WHEN l_suppkey % 11 = 0 THEN 1024 ELSE 0 END AS INT) AS flag,
  concat('chr', CAST(CAST(floor(l_orderkey/8) AS BIGINT) % 5 + 1 AS STRING)) AS rname,
  CAST(floor(l_orderkey/40) AS BIGINT)*2000 + l_linenumber*150
    + CAST(floor(l_extendedprice*100) AS BIGINT) % 60 AS pos0,
  CAST(floor(l_quantity) AS INT) AS mapq,
  CASE l_partkey % 5 WHEN 0 THEN '36M' WHEN 1 THEN '20M1D16M' WHEN 2 THEN '18M2I16M'
    WHEN 3 THEN '10M100N26M' ELSE '4S32M' END AS cigar,
  concat('chr', CAST(CASE WHEN l_suppkey % 13 = 0 THEN l_suppkey % 5
    ELSE CAST(floor(l_orderkey/8) AS BIGINT) % 5 END + 1 AS STRING)) AS mrnm,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 100 + l_suppkey % 4 ELSE -100 - l_suppkey % 4 END AS INT) AS isize,
  concat('lib', CAST(l_suppkey % 3 AS STRING)) AS library,
  CAST(floor(l_extendedprice) AS BIGINT) AS qsum
FROM lineitem""",
    "fx_whole": """
SELECT doc_id, concat('d', CAST(doc_id AS STRING)) AS contig,
  regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACG'),
    '[^ACGT]', 'N') AS seq FROM documents WHERE text IS NOT NULL""",
}
#: fx_aln with each row's place in its file, on Spark alone: reads that share an ordinal are in that order.
PLACED = VIEWS["fx_aln"].replace("\nFROM lineitem", ",\n  l_place AS place\nFROM lineitem")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _needed(text: str) -> list[str]:
    """The views that a text reads, each after those that it reads itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            out += [x for x in [*_needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(body: str, extra: dict[str, str] | None = None, how: str = "") -> str:
    """A query with the views that it reads as common table expressions; ``extra`` adds further ones, ``how`` qualifies each."""
    extra = extra or {}
    names = _needed(" ".join([body, *extra.values()]))
    recursive = any(re.search(rf"\b{n}\b", b) for n, b in extra.items())
    parts = [f"{n} AS {'' if re.search(rf'\b{n}\b', b) else how}({b})" for n, b in {**{n: VIEWS[n] for n in names}, **extra}.items()]
    if not parts:
        return body
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if recursive else f"WITH {', '.join(parts)}\n{body}"


def duckdb_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_views(body, extra, "MATERIALIZED ").replace("'[^ACGT]', 'N')", "'[^ACGT]', 'N', 'g')")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows on Spark."""
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def whole_chunks(spark: SparkSession, sf_dir: str, more: int = 0) -> DataFrame:
    """(contig, chunk, seq): the whole sequences of fx_whole, cut into chunks; an empty one is one empty chunk. ``more`` adds as many bases that follow, in a column of that name."""
    last = F.greatest(F.floor((F.length("seq") - 1) / CHUNK), F.lit(0)).cast("int")
    at = view(spark, sf_dir, "fx_whole").select("contig", "seq", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    piece = lambda start, size: F.substr("seq", start + 1, F.lit(size))
    follow = [piece((F.col("chunk") + 1) * CHUNK, more).alias("more")] if more else []
    return at.select("contig", "chunk", piece(F.col("chunk") * CHUNK, CHUNK).alias("seq"), *follow)


def sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    text = with_views(body)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)}
    if "l_place" in text:
        used["lineitem"] = used["lineitem"].select("*", F.col("_metadata.row_index").alias("l_place"))
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text), **used)
