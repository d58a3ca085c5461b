"""Training-data pipeline over ``documents``: what each stage keeps is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, decontaminate, langid, line_dedup, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is recognised; null and letterless texts and those far from every language go.

    Each row is judged by its own text, so repeated rows, tied ids and columns of other names change nothing.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return docs.filter(~langid.language_of(F.col("text"), model)["rejected"])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that an earlier document has; ``n_chars`` is counted anew.

    Rows that repeat an id aren't earlier than each other; null texts stay null.
    """
    return line_dedup.rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id (nulls last, ties by a hash of the row); of equal rows one.

    Rows are grouped by SimHash and by a similarity of 0.8 or more of their five-word shingle sets, which is verified.
    """
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text holds less than the contract's share of benchmark windows; rows that share an id are judged apart."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter("contaminated").select("doc_id", "text_key").distinct()
    return common.without(docs, gone, [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))], ["doc_id", "text_key"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows that are left, placed in sequences; a null text is its end id alone, repeated rows are packed each."""
    pieces = packing.tokenize_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit_pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written to the shared folder and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
