"""Exact duplicates, with frequent texts decided where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, sha256_hex

#: Share of the rows from which a digest counts as frequent; its inverse bounds what is broadcast.
SUPPORT = 1e-3


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): the longest original text stays, then the smallest id (null ids last)."""
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(best["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. A Misra-Gries pass finds every digest of more than
    ``support`` of the rows (and perhaps others, ``1 / support`` at most); exact counts verify them, and their winners are
    broadcast, so a text that a third of the rows share is never shuffled. All other digests are grouped by a shuffle.

    A null text counts as empty. Rows that repeat a doc_id with an equal text share one verdict and each count in
    ``group_size``. Of texts of equal length and id either may be told, as the verdict is the same. Very long texts are
    read whole and leave the row as a digest. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    text = F.col("text")
    rows = cut(id_and_text(docs, id_col, text_col).select("doc_id", F.char_length(text).alias("n_chars"), sha256_hex(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")).alias("digest")))
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    least = F.greatest(F.lit(1), F.floor(F.lit(rows.count() * support)))
    hot = cut(_winners(rows.join(F.broadcast(frequent), "digest", "left_semi")).filter(F.col("group_size") > least))
    head = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    tail = rest.join(_winners(rest), "digest")
    return head.unionByName(tail).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
