"""Benchmark decontamination as a prefix-filtered set join; DataFrame and SQL functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text

WINDOW_WORDS = 13
#: Words of a shingle; a shorter window is one shingle.
SHINGLE_WORDS = 3
#: One hit word in so many makes a document contaminated.
SHARE = 20
#: What ends a word.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows (some 300 bytes each) that are broadcast at once; more go in blocks of this number, each against all documents.
BLOCK_WINDOWS = 50_000


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), NOT_WORD), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, size, items): each distinct window of words with the items, as strings, that it is part of."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("ws")).filter(F.size("ws") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1))))
    rows = items.select("item", "ws", at.alias("at")).select("item", F.slice("ws", F.col("at"), width).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("size", F.size("window"))


def shingle(ws: str, at: Column, size: int) -> Column:
    """The hash of ``size`` words of a list, from a place on."""
    return F.xxhash64(F.lit(size), *(F.get(ws, at + j) for j in range(size)))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, offset, key) for each shingle of each window."""
    out = None
    for size in range(1, SHINGLE_WORDS + 1):
        own = windows.filter(F.col("size") >= size if size == SHINGLE_WORDS else F.col("size") == size)
        each = own.select("window", F.explode(F.sequence(F.lit(0), F.col("size") - size)).alias("offset")).select("window", "offset", shingle("window", F.col("offset"), size).alias("key"))
        out = each if out is None else out.unionByName(each)
    return out


def _shingled(split: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """Rows ``split`` (..., ws) for each place from ``first`` on, with the keys of its shingles; place -1 is the document itself."""
    at = split.withColumn("place", F.explode(F.sequence(F.lit(first), F.greatest(F.size("ws") - 1, F.lit(first))))).filter(F.col("place") < F.greatest(F.size("ws"), F.lit(first + 1)))
    own = [F.when(F.col("place") + size <= F.size("ws"), shingle("ws", F.col("place"), size)) for size in sizes]
    none = F.lit(None).cast("long")
    if len(own) == 1:
        return at.withColumn("key", F.when(F.col("place") >= 0, own[0]).otherwise(none))
    return at.withColumn("key", F.explode(F.when(F.col("place") >= 0, F.array(*own)).otherwise(F.array(none))))


def rarest(windows: DataFrame, split: DataFrame, sizes: list[int], blocks: int) -> DataFrame:
    """Windows with ``key``, the shingle that the documents have least often, and ``offset``, its first place in them.

    All of a window's shingles have to occur, so its prefix under the order by rarity is one shingle.
    """
    each = cut(window_shingles(windows))
    keys, counts = each.select("key").distinct(), None
    for b in range(blocks):
        part = keys.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        own = _shingled(split.select("ws"), sizes, 0).select("key").join(F.broadcast(part), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    n_of = F.broadcast(counts) if blocks == 1 else counts
    ranked = each.join(n_of, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"), F.col("offset"))).alias("p"))
    return windows.join(ranked, "window").select("window", "size", "items", F.col("p.key").alias("key"), F.col("p.offset").alias("offset"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, hits, items, contaminated, text_key (the text's 64-bit hash).

    ``hits`` are (start, length) of the windows that occur, in words; ``n_hit`` counts the words in any of them, ``items``
    are the ids, as strings, whose windows occur. A document is contaminated if at least one word in ``share`` is hit.

    How often the documents have each shingle of the windows orders a window's shingles by rarity. Places of its rarest one
    are the candidates; the window's place in the document has to lie within its bounds, and the words there have to be
    the window's. Windows are broadcast, ``block_windows`` at a time, so documents stay where they are read, nothing is
    dealt by words, and only windows that occur leave the row they are found in.

    Null and empty texts have no words and no hits; very long texts are read whole; items without words are dropped; a null
    item id is the string ''. Each row gives a row, repeated ones too. An empty table of documents gives no rows; without
    items nothing is hit. Other columns, whatever their names, are ignored.
    """
    docs = id_and_text(docs, id_col, text_col)
    windows = cut(item_windows(benchmark, width, item_col, item_text_col))
    found = windows.agg(F.count(F.lit(1)), F.collect_set(F.least("size", F.lit(SHINGLE_WORDS)))).first()
    blocks, sizes = max(1, -(-found[0] // block_windows)), sorted(found[1]) or [SHINGLE_WORDS]
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("ws"))
    chosen = cut(rarest(windows, split, sizes, blocks))
    start, spans = F.col("place") - F.col("offset"), None
    hit = F.when(F.col("window").isNotNull(), F.struct(start.cast("long").alias("start"), F.col("size").cast("long").alias("length")))
    for b in range(blocks):
        part = F.broadcast(chosen.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)).withColumnRenamed("key", "rare")
        same = (start >= 0) & (start + F.col("size") <= F.size("ws")) & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("window"))
        # the place -1 stands for the document itself, so each row is counted once whatever it matches
        rows = _shingled(split, sizes, -1 if b == 0 else 0).join(part, (F.col("key") == F.col("rare")) & same, "left").filter("place = -1 or window is not null")
        rows = rows.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"), F.when(F.col("place") == -1, 1).otherwise(0).alias("own"), hit.alias("hit"), "items")
        spans = rows if spans is None else spans.unionByName(rows)
    one = spans.groupBy("doc_id", "text_key", "n_words").agg(F.sum("own").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    end = lambda h: h["start"] + h["length"]
    n_hit = F.aggregate("hits", zero, lambda a, h: F.struct(F.greatest(a["end"], end(h)).alias("end"), (a["n"] + F.greatest(end(h) - F.greatest(a["end"], h["start"]), F.lit(0).cast("long"))).alias("n")), lambda a: a["n"])
    each = one.withColumn("n_hit", n_hit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_hit", "hits", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "text_key")
