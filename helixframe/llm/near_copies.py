"""Links of near copies: texts whose sets of word shingles are alike, found by MinHash bands and verified on the sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, held, mixed, spread_join, stored, tidy

WORDS, SIMILARITY = 5, 0.8
#: Bands, rows of each, and representatives of a band's bucket: texts alike to 0.8 share a bucket with a chance of 0.998.
BANDS, ROWS, LEADS = 16, 5, 3
#: Sets that are compared with one representative in one task.
SHARE = 1000
#: Sets of a bucket that are held in one task, where those are compared that its representatives leave apart.
SIDE = 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.default_rng(1)
_FACTORS, _SHIFTS = (_RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 1 << 17


class _Hashes(dict):
    """The hashes of words seen; emptied when they are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: dict, width: int) -> np.ndarray:
    """The text's different word shingles as sorted 32-bit hashes; a shorter text is one shingle, one without words none."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = (total ^ h[k : k + len(total)]) * _STEP
        total ^= total >> np.uint64(29)
    return np.unique((total >> np.uint64(32)).astype(np.uint32))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band: a hash of the band's number and of its least permuted elements."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096].astype(np.uint64) * _STEP
        y = x[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
        least = np.minimum(least, (y ^ y >> np.uint64(31)).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed((key * _STEP ^ least[r::ROWS]).view(np.int64)).view(np.uint64)
    return key.view(np.int64)


def set_key(own: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(own.tobytes())
    return h - (1 << 64) if h >> 63 else h


@tidy
def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = held("near_copies", None, _Hashes)
    for b in batches:
        node, keys, bands = [], [], []
        for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = shingle_set(t.as_py(), hashes, width)
            if len(own):
                node.append(n)
                keys.append(set_key(own))
                bands.append(band_keys(own))
        flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(bands) + 1, BANDS), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(keys, pa.int64()), lists], names=["node", "key", "bands"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = held("near_copies", None, _Hashes)
    for b in batches:
        own = [shingle_set(t.as_py(), hashes, width) for t in b.column(0)]
        own = [x for x in own if len(x)]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["key", "own"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


@tidy
def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of sets with their representative, which comes first of each group (lead, deal)."""
    group, lead = None, np.empty(0, np.uint32)
    for b in batches:
        out = []
        for k, d, kind, key, own in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
            x = np.frombuffer(own.as_buffer(), np.uint32)
            if kind == 0:
                group, lead = (k, d), x.copy()
            elif group == (k, d) and alike(lead, x, similarity):
                out.append((key, k))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


@tidy
def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of the sets of each two blocks (band, lo, hi) that aren't connected yet. Rows come sorted, those of the first block (side 0) first.

    Sets of one ``rep`` are connected. The first block's sets are held, and a block is compared with itself where lo = hi.
    """
    group, kept, up = None, [], {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for b in batches:
        out = []
        for *own_group, side, rep, key, own in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
            if own_group != group:
                group, kept, up = own_group, [], {}
            x = np.frombuffer(own.as_buffer(), np.uint32)
            if side or own_group[1] == own_group[2]:
                for other, other_rep, y in kept:
                    if (mine := root(rep)) != (theirs := root(other_rep)) and alike(x, y, similarity):
                        out.append((max(key, other), min(key, other)))
                        up[theirs] = mine
            if not side:
                kept.append((key, rep, x.copy()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _left_apart(met: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a bucket that are no representatives and that those leave apart: every such pair is compared.

    ``met``: (key, band, places, leads). Members linked to one representative are connected; a bucket whose members all are
    has nothing to compare. The others' members are dealt into blocks of SIDE, each two of which are one group.
    """
    rest = met.filter((F.col("places") > 2) & ~F.array_contains("leads", F.col("key"))).select("key", "band", F.posexplode("leads").alias("k", "lead"))
    found = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("linked"))
    tied = rest.join(found, (F.greatest("key", "lead") == F.col("_a")) & (F.least("key", "lead") == F.col("_b")), "left")
    own = cut(tied.groupBy("band", "key").agg(F.min(F.when(F.col("linked"), F.struct("k", "lead"))).alias("first")).select("band", "key", F.coalesce("first.lead", "key").alias("rep")))
    open_ = own.groupBy("band").agg(F.count(F.lit(1)).alias("places"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    open_ = cut(open_.select("band", "places", F.ceil(F.col("places") / SIDE).alias("blocks")))
    dealt = spread_join(own, open_, ["band"], "places").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "key")
    rows = dealt.join(sets, "key").select("band", "lo", "hi", "side", "rep", "key", "own").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "side", "rep")
    return rows.mapInArrow(partial(_compared, similarity=similarity), "a long, b long")


def near_copy_links(rows: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` (node long, text) and keys of their texts' shingle sets, and between keys of sets alike.

    Sets of equal elements have one key. A set is compared with up to LEADS representatives of each of its BANDS buckets, which
    connects a bucket of near copies at the cost of its rows; members that they leave apart are compared with each other, in
    blocks, unless connected already. Each comparison is made on the whole sets. Keys are
    64-bit hashes; components over the links put the nodes of near copies together. Texts without words, null ones included,
    have no links; repeated rows are one; very long texts are read whole; an empty table gives no rows.
    """
    texts = rows.select("node", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    signed = stored(texts.mapInArrow(partial(_signed, width=width), "node long, key long, bands array<long>"))
    bucketed = signed.dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    order = [F.xxhash64("key", "band", F.lit(k)) for k in range(LEADS)]
    leads = bucketed.groupBy("band").agg(F.count(F.lit(1)).alias("places"), *(F.min(F.struct(o.alias("o"), "key")).getField("key").alias(f"lead{k}") for k, o in enumerate(order))).filter("places > 1")
    met = spread_join(bucketed, cut(leads), ["band"], "places").select("key", "band", "places", F.array_distinct(F.array(*(f"lead{k}" for k in range(LEADS)))).alias("leads"))
    pairs = cut(met.select("key", F.explode("leads").alias("lead")).filter("key <> lead").select(F.greatest("key", "lead").alias("key"), F.least("key", "lead").alias("lead")).distinct())
    degree = cut(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("places")).withColumn("deals", F.ceil(F.col("places") / SHARE)))
    dealt = spread_join(pairs, degree, ["lead"], "places").select("key", "lead", F.pmod(F.xxhash64("key"), F.col("deals")).alias("deal"))
    needed = cut(pairs.select("key").unionByName(pairs.select(F.col("lead").alias("key"))).distinct())
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = stored(texts.select("text").mapInArrow(partial(_sets, width=width), "key long, own binary").join(side, "key", "left_semi").dropDuplicates(["key"]))
    heads = degree.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")).join(sets.withColumnRenamed("key", "lead"), "lead").select("lead", "deal", F.lit(0).alias("kind"), F.col("lead").alias("key"), "own")
    others = dealt.join(sets, "key").select("lead", "deal", F.lit(1).alias("kind"), "key", "own")
    side_by_side = heads.unionByName(others).repartition("lead", "deal").sortWithinPartitions("lead", "deal", "kind")
    links = cut(side_by_side.mapInArrow(partial(_verified, similarity=similarity), "a long, b long"))
    links = cut(links.unionByName(_left_apart(met, links, sets, similarity)).distinct())
    linked = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).distinct()
    several = signed.select("node", "key").distinct()
    shared = several.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    own = several.join(linked.unionByName(shared).distinct(), "key", "left_semi")
    return own.select(F.col("node").alias("a"), F.col("key").alias("b")).unionByName(links)
