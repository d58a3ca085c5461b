"""Near-duplicates by SimHash, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Crowds, cut, held, mixed, release, row_key, spread_join, without
from .components import connected_components
from .near_copies import SIMILARITY, near_copy_links

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: A fingerprint's bits in blocks; fingerprints within RADIUS agree on BLOCKS - RADIUS of them.
BLOCKS = 6
#: Most values of a bucket that a task sends, and that are compared with each other; beyond that they meet at the values between them.
CROWD, DENSE = 256, 4096
#: Rows that a task takes at once.
ROWS_HELD = 1 << 17


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    if n < 512:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        columns, bits = hashes.view(np.uint8).reshape(n, 8), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """A text's fingerprint as a signed long; null texts are empty."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        held("simhash", None, dict)
        found = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts)).view(np.int64)
        release()
        return pa.array(found)

    return prints(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each document's fingerprint."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col), width).alias("fp"))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows, the k-th with bit k of every value, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    bits = np.unpackbits(np.pad(values, (0, n - len(values))).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _moved(planes: np.ndarray, shift: int) -> np.ndarray:
    """Bit planes of the values ``shift`` places further on."""
    words, bits = divmod(shift, 64)
    out = np.zeros_like(planes)
    if words < planes.shape[1]:
        out[:, : planes.shape[1] - words] = planes[:, words:]
    if bits:
        low = out >> np.uint64(bits)
        low[:, :-1] |= out[:, 1:] << np.uint64(64 - bits)
        out = low
    return out


def within_radius(planes: np.ndarray, shift: int, ask: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of the values that ``ask`` marks (packed), those at most ``radius`` bits from the value ``shift`` places on.

    The planes' differences run into carry-save counters, one bit of every count to a word; words in which each asked
    count has passed the radius are abandoned.
    """
    at = np.flatnonzero(ask)
    if not len(at):
        return ask
    own, other, alive = planes[:, at], _moved(planes, shift)[:, at], ask[at].copy()
    digits = (radius + 1).bit_length()
    counters = [np.zeros_like(alive) for _ in range(digits)]
    for k in range(64):
        carry = own[k] ^ other[k]
        for c in range(digits):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over, equal = carry, ~np.uint64(0)  # counts over the radius: a carry out, or a greater number
        for c in reversed(range(digits)):
            if radius >> c & 1:
                equal = equal & counters[c]
            else:
                over, equal = over | (equal & counters[c]), equal & ~counters[c]
        alive &= ~over
        if k % 8 == 7 and k < 63:
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):
                at, alive, own, other, counters = at[keep], alive[keep], own[:, keep], other[:, keep], [c[keep] for c in counters]
            if not len(at):
                break
    out = np.zeros_like(ask)
    out[at] = alive
    return out


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect each bucket's close values (a spanning forest, not all pairs). Keys are sorted."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(new, len(keys)))
    left = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(new, sizes)) - 1  # followers in the own bucket
    keep = np.repeat(sizes, sizes) > 1
    values, left = values[keep], left[keep]
    a: list[np.ndarray] = [np.empty(0, np.uint64)]
    b: list[np.ndarray] = [np.empty(0, np.uint64)]
    group = np.arange(len(values))  # each value's component, by its first value
    shift = 1
    while len(values):
        while shift > 1 and (deep := np.repeat(*_runs(left)) >= shift).mean() < 0.5:  # only buckets with pairs this far apart go on
            values, left, group = values[deep], left[deep], (np.cumsum(deep) - 1)[group[deep]]
            if not len(values):
                break
        if not len(values) or left.max() < shift:
            break
        planes, most = bit_planes(values), int(left.max())
        while shift <= most:
            asked = left >= shift
            asked[: len(values) - shift] &= group[: len(values) - shift] != group[shift:]  # who is connected already needn't be compared
            mask = np.packbits(asked, bitorder="little")
            mask = np.pad(mask, (0, planes.shape[1] * 8 - len(mask))).view(np.uint64)
            found = np.flatnonzero(np.unpackbits(within_radius(planes, shift, mask, radius).view(np.uint8), bitorder="little"))
            if len(found):
                joined = _joined(group, found, found + shift)
                a.append(values[found[joined]])
                b.append(values[found[joined] + shift])
            shift += 1
            if shift & (shift - 1) == 0:
                break
    return np.concatenate(a), np.concatenate(b)


def _joined(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Joins the components of the pairs (x, y) in ``group``; which pairs joined two."""
    ends, first = np.unique(np.stack([group[x], group[y]], 1), axis=0, return_index=True)
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    used = []
    for k, (p, q) in zip(first.tolist(), ends.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            used.append(k)
    old = np.array(sorted(root), np.int64)
    to = np.arange(len(group))
    to[old] = [find(i) for i in old.tolist()]
    group[:] = to[group]
    return np.array(used, np.int64)


def _runs(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's largest ``left`` and its size, as arguments of repeat."""
    start = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1] - 1]))
    return left[start], np.diff(np.append(start, len(left)))


#: Rows of a bucket: a mark that the bucket is crowded comes first, then its values. LONE values are in a crowded one.
MARK, VALUE, LONE = 0, 1, 2


def _buckets(batches: Iterator[pa.RecordBatch], masks: list[int], crowd: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, fp) of each value under each mask; a task sends ``crowd`` values of a bucket and gives further ones alone."""
    crowds = Crowds(crowd)
    for b in batches:
        fp = b.column(0).to_numpy()
        bucket = np.concatenate([mixed((fp & np.int64(m)) ^ np.int64(i + 1)) for i, m in enumerate(masks)]) if len(fp) else fp
        fp = np.tile(fp, len(masks)) if len(fp) else fp
        many, marks = crowds.beyond(bucket)
        lone = np.unique(fp[many])
        kind = np.repeat(np.array([VALUE, MARK, LONE], np.int8), [int((~many).sum()), len(marks), len(lone)])
        yield pa.record_batch([pa.array(np.concatenate([bucket[~many], marks, mixed(lone)])), pa.array(kind), pa.array(np.concatenate([fp[~many], np.zeros(len(marks), np.int64), lone]))], names=["bucket", "kind", "fp"])


def _links(batches: Iterator[pa.RecordBatch], radius: int, dense: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (bucket, kind, fp), sorted; values of a crowded bucket or of one beyond ``dense`` have a null b."""
    waiting: list[tuple[np.ndarray, ...]] = []
    passing = None  # a bucket whose values are all given alone

    def told(a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        ends = pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(len(alone), pa.int64())])
        return pa.record_batch([pa.array(np.concatenate([a.view(np.int64), alone])), ends], names=["a", "b"])

    def linked(bucket: np.ndarray, kind: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(bucket)))
        many = np.repeat((kind[starts] == MARK) | (sizes > dense), sizes)
        return told(*bucket_links(bucket[~many], fp[~many].view(np.uint64), radius), np.unique(fp[many & (kind == VALUE)]))

    none = np.empty(0, np.uint64)
    for batch in batches:
        bucket, kind, fp = (batch.column(i).to_numpy() for i in range(3))
        if (lone := kind == LONE).any():
            yield told(none, none, fp[lone])
            bucket, kind, fp = bucket[~lone], kind[~lone], fp[~lone]
        if passing is not None and len(bucket):
            stop = int(np.searchsorted(bucket, passing, "right"))
            yield told(none, none, fp[:stop][kind[:stop] == VALUE])
            if stop < len(bucket):
                passing = None
            bucket, kind, fp = bucket[stop:], kind[stop:], fp[stop:]
        if not len(bucket):
            continue
        waiting.append((bucket, kind, fp))
        if sum(len(x[0]) for x in waiting) < ROWS_HELD:
            continue
        bucket, kind, fp = (np.concatenate(c) for c in zip(*waiting, strict=True))
        stop = int(np.searchsorted(bucket, bucket[-1]))
        if stop:
            yield linked(bucket[:stop], kind[:stop], fp[:stop])
        bucket, kind, fp = bucket[stop:], kind[stop:], fp[stop:]
        if len(bucket) > dense:
            yield told(none, none, fp[kind == VALUE])
            passing = bucket[-1]
            bucket, kind, fp = bucket[:0], kind[:0], fp[:0]
        waiting = [(bucket, kind, fp)]
    if waiting and sum(len(x[0]) for x in waiting):
        yield linked(*(np.concatenate(c) for c in zip(*waiting, strict=True)))


def _around(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(key, d, fp): all values up to half the radius, rounded up, from each value."""
    flips = [(sum(1 << i for i in c), k) for k in range(-(-radius // 2) + 1) for c in combinations(range(64), k)]
    flip, d = np.array([f for f, _ in flips], np.uint64).view(np.int64), np.array([k for _, k in flips], np.int8)
    for b in batches:
        values = b.column(0).to_numpy()
        for at in range(0, len(values), 64):
            own = values[at : at + 64]
            yield pa.record_batch([pa.array((own[:, None] ^ flip).ravel()), pa.array(np.tile(d, len(own))), pa.array(np.repeat(own, len(flip)))], names=["key", "d", "fp"])


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each key's values to the nearest of them, where both distances come to no more than the radius. Rows come sorted by key and d.

    Two values within the radius have a key between them, and each is linked there to the one that is nearest to it.
    """
    key, least, first = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        k, d, fp = (b.column(i).to_numpy() for i in range(3))
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        own_d, own = np.where(at >= 0, d[at], least), np.where(at >= 0, fp[at], first)
        near = (own != fp) & (d + own_d <= radius)
        key, least, first = k[-1], own_d[-1], own[-1]
        pairs = np.unique(np.stack([np.minimum(own, fp)[near], np.maximum(own, fp)[near]], 1), axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def close_pairs(values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect all of the distinct longs ``fp`` within ``radius`` bits of each other.

    Values that close agree on ``blocks - radius`` of the blocks; each choice of that many is a table with those bits as
    key, so a bucket's expected size stays near one up to billions of values. A bucket of more than ``dense`` values, or of
    more than ``crowd`` in one task, isn't compared in one place: its values meet at the values between them instead, one
    row for each of those.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = values.select("fp").mapInArrow(partial(_buckets, masks=masks, crowd=crowd), "bucket long, kind byte, fp long")
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "kind", "fp")
    found = cut(dealt.mapInArrow(partial(_links, radius=radius, dense=dense), "a long, b long"))
    links, alone = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("fp"))
    if alone.isEmpty():
        return links
    between = alone.distinct().mapInArrow(partial(_around, radius=radius), "key long, d byte, fp long").repartition("key").sortWithinPartitions("key", "d")
    return links.unionByName(between.mapInArrow(partial(_stars, radius=radius), "a long, b long"))


def _grouped(own: DataFrame, best: Column, radius: int, more: DataFrame | None = None) -> DataFrame:
    """Rows ``own`` (fp, ...) with ``best``: the least of that column over all rows that links reach, those of ``more`` (a, b) included."""
    distinct = cut(own.groupBy("fp").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")))
    links = close_pairs(distinct, radius)
    roots = connected_components(links if more is None else links.unionByName(more)).withColumnRenamed("node", "fp")
    placed = cut(distinct.join(roots, "fp", "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root")))
    groups = cut(placed.groupBy("root").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("m")))
    names = cut(spread_join(placed.select("fp", "n", "root"), groups, ["root"], "m").select("fp", "n", "best"))
    return spread_join(own, names, ["fp"], "n").drop("n")


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id, the smallest doc_id linked to it.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked, and links chain. Equal fingerprints are
    one node, whatever their number. Null and empty texts have fingerprint 0 and are linked like any other; very long texts
    are read whole; repeated rows give a row each; rows that tie for the smallest id share it; a component without any
    doc_id has a null id; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    own = cut(fingerprints(docs, width, id_col, text_col))
    return _grouped(own, F.col("doc_id"), radius).select("doc_id", "fp", F.col("best").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays, whole.

    A group is what ``simhash_groups`` links and, with a ``similarity``, what ``near_copy_links`` verifies: texts whose sets of
    five-word shingles are alike to that degree, which fingerprints of one radius don't reach. Links chain. The row that
    stays is the one with the smallest id (nulls last); among rows with that id the one whose columns hash lowest; of rows
    that are equal in all columns one. Null texts count as empty here and stay null in the result; very long texts are read
    whole; an empty table gives no rows.
    """
    key, text_key = row_key(docs.columns), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col), width).alias("fp"), key.alias("row"), text_key.alias("text_key")))
    more = None
    if similarity is not None:
        links = near_copy_links(docs.select(text_key.alias("node"), F.col(text_col).alias("text")), similarity=similarity)
        more = links.unionByName(own.select(F.col("text_key").alias("a"), F.col("fp").alias("b")).distinct().join(links.select("a").distinct(), "a", "left_semi"))
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    lost = _grouped(own, me, radius, more).filter(F.col("best") != me).select("row", "text_key").distinct()
    left = without(docs, lost, [key, text_key], ["row", "text_key"])
    repeated = not own.groupBy("row", "text_key").count().filter("count > 1").isEmpty()
    return left.dropDuplicates() if repeated else left
