"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Crowds, cut, held, id_and_text, mixed, spread_join, stored, tidy
from .components import connected_components

#: Most edits between longer lines that count as the same.
EDITS = 2
#: Shortest line that is compared at all, and shortest that is compared by edits; those between are compared exactly.
MIN_CHARS, NEAR_CHARS = 1, 20
#: A segment's lines are compared in pairs up to the square of this number; those of commoner segments are linked by their variants.
HOT = 1024
#: Lines of one segment that a task sends to be compared; what goes beyond is linked by variants.
CROWD = 128
#: Pairs a line that a segment's lines may give, on average; the lines of one with more are laid side by side instead.
FEW = 4
#: Rows that a task takes at once.
ROWS_HELD = 1 << 17
#: Lines that a task remembers, to send the segments of a line that it meets again but once.
LINES_KEPT = 200_000
#: Base of the variants' polynomial hashes, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Up to so many line ids are broadcast (8 bytes each) to fetch their texts; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
BLANKS = " \t\r\x0b\x0c"


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or most + 1 where it is greater.

    The columns' vertical differences are bits of one number (positive and negative ones); only the band of ``most``
    diagonals to each side of the main one is kept, as nothing outside it can matter.
    """
    if a == b:
        return 0
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for k, c in enumerate(b):
        low = max(0, k - most)
        band = ((1 << min(len(a), k + most + 1) - low) - 1) << low if low < len(a) else 0
        match = places.get(c, 0) & band
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        right, left = minus | ~(diagonal | plus) & full, plus & diagonal
        distance += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        left = left << 1 & full
        plus, minus = (left | ~(diagonal | right) & full), right & diagonal
        if distance - (len(b) - 1 - k) > most:
            return most + 1
    return min(distance, most + 1)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 nearly equal segments of a line."""
    size, longer = divmod(length, edits + 1)
    cuts = [i * size + max(0, i - (edits + 1 - longer)) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings of a line that may equal a segment of a line as long or shorter.

    With i edits at most left of segment i and the rest right of it, a segment can have moved only so far.
    """
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        more = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            for start in range(max(0, at - i, at + more - (edits - i)), min(length - size, at + i, at + more + edits - i) + 1):
                out.append((other, i, start, size))
    return out


def signature(line: str) -> int:
    """Parities of 64 classes of characters; an edit changes two at most."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.packbits((np.bincount(codes & 63, minlength=64) & 1).astype(np.uint8), bitorder="little").view(np.int64)[0])


#: The last two bits of a key: a mark that the key is crowded, a line's own segment, a probe, a line given alone.
MARK, OWN, PROBE, LONE = 0, 1, 2, 3


@tidy
def _keys(batches: Iterator[pa.RecordBatch], edits: int, least: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """(key, line, sign) of texts: each line's own segments, and its probes for others; line is its 64-bit hash.

    A task sends a line that it meets again but once, as far as it remembers. Of a key that more than ``crowd`` of its lines
    have it sends a mark; further lines of it are given alone, under keys of their own, so that they don't meet in one task.
    """
    digest, plans, seen = xxhash.xxh64_intdigest, held("line_dedup", edits, dict), set()
    crowds = Crowds(crowd)

    def plan(n: int) -> list[tuple[int, int, int, int]]:
        if n not in plans:
            own = [(n, i, at, size) for i, (at, size) in enumerate(segments(n, edits))]
            plans[n] = [(k[0] * 8 + k[1], k[2], k[2] + k[3], OWN) for k in own] + [(k[0] * 8 + k[1], k[2], k[2] + k[3], PROBE) for k in probes(n, edits) if k not in own]
        return plans[n]

    def made(keys: list[int], lines: list[int], signs: list[int], times: list[int]) -> pa.RecordBatch:
        key, n = np.array(keys, np.uint64).view(np.int64), np.array(times)
        line, sign = np.repeat(np.array(lines, np.uint64).view(np.int64), n), np.repeat(np.array(signs, np.int64), n)
        many, marks = crowds.beyond(key >> 2)
        if many.any():
            alone = np.unique(line[many])
            key = np.concatenate([key[~many], marks << 2, mixed(alone) | LONE])
            line = np.concatenate([line[~many], np.zeros(len(marks), np.int64), alone])
            sign = np.concatenate([sign[~many], np.zeros(len(marks) + len(alone), np.int64)])
        return pa.record_batch([pa.array(key), pa.array(line), pa.array(sign)], names=["key", "line", "sign"])

    for b in batches:
        keys: list[int] = []
        lines: list[int] = []
        signs: list[int] = []
        times: list[int] = []
        for text in b.column(0):
            for line in text.as_py().split("\n"):
                line = line.strip(BLANKS)
                if len(line) < least:
                    continue
                h = digest(line, 42)
                if h in seen:
                    continue
                if len(seen) >= LINES_KEPT:
                    seen.clear()
                seen.add(h)
                own = dict.fromkeys(digest(line[a:e], seed) >> 2 << 2 | kind for seed, a, e, kind in plan(len(line)))
                keys += own
                lines.append(h)
                signs.append(signature(line))
                times.append(len(own))
            if len(keys) > 100_000:
                yield made(keys, lines, signs, times)
                keys, lines, signs, times = [], [], [], []
        if keys:
            yield made(keys, lines, signs, times)


@tidy
def _candidates(batches: Iterator[pa.RecordBatch], edits: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of lines that share a key, at least one by a segment of its own, with near signatures. Rows come sorted by key and line.

    A key of more than FEW pairs a line gives those lines instead, as (a, null, pack, own), which are compared side by side. Lines of a
    crowded key, or whose own segment comes with too many others to compare all pairs, are given alone, with a null b and pack.
    """
    waiting: list[tuple[np.ndarray, ...]] = []
    passing = None  # a key whose lines are all given alone

    def once(key: np.ndarray, line: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, ...]:
        """A line that several tasks sent comes in a row of its own for each."""
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        return key[new], line[new], sign[new]

    def alone(line: np.ndarray) -> pa.RecordBatch:
        line = np.unique(line)
        none = pa.nulls(len(line), pa.int64())
        return pa.record_batch([pa.array(line), none, none, none.cast(pa.bool_())], names=["a", "b", "pack", "own"])

    def paired(key: np.ndarray, line: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, key = key & 3, key >> 2
        own = kind == OWN  # a key's mark comes first, then its own lines, then the probes
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat((sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) * sizes > hot * hot) | (kind[starts] == MARK), sizes)
        if many.any():
            yield alone(line[many & (kind != MARK)])
        left, right = [], []
        shift, at = 1, np.flatnonzero(own & ~many)
        while len(at):
            at = at[at + shift < len(key)]
            at = at[key[at] == key[at + shift]]
            good = (line[at] != line[at + shift]) & (np.bitwise_count((sign[at] ^ sign[at + shift]).view(np.uint64)) <= 2 * edits)
            left.append(at[good])
            right.append(at[good] + shift)
            shift += 1
        x, y = (np.concatenate(i) if i else np.empty(0, np.int64) for i in (left, right))
        group = np.repeat(np.arange(len(starts)), sizes)
        packed = (np.bincount(group[x], minlength=len(starts)) > FEW * sizes)[group[x]]
        members = np.unique(np.concatenate([x[packed], y[packed]]))
        yield pa.record_batch([pa.array(line[members]), pa.nulls(len(members), pa.int64()), pa.array(key[members]), pa.array(own[members])], names=["a", "b", "pack", "own"])
        a, b = line[x[~packed]], line[y[~packed]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none.cast(pa.bool_())], names=["a", "b", "pack", "own"])

    for batch in batches:
        key, line, sign = (batch.column(i).to_numpy() for i in range(3))
        if (lone := key & 3 == LONE).any():
            yield alone(line[lone])
            key, line, sign = key[~lone], line[~lone], sign[~lone]
        if passing is not None and len(key):
            stop = int(np.searchsorted(key >> 2, passing, "right"))
            if stop:
                yield alone(line[:stop][key[:stop] & 3 != MARK])
            if stop < len(key):
                passing = None
            key, line, sign = key[stop:], line[stop:], sign[stop:]
        if not len(key):
            continue
        waiting.append((key, line, sign))
        if sum(len(x[0]) for x in waiting) < ROWS_HELD:
            continue
        key, line, sign = once(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
        stop = int(np.searchsorted(key >> 2, key[-1] >> 2))
        if stop:
            yield from paired(key[:stop], line[:stop], sign[:stop])
        key, line, sign = key[stop:], line[stop:], sign[stop:]
        if len(key) >= ROWS_HELD // 2:  # one key
            own = key & 3 == OWN
            if key[0] & 3 == MARK or int(own.sum()) * len(key) > hot * hot:
                yield alone(line[key & 3 != MARK])
                passing = key[-1] >> 2
                key, line, sign = key[:0], line[:0], sign[:0]
            elif not own[-1:].all():  # no further own lines: the few there are meet the probes as they come
                yield from paired(key, line, sign)
                key, line, sign = key[own], line[own], sign[own]
        waiting = [(key, line, sign)]
    if waiting and sum(len(x[0]) for x in waiting):
        yield from paired(*once(*(np.concatenate(c) for c in zip(*waiting, strict=True))))


def _places(n: int, k: int, start: int = 0) -> Iterator[list[np.ndarray]]:
    """The choices of k increasing places below n, as k columns."""
    if k == 0:
        yield []
    elif k == 1:
        yield [np.arange(start, n)]
    elif k == 2 and n - start <= 1024:
        a, b = np.triu_indices(n - start, 1)
        yield [a + start, b + start]
    else:
        for p in range(start, n - k + 1):
            for rest in _places(n, k - 1, p + 1):
                yield [np.full(len(rest[0]), p), *rest]


def _hashed(line: str, edits: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(hashes, d, w): the line with d characters left out and w blotted out, for every choice of up to ``edits`` places."""
    with np.errstate(over="ignore"):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        for step in (30, 27):
            codes = (codes ^ codes >> np.uint64(step)) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(31)
        n = len(codes)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]), dtype=np.uint64)
        back = [np.uint64(pow(INVERSE, t, 1 << 64)) for t in range(edits + 1)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:n], dtype=np.uint64)])
        for k in range(edits + 1):
            for ops in product((0, 1), repeat=k):  # 1: left out
                for places in _places(n, k):
                    out, gone, at = np.zeros(len(places[0]) if k else 1, np.uint64), 0, 0
                    for p, op in zip(places, ops, strict=True):
                        out = out + (sums[p] - sums[at]) * back[gone]
                        if op:
                            gone += 1
                        else:
                            out = out + power[p - gone] * np.uint64(0xD6E8FEB86659FD93)
                        at = p + 1
                    yield out + (sums[n] - sums[at]) * back[gone], gone, k - gone


def _variants(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """(key, d, room, line) for the variants of rows (id, line): ``room`` is how many characters two lines may leave out together."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        n = [len(h) for h, *_ in rows]
        column = lambda i, kind: pa.array(np.repeat(np.array([r[i] for r in rows], kind), n))
        return pa.record_batch([pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), column(1, np.int8), column(2, np.int8), column(3, np.int64)], names=["key", "d", "room", "line"])

    for b in batches:
        rows, total = [], 0
        for own, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for hashes, d, w in _hashed(line, edits):
                rows.append((hashes, d, edits - w, own))
                total += len(hashes)
                if total > ROWS_HELD:
                    yield made(rows)
                    rows, total = [], 0
        if rows:
            yield made(rows)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the lines of each key to the one that leaves out least, where both leave out no more than ``room``. Rows come sorted by key and d.

    Who leaves out no more than room together with another does so with that one, so all that are near get connected.
    """
    key, least, first = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        k, d, room, line = (b.column(i).to_numpy() for i in range(4))
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        own_d, own = np.where(at >= 0, d[at], least), np.where(at >= 0, line[at], first)
        near = (own != line) & (d + own_d <= room)
        key, least, first = k[-1], own_d[-1], own[-1]
        pairs = np.unique(np.stack([np.minimum(own, line)[near], np.maximum(own, line)[near]], 1), axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


@tidy
def _verified(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = [i for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if edit_distance(x, y, edits) <= edits]
        yield b.select([0, 1]).take(pa.array(near, pa.int64()))


@tidy
def _linked(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect all lines (pack, own, id, line) of each pack that are near. Rows come sorted by pack, own ones first.

    Only lines that aren't connected yet are compared, so a pack of lines that are near each other costs about a comparison a
    line, and n lines give n - 1 links at most. The own lines, HOT at most, are held; the others pass by.
    """
    known, ids, lines = None, [], []
    signs, roots = np.empty(0, np.uint64), np.empty(0, np.int64)
    for b in batches:
        out = []
        for pack, own, me, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if pack != known:
                known, ids, lines = pack, [], []
                signs, roots = np.empty(16, np.uint64), np.empty(16, np.int64)
            n, sign, mine = len(ids), np.int64(signature(line)).view(np.uint64), len(ids)
            near = np.bitwise_count(signs[:n] ^ sign) <= 2 * edits
            while near.any():
                k = int(near.argmax())
                near[k] = False
                if ids[k] != me and edit_distance(lines[k], line, edits) <= edits:
                    out.append((min(me, ids[k]), max(me, ids[k])))
                    if mine < n:
                        roots[:n][roots[:n] == roots[k]] = mine
                    else:
                        mine = int(roots[k])
                    near &= roots[:n] != mine
            if own:
                if n == len(signs):
                    signs, roots = np.resize(signs, 2 * n), np.resize(roots, 2 * n)
                ids.append(me)
                lines.append(line)
                signs[n], roots[n] = sign, mine
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_key, at, line) for the trimmed lines of ``least`` characters and more."""
    each = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.withColumn("line", F.trim("line", F.lit(BLANKS))).filter(F.char_length("line") >= least)


def _digests(line: str) -> list[Column]:
    """128 bits of a line, by which its places find it."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def near_lines(rows: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS, hot: int = HOT, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Different lines (id, line) of ``rows`` (doc_id, text), and links (a, b) of ids that connect all lines within ``edits`` of each other."""
    least = max(near_chars, edits + 1)
    keyed = rows.select("text").mapInArrow(partial(_keys, edits=edits, least=least, crowd=crowd), "key long, line long, sign long")
    dealt = keyed.repartition(F.shiftright("key", 2)).sortWithinPartitions("key", "line")
    found = cut(dealt.mapInArrow(partial(_candidates, edits=edits, hot=hot), "a long, b long, pack long, own boolean").distinct())
    wanted = found.select(F.explode(F.array("a", "b")).alias("short")).filter("short is not null").distinct()
    few = wanted.count() <= BROADCAST_LINES
    lines = _lines(rows, least).select(F.xxhash64("line").alias("short"), "line").join(F.broadcast(wanted) if few else wanted, "short", "left_semi").distinct()
    texts = stored(lines.select(F.monotonically_increasing_id().alias("id"), "short", "line"))  # a hash may stand for several lines
    ends = lambda name: texts.select(F.col("short").alias(name), F.col("id").alias(f"{name}_id"))
    pairs = found.filter("b is not null").join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    many = found.filter("b is null and pack is null").select(F.col("a").alias("short"))
    if not many.isEmpty():
        common = texts.join(many, "short", "left_semi").select("id", "line").repartition("id")
        spread = common.mapInArrow(partial(_variants, edits=edits), "key long, d byte, room byte, line long").repartition("key").sortWithinPartitions("key", "d")
        pairs = pairs.unionByName(spread.mapInArrow(_stars, "a long, b long"))
    both = cut(pairs.distinct()).join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    near = both.select("a", "b", "x", "y").mapInArrow(partial(_verified, edits=edits), "a long, b long")
    packs = found.filter("pack is not null").select("pack", "own", F.col("a").alias("short"))
    if not packs.isEmpty():
        side_by_side = packs.join(texts, "short").select("pack", "own", "id", "line").repartition("pack").sortWithinPartitions("pack", F.desc("own"))
        near = near.unionByName(side_by_side.mapInArrow(partial(_linked, edits=edits), "a long, b long"))
    return texts, near


def line_classes(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """(h, h2, n, class, first) of each line of ``rows`` (doc_id, text) that is met n > 1 times or linked.

    ``class`` is a (h, h2) of the linked lines or the line's own, and ``first`` is the smallest doc_id that has one of them.
    """
    texts, links = near_lines(rows, edits, near_chars, hot, crowd)
    named = texts.select("id", *_digests("line"))
    roots = connected_components(links)
    named_roots = named.join(roots.select(F.col("node").alias("id"), "root"), "id").select("h", "h2", "root")
    named_roots = cut(named_roots.join(named.select(F.col("id").alias("root"), F.struct("h", "h2").alias("class")), "root").select("h", "h2", "class"))
    exact = _lines(rows, min_chars).select("doc_id", *_digests("line")).groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    known = cut(exact.join(named_roots, ["h", "h2"], "left").filter("n > 1 or class is not null").withColumn("class", F.coalesce("class", F.struct("h", "h2"))))
    firsts = cut(known.groupBy("class").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("m")))
    return spread_join(known.drop("first"), firsts, ["class"], "m").select("h", "h2", "n", "class", "first")


def _removed(docs: DataFrame, edits: int, min_chars: int, near_chars: int, id_col: str, text_col: str, hot: int, crowd: int) -> DataFrame:
    """(doc_id, text_key, removed): the line numbers that go from each document that loses any."""
    rows = id_and_text(docs, id_col, text_col)
    known = cut(line_classes(rows, edits, min_chars, near_chars, hot, crowd))
    places = _lines(rows, min_chars).select("doc_id", "text_key", "at", *_digests("line"))
    earlier = F.coalesce(F.col("first") < F.col("doc_id"), F.col("first").isNotNull())
    met = spread_join(places, known, ["h", "h2"], "n").select("doc_id", "text_key", "class", "at", earlier.alias("earlier"))
    own = met.repartition("doc_id", "text_key").groupBy("doc_id", "text_key", "class").agg(F.min("at").alias("own"), F.collect_set("at").alias("ats"), F.bool_or("earlier").alias("earlier"))
    gone = own.select("doc_id", "text_key", F.when(F.col("earlier"), F.col("ats")).otherwise(F.array_remove("ats", F.col("own"))).alias("ats")).filter("size(ats) > 0")
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list("ats"))).alias("removed"))


def _judged(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_key, ...) with the line numbers that each loses, null where none."""
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "removed").hint("shuffle_hash")
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left").drop("_doc", "_key")


def _kept(lines: str, removed: str) -> Column:
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0), kept (the text without them).

    Lines end in line feeds, and blanks at both ends are not compared. Lines of ``min_chars`` characters and more are: those
    under ``near_chars`` are linked if they are equal, longer ones if they are at most ``edits`` edits apart. Links chain, and
    of each class only the lines of the smallest doc_id stay, of those the first. (With 1 for ``min_chars`` blank lines stay.)

    A longer line is cut into edits + 1 segments, one of which survives any ``edits``
    edits: it is looked for in lines up to ``edits`` longer at the places it can have moved to. What shares a segment and
    nearly the parities of its characters is verified by the edit distance of the texts. Lines of a segment that gives more than
    FEW pairs a line lie side by side in one task, where only lines that aren't connected yet are compared. Lines of a segment that more than
    some ``hot`` lines, or more than ``crowd`` of one task, have are not compared in pairs: of each of them all variants
    with up to ``edits`` characters left or blotted out are made, and those of one variant are linked to one line, which
    takes work in proportion to the lines and the square of their length.

    Null texts are empty; an empty text is one empty line; a very long text or line is compared whole. A null id comes after
    all others. Rows that repeat an id aren't earlier than each other: each keeps its own first line of a class. Rows that
    are equal are judged alike. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    judged = _judged(rows, _removed(docs, edits, min_chars, near_chars, id_col, text_col, hot, crowd))
    parts = judged.select("doc_id", F.split("text", "\n").alias("ls"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return parts.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", _kept("ls", "removed").alias("kept"))


def rewrite(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``documents`` rows with the lines that line_dedup removes taken out of ``text`` and ``n_chars`` counted anew.

    All rows and columns stay, null texts as nulls; a text that loses nothing is unchanged.
    """
    names, gone = docs.columns, _removed(docs, edits, min_chars, near_chars, "doc_id", "text", HOT, CROWD)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    both = _judged(held, gone).select("row", "removed", F.split("row.text", "\n").alias("ls"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(_kept("ls", "removed"))
    new = {"text": text, "n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in names else {"text": text}
    return both.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
