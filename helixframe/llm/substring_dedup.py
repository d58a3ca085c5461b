"""Removal of passages that an earlier document has, by suffix automata of reference passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import cut, held, id_and_text

WINDOW_WORDS, GRAM_WORDS = 13, 4
#: Tokens that a task's automaton takes before it is begun anew, where a group of passages ends, or takes no more of one group.
SHARD_TOKENS = 100_000
WORDS_KEPT = 400_000
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def minimizers(ws: list[bytes], window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> np.ndarray:
    """For each window of words the least hash of the grams in it: windows of the same words have the same."""
    n = len(ws)
    if n < window:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held("substring_dedup", "words", _WordHashes).__getitem__, ws), np.uint64, n)
    g = h[: n - gram + 1].copy()
    for j in range(1, gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[j : n - gram + 1 + j]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    wide, have, least = window - gram + 1, 1, g
    while have < wide:
        more = min(have, wide - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    return least


def _emit(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, owners = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            m = minimizers(text.as_py().split(), window)
            if len(m):
                own = np.unique(m[np.concatenate([[True], m[1:] != m[:-1]])])
                keys.append(own)
                owners.append(np.full(len(own), doc, np.int64))
        if keys:
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "doc"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc) sorted by both, those whose key has several docs."""
    key, doc, told = None, 0, False  # the last row's group and its first doc; whether that doc is out
    for b in batches:
        if not b.num_rows:
            continue
        k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, d[at], doc)
        other = d != first
        ids = np.cumsum(new)
        lead = np.flatnonzero(other & np.concatenate([[True], ~other[:-1] | new[1:]]))  # with its second doc a group's first is out
        lead = lead[(at[lead] >= 0) | (not told)]
        out_k, out_d = [k[other], k[lead]], [d[other], first[lead]]
        last = bool(other[ids == ids[-1]].any())
        told = last or (bool(told) and not new.any())
        key, doc = k[-1], int(first[-1])
        yield pa.record_batch([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_d))], names=["key", "doc"])


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Stretches (key, doc, text_key, start, words) of windows that share their minimizer with another document."""
    for b in batches:
        rows: list[tuple] = []
        for doc, tk, text, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            ws = text.as_py().split()
            m = minimizers(ws, window).view(np.int64)
            if not len(m):
                continue
            wanted = np.unique(np.asarray(keys.values.to_numpy(zero_copy_only=False), np.int64))
            starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            ends = np.append(starts[1:], len(m)) - 1
            place = np.minimum(np.searchsorted(wanted, m[starts]), len(wanted) - 1)
            for s, e in zip(starts[hit := wanted[place] == m[starts]].tolist(), ends[hit].tolist(), strict=True):
                rows.append((int(m[s]), doc, tk, s, b" ".join(ws[s : e + window])))
            if len(rows) > 20_000:
                yield _piece_batch(rows)
                rows = []
        if rows:
            yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    k, d, t, s, w = zip(*rows, strict=True)
    return pa.record_batch([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.int32()), pa.array(w, pa.binary())], names=["key", "doc", "text_key", "start", "words"])


def _match(batches: Iterator[pa.RecordBatch], window: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Spans (doc, text_key, start, length) that a smaller doc has; pieces come sorted by key and doc.

    The automaton holds what the key's smaller docs say. Pieces of one doc are matched first and then added, unless the
    automaton has all of their windows already. It is begun anew where a key ends, once it is large. A key that brings
    more than ``shard`` tokens adds no more: its later pieces are matched, and what of them isn't found is given with its
    words, to be compared with each other by ``_windows``.
    """
    automaton, size, began, full = SuffixAutomaton(), 0, 0, False
    key = doc = None
    waiting: list[list[bytes]] = []
    for b in batches:
        out: list[tuple] = []
        for k, d, tk, start, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if k != key:
                waiting = []
                key, doc = k, d
                if size:
                    automaton, size = (SuffixAutomaton(), 0) if size > shard else (automaton, size)
                began, full = size, False
            elif d != doc:
                for tokens in waiting:
                    automaton.add(tokens)
                    size += len(tokens)
                waiting, doc = [], d
                full = full or size - began > shard
            tokens = text.split(b" ")
            long = [i for i, n in enumerate(automaton.statistics(tokens)) if n >= window] if size else []
            at = 0
            while at < len(long):
                to = at
                while to + 1 < len(long) and long[to + 1] - long[to] <= window:
                    to += 1
                first = long[at] - window + 1
                out.append((d, tk, start + first, long[to] + 1 - first, None))
                at = to + 1
            if len(long) < len(tokens) - window + 1:
                if full:
                    at = window - 1
                    for end in [*long, len(tokens)]:  # stretches of the windows that the automaton hasn't
                        if end > at:
                            out.append((d, tk, start + at - window + 1, end - at, b" ".join(tokens[at - window + 1 : end])))
                        at = end + 1
                else:
                    waiting.append(tokens)
        if out:
            *spans, words = zip(*out, strict=True)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in spans), pa.array(words, pa.binary())], names=["doc", "text_key", "start", "length", "words"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(w, doc, text_key, start): a digest of each window of pieces (doc, text_key, start, words)."""
    for b in batches:
        rows: list[tuple] = []
        for doc, tk, start, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            ws = text.split(b" ")
            rows += [(hashlib.md5(b" ".join(ws[i : i + window])).digest(), doc, tk, start + i) for i in range(len(ws) - window + 1)]
        if rows:
            w, *rest = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(w, pa.binary()), *(pa.array(c, pa.int64()) for c in rest)], names=["w", "doc", "text_key", "start"])


def _later(pieces: DataFrame, window: int) -> DataFrame:
    """Spans (doc, text_key, start, length) of the windows of pieces (doc, text_key, start, words) that a smaller doc of them has."""
    each = pieces.mapInArrow(partial(_windows, window=window), "w binary, doc long, text_key long, start long")
    least = each.groupBy("w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("most > least").select("w", "least")
    return each.join(least, "w").filter("doc > least").select("doc", "text_key", "start", F.lit(window).cast("long").alias("length"))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, kept = [], [], []
        for text, copy, spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
            ws = text.as_py().split()
            keep = np.ones(len(ws), bool)
            if copy and len(ws) >= window:
                keep[:] = False
            elif spans.is_valid:
                for s in spans.as_py():
                    keep[s["start"] : s["start"] + s["length"]] = False
            n.append(len(ws))
            removed.append(len(ws) - int(keep.sum()))
            kept.append(b" ".join(ws if keep.all() else [ws[i] for i in np.flatnonzero(keep).tolist()]))
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, joined by a blank, as UTF-8 bytes).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id. Texts that are
    equal have one reference, the one with the smallest id, and the others go whole. Each window's minimizer is a key that
    windows of the same words share; keys that several references have tell the passages that can repeat. Those are dealt
    by key, so the reference passages of a key and all passages to match meet in one task, in order of id: an automaton
    of the passages of smaller ids gives their matching statistics, and spans of ``window`` and more go. Of a key with more
    than ``shard_tokens`` of them, the rest are compared with each other by digests of their windows.

    Null and empty texts have no words; very long texts are read whole. A null id comes after all others, and null ids don't
    remove each other's words; the id 2^63 - 1 stands for null and comes back as null.
    Rows that repeat an id aren't smaller than each other; each gives a row. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    base = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    # the texts are dealt by row key once; the three joins below reuse that exchange
    rows, by = base.select("doc", "text_key", F.encode("text", "UTF-8").alias("text")), ["doc", "text_key"]
    marks = base.select("doc", "text_key", F.xxhash64(F.lit(1), "text").alias("text_key2"))
    owners = marks.groupBy("text_key", "text_key2").agg(F.min("doc").alias("owner"))
    status = cut(marks.distinct().join(owners, ["text_key", "text_key2"]).select("doc", "text_key", (F.col("doc") != F.col("owner")).alias("copy")))
    owned = status.filter("not copy").select(*by)
    references = rows.join(owned.hint("shuffle_hash"), by).select("doc", "text")
    keyed = references.mapInArrow(partial(_emit, window=window), "key long, doc long")
    shared = keyed.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_shared, "key long, doc long")
    wanted = owned.join(shared.groupBy("doc").agg(F.collect_list("key").alias("keys")), "doc")
    sources = rows.join(wanted.hint("shuffle_hash"), by).select("doc", "text_key", "text", "keys")
    pieces = sources.mapInArrow(partial(_pieces, window=window), "key long, doc long, text_key long, start int, words binary")
    spans = pieces.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(partial(_match, window=window, shard=shard_tokens), "doc long, text_key long, start long, length long, words binary")
    spans = cut(spans)
    many, spans = spans.filter("words is not null").select("doc", "text_key", "start", "words"), spans.filter("words is null").drop("words")
    if not many.isEmpty():
        spans = spans.unionByName(_later(many, window))
    found = status.join(spans.groupBy(*by).agg(F.collect_list(F.struct("start", "length")).alias("spans")), by, "left")
    doc_id = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    verdict = rows.join(found.hint("shuffle_hash"), by).select(doc_id, "text", "copy", "spans")
    return verdict.mapInArrow(partial(_cut, window=window), "doc_id long, n_words long, n_removed long, kept binary")
