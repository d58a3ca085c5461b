"""Periodic runs of words, found on a Re-Pair grammar of each document."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, mixed

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Documents are worked on side by side up to so many words; a longer one is alone.
BATCH_WORDS = 250_000
#: Candidate (boundary, period) pairs that are looked at in one step.
STEP = 1 << 20
_PRIMES, _BASES = (2147483647, 2147483629), (911382323, 972663749)


class _Places:
    """Compares stretches of a sequence by prefix sums of their polynomial hashes, modulo two primes."""

    def __init__(self, w: np.ndarray, seed: int):
        self.sums, self.powers = [], []
        for p, base in zip(_PRIMES, _BASES, strict=True):
            power, m = np.ones(len(w) + 1, np.uint64), 1
            base = (base + 7919 * seed) % p
            while m <= len(w):
                more = min(m, len(w) + 1 - m)
                power[m : m + more] = power[:more] * np.uint64(pow(base, m, p)) % np.uint64(p)
                m *= 2
            total = np.zeros(len(w) + 1, np.uint64)
            total[1:] = np.cumsum((w.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(p)) % np.uint64(p)
            self.sums.append(total)
            self.powers.append(power)

    def same(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` are those from ``a + q``."""
        out = np.ones(len(a), bool)
        for p, total, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(p)
            near, far = (total[a + n] + p - total[a]) % p, (total[a + q + n] + p - total[a + q]) % p
            out &= near * power[q] % p == far
        return out

    def alike(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words, up to ``most``, from ``a`` on (or, ``back``, up to ``a``) are those ``q`` further."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            yes = self.same(a - mid if back else a, q, mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low


def _replaced(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs that one round replaces, and each one's key: repeated pairs that are more frequent than those they overlap with.

    Pairs of equal frequency are ranked by a hash, so that a long stretch of them is replaced in many places at once.
    """
    inside = doc[:-1] == doc[1:]
    key = np.where(inside, sym[:-1] << 32 | sym[1:], -1)
    kinds, which, n = np.unique(key, return_inverse=True, return_counts=True)
    n[kinds < 0] = 0
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((mixed(kinds), n))] = np.arange(1, len(kinds) + 1)
    rank[n < 2] = 0
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.arange(len(key))
    odd = (at - np.maximum.accumulate(np.where(first, at, 0))) & 1
    prior = np.where(odd == 1, 0, rank[which])
    beside = np.concatenate(([0], prior, [0]))
    won = np.flatnonzero((prior > beside[:-2]) & (prior > beside[2:]))
    return won, key[won]


def grammar(w: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A Re-Pair grammar of every document, the symbols of ``w`` being numbered apart for each.

    One item a round: the places of its rules as rows (start, boundary, end), and the number of each one's rule. A round
    replaces repeated pairs, the most frequent of those that overlap; documents without a repeated pair left leave the
    rounds, and what is left of them is paired neighbour by neighbour up to a start symbol, so that all rules are binary.
    """
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    pos, sym, doc = np.arange(len(w)), w.astype(np.int64), doc
    end = pos + 1
    fresh, done = int(sym.max(initial=-1)) + 1, []
    while len(sym) > 1:
        won, key = _replaced(sym, doc)
        if not len(won):
            break
        busy = np.zeros(int(doc[-1]) + 1, bool)
        busy[doc[won]] = True
        kinds, rule = np.unique(key, return_inverse=True)
        rounds.append((np.stack((pos[won], pos[won + 1], end[won + 1])), rule))
        sym[won], end[won] = fresh + rule, end[won + 1]
        fresh += len(kinds)
        stay = np.ones(len(sym), bool)
        stay[won + 1] = False
        on = busy[doc]
        done.append((pos[stay & ~on], end[stay & ~on], doc[stay & ~on]))
        pos, end, doc, sym = (x[stay & on] for x in (pos, end, doc, sym))
    done.append((pos, end, doc))
    pos, end, doc = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(pos, kind="stable")
    pos, end, doc = pos[order], end[order], doc[order]
    while len(pos):
        at = np.arange(len(doc))
        nth = at - np.maximum.accumulate(np.where(np.concatenate(([True], doc[1:] != doc[:-1])), at, 0))
        left = np.flatnonzero((nth[:-1] & 1 == 0) & (doc[:-1] == doc[1:]))
        if not len(left):
            break
        rounds.append((np.stack((pos[left], pos[left + 1], end[left + 1])), np.arange(len(left))))
        end[left] = end[left + 1]
        stay = np.ones(len(pos), bool)
        stay[left + 1] = False
        pos, end, doc = pos[stay], end[stay], doc[stay]
    return rounds


def _crossing(w: np.ndarray, places: _Places, at: np.ndarray, side: int) -> np.ndarray:
    """Periodic stretches (rule, start, end, period) across the boundaries of rules, of which half at least is on one side of it.

    ``at`` are rows (start, boundary, end). A stretch of LEAST_PERIODS periods has half of them after the boundary or before
    it, where words repeat one period further.
    """
    lo, b, hi = at
    room = hi - b if side else b - lo
    most = np.where(room >= (LEAST_WORDS + 1) // 2, room * 2 // LEAST_PERIODS, 0)
    ends = np.cumsum(most)
    out, done = [], 0
    while done < len(most):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STEP, "right")))
        n = most[done:upto]
        base = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        rule = np.repeat(np.arange(done, upto), n)
        q = np.arange(len(base)) - base + 1
        near = b[rule] if side else b[rule] - 1
        way = 1 if side else -1
        hit = w[near + way * q] == w[near]
        for j in (1, 2):  # the words behind it, as far as the period is sure to have them
            rule, q, near = rule[hit], q[hit], near[hit]
            hit = (q < 3) & (j == 2)
            tried = np.flatnonzero(~hit)
            hit[tried] = w[near[tried] + way * (q[tried] + j)] == w[near[tried] + way * j]
        rule, q = rule[hit], q[hit]
        if len(q):
            middle, start, end = b[rule], lo[rule], hi[rule]
            left = middle if side else middle - q
            right = places.alike(left, q, end - q - left)
            before = places.alike(left, q, left - start, back=True)
            s, e = left - before, left + q + right
            ok = (s < middle) & (middle < e) & (e - s >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            out.append(np.stack((rule[ok], s[ok], e[ok], q[ok])))
        done = upto
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)


def _primitive(places: _Places, found: np.ndarray) -> np.ndarray:
    """The stretches whose period is their smallest: none of its parts by a prime is a period."""
    found = found[:, np.lexsort(found[[3, 2, 1, 0]])]
    found = found[:, np.concatenate(([True], (found[:3, 1:] != found[:3, :-1]).any(axis=0)))]  # of one stretch's periods the smallest
    _, s, e, q = found
    own, rest, p = np.ones(len(q), bool), q.copy(), 2

    def drop(by: np.ndarray, part: np.ndarray) -> None:
        own[by] &= ~places.same(s[by], part, e[by] - s[by] - part)

    while p * p <= rest.max():
        by = np.flatnonzero(rest % p == 0)
        if len(by):
            drop(by, q[by] // p)
            while len(by):
                rest[by] //= p
                by = by[rest[by] % p == 0]
        p += 1
    by = np.flatnonzero(rest > 1)
    drop(by, q[by] // rest[by])
    return found[:, own]


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches: those of one period that share a period's words are one."""
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    level = np.cumsum(np.concatenate(([0], q[1:] != q[:-1]))) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + level)
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] + level[1:] + q[1:] > reach[:-1])))
    head = np.flatnonzero(new)
    return s[head], np.maximum.reduceat(e, head), q[head]


def runs(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """All runs of documents' words as rows (start, end, period), in places of ``w``, by start, then period.

    ``w`` numbers the words of each document apart, ``doc`` the documents, ascending.
    """
    if not len(w):
        return np.zeros((3, 0), np.int64)
    rounds, seed = grammar(w, doc), 0
    edge = np.concatenate(([True], doc[1:] != doc[:-1], [True]))
    while True:
        places, parts = _Places(w, seed), []
        for at, rule in rounds:
            _, first = np.unique(rule, return_index=True)
            once = at[:, first]
            long = np.flatnonzero(once[2] - once[0] >= LEAST_WORDS)
            found = np.concatenate([_crossing(w, places, once[:, long], side) for side in (1, 0)], axis=1)
            if not found.shape[1]:
                continue
            found = _primitive(places, found)
            of, s, e, q = found[:, np.lexsort(found)]
            of = long[of]
            #: each place of a rule gets the rule's stretches
            order = np.argsort(rule, kind="stable")
            begin, stop = np.searchsorted(rule[order], of), np.searchsorted(rule[order], of, "right")
            n = stop - begin
            which = np.repeat(np.arange(len(of)), n)
            place = order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]]
            moved = at[0, place] - once[0, of[which]]
            parts.append(np.stack((s[which] + moved, e[which] + moved, q[which])))
        if not parts:
            return np.zeros((3, 0), np.int64)
        s, e, q = _merged(*np.concatenate(parts, axis=1))
        if all(
            np.array_equal(w[a : z - p], w[a + p : z]) and (edge[a] or w[a - 1] != w[a - 1 + p]) and (edge[z] or w[z] != w[z - p])
            for a, z, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)
        ):
            return np.stack((s, e, q))[:, np.lexsort((q, s))]
        seed += 1  # two stretches with one hash: compare all again by others


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's places of the words that stand in a document of ``n`` words: one in ten repeats a stretch up to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    """The result's rows of some documents."""
    fresh, coded = count(), []
    for ws in texts:
        number = defaultdict(fresh.__next__)
        coded.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
    sizes = np.array([len(ws) for ws in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    s, e, q = runs(np.concatenate(coded), np.repeat(np.arange(len(texts)), sizes))
    cuts = np.searchsorted(s, starts)
    told, kept = [], []
    for k, ws in enumerate(texts):
        own = slice(cuts[k], cuts[k + 1])
        triples = list(zip((s[own] - starts[k]).tolist(), (e[own] - starts[k]).tolist(), q[own].tolist(), strict=True))
        told.append([{"start": a, "length": z - a, "period": p} for a, z, p in triples])
        if triples:
            stays = np.ones(len(ws), bool)
            for a, z, p in triples:
                stays[a + p : z] = False
            ws = [ws[i] for i in np.flatnonzero(stays)]
        kept.append(b" ".join(ws))
    text = pa.array(kept, pa.binary()).cast(pa.string(), safe=False)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(told, _RUNS), text], names=["doc_id", "n_words", "runs", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    held("periodic_runs", None, dict)
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ws = t.as_py().split()
            if plant and (at := planted(len(ws), i)) is not None:
                ws = [ws[k] for k in at.tolist()]
            if texts and size + len(ws) > BATCH_WORDS:
                yield _batch(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(ws)
            size += len(ws)
    if texts:
        yield _batch(ids, texts)


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are what blanks (space, 0x09 to 0x0D) divide. A run is a stretch of LEAST_WORDS words and LEAST_PERIODS of its
    smallest period at least, which no neighbouring word extends. ``collapsed`` are the words that no run holds behind its
    first period, joined by blanks. ``plant`` repeats stretches of one in ten documents first, as ``planted`` tells.

    Each document gets a Re-Pair grammar of its words; the stretches across a rule's boundary are sought once and told for
    all its places. Time is in proportion to n log n, memory to the longest document. Null and empty texts have no words and
    no runs; null ids plant nothing; repeated rows give a row each; an empty table gives no rows; other columns, whatever
    their names, are ignored. Nothing is shuffled.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.encode("text", "UTF-8"))
    return rows.mapInArrow(partial(_find, plant=plant), _OUT)

