import random
import time

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import periodic_runs as P

DOCS = "doc_id long, text string, runs string, n_words int"


def brute(ws):
    """Every run by its definition: (start, length, period), by start, then period."""
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(ws[k] == ws[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_of(rng, k):
    ws = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
            ws += (unit * 10)[: rng.randint(1, len(unit) * 9)]
        else:
            ws += [rng.randrange(k) for _ in range(rng.randint(0, 20))]
    return [b"w%d" % w for w in ws]


def triples(rows):
    return [(r["start"], r["length"], r["period"]) for r in rows]


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    for _ in range(150):
        docs = [text_of(rng, rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(1, 6))]
        got = P._batch(list(range(len(docs))), docs)
        for ws, runs, kept in zip(docs, got.column(2).to_pylist(), got.column(3).to_pylist(), strict=True):
            want = brute(ws)
            assert triples(runs) == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert kept.encode() == b" ".join(w for i, w in enumerate(ws) if i not in gone)


def test_a_grammar_gives_its_text_back():
    rng = random.Random(6)
    docs = [text_of(rng, 3) for _ in range(40)]
    sizes = [len(d) for d in docs]
    w, doc = np.concatenate([np.array([int(x[1:]) + 10 * k for x in d], np.int64) for k, d in enumerate(docs)]), np.repeat(np.arange(len(docs)), sizes)
    starts = set()
    for at, rule in P.grammar(w, doc):
        assert (at[0] < at[1]).all() and (at[1] < at[2]).all() and (doc[at[0]] == doc[at[2] - 1]).all()
        for r in range(int(rule.max()) + 1):
            own = at[:, rule == r]
            first = w[own[0, 0] : own[2, 0]]
            assert all((w[a:z] == first).all() and m - a == own[1, 0] - own[0, 0] for a, m, z in own.T.tolist())
        starts |= set(zip(at[0].tolist(), at[2].tolist(), strict=True))
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    assert {(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True) if z - a > 1} <= starts


def test_rows_of_every_kind(spark):
    same = "a b " * 4
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, same), (4, same), (None, same), (5, "x y " * 6), (6, "\x1c \x1c \x1c \x1c \x1c \x1c")]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)
    out = {(r["doc_id"], r["n_words"]): (triples(r["runs"]), r["collapsed"]) for r in P.periodic_runs(df).collect()}
    assert P.periodic_runs(df).count() == len(rows)
    assert out[1, 0] == out[2, 0] == out[3, 0] == ([], "")
    assert out[4, 8] == out[None, 8] == ([(0, 8, 2)], "a b")
    assert out[5, 6] == ([(0, 6, 1)], "x y") and out[6, 6] == ([(0, 6, 1)], "\x1c")
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion():
    rng = random.Random(7)
    unit = [b"u%d" % i for i in range(50_000)]

    def long(n):
        return [[b"a"] * n, (unit * (n // len(unit) + 1))[:n], [rng.choice([b"the", b"of", b"x%d" % rng.randrange(n)]) for _ in range(n)]]

    spent = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        got = [P._batch([0], [ws]) for ws in long(n)]
        spent.append(time.perf_counter() - began)
    assert triples(got[0].column(2).to_pylist()[0]) == [(0, 400_000, 1)] and triples(got[1].column(2).to_pylist()[0]) == [(0, 400_000, 50_000)]
    assert spent[1] < 12 * spent[0] + 1


def test_a_lying_hash_is_found_out(monkeypatch):
    real, calls = P._Places.same, []

    def lying(self, a, q, n):
        calls.append(self.seed)
        return np.ones(len(a), bool) if self.seed == 0 else real(self, a, q, n)

    init = P._Places.__init__
    monkeypatch.setattr(P._Places, "__init__", lambda self, w, seed: (setattr(self, "seed", seed), init(self, w, seed))[1])
    monkeypatch.setattr(P._Places, "same", lying)
    monkeypatch.setattr(P, "_primitive", lambda places, found: found)
    ws = [b"a", b"b", b"c"] * 5 + [b"x", b"a", b"b"]
    assert triples(P._batch([0], [ws]).column(2).to_pylist()[0])[0] == (0, 15, 3) and max(calls) >= 1


def test_planted_documents(spark):
    import zlib

    hot = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    cold = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(hot, text, "", 0), (cold, text, "", 0)], DOCS)
    out = {r["doc_id"]: r for r in P.periodic_runs(df, plant=True).collect()}
    g = zlib.crc32(str(hot).encode()) // 10
    a, p = g % 80, 1 + (80 - g % 80) // (3 + g % 8)
    want = [f"w{i}" if i < a else f"w{a + (i - a) % p}" for i in range(80)]
    assert triples(out[hot]["runs"]) == brute(want) and out[cold]["collapsed"] == text
    plan = P.periodic_runs(df.select(F.col("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
