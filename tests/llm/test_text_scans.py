import functools
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import automaton, decontaminate, langid, licenses, line_dedup, substring_dedup
from helixframe.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(t):
    return WORD.findall((t or "").translate(LOWER))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in rows], "doc_id long, text string, n_words int, key string, hits array<int>")


def brute_contamination(rows, items):
    wins = {}
    for item, t in items:
        ws = folded(t)
        for s in range(max(1, len(ws) - 12) if ws else 0):
            wins.setdefault(tuple(ws[s : s + 13]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        ws, hit, own = folded(t), set(), set()
        for m in {len(w) for w in wins}:
            for s in range(len(ws) - m + 1):
                if found := wins.get(tuple(ws[s : s + m])):
                    hit |= set(range(s, s + m))
                    own |= found
        out.append((str(i), len(ws), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out)


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["the", "Of", "É", "é", "rare1", "x2", "zeta", "ΑΣ"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([13, 14, 30, 5, 1, 20, 13])] + [(7, None), (8, "?!"), (None, "lonely item"), (9, "the the the the"), (0, "again the")]
    rows = [(100, None), (101, ""), (102, "...")]
    for i in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 80]))]
        t = items[rng.randrange(7)][1]
        if rng.random() < 0.7:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = t.split()[rng.randrange(2) :]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(ws)))
    rows += [rows[5], (rows[6][0], "another text lonely item"), (None, "the the the the the"), (200, "filler " * 400 + "lonely ITEM")]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, size int")

    def run(d, b):
        return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(d, b).collect())

    want = brute_contamination(rows, items)
    assert run(docs(spark, rows), bench) == want
    assert run(docs(spark, rows[:9]), bench.limit(0)) == brute_contamination(rows[:9], [])
    assert run(docs(spark, []), bench) == []
    blocks = decontaminate.contamination(docs(spark, rows), bench, block_windows=20).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in blocks) == want
    long = [(1, "of " * 60_000 + items[2][1] + " é" * 60_000)]
    assert run(docs(spark, long), bench.filter("item_id = 2")) == brute_contamination(long, items[2:3])


def test_contamination_runs_no_python(spark):
    plan = decontaminate.contamination(docs(spark, [(1, "a b")]), docs(spark, [(1, "a b")]).withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_automaton_statistics():
    rng = random.Random(8)
    for _ in range(60):
        own = automaton.SuffixAutomaton()
        added = []
        for _ in range(5):
            s = [rng.choice("ab") for _ in range(rng.randrange(9))]
            added.append("".join(s))
            own.add(s)
            text = "".join(rng.choice("abc") for _ in range(15))
            want = [max(n for n in range(i + 2) if n == 0 or any(text[i + 1 - n : i + 1] in a for a in added)) for i in range(len(text))]
            assert own.statistics(text) == want


def test_license_scan_against_brute_force(spark):
    base = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    rng = random.Random(2)
    bits = ["CC BY", "cc-by", "general PUBLIC license", "all rights", "All Rights\nReserved.", "reserved", "the", "É", "by", "word", "license version"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(150)] + [(500, None), (501, ""), (None, "cc by"), (3, "cc by")]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        ws = folded(t)
        want.append((str(i), len(ws), sorted((s, len(p), label) for p, label in base.items() for s in range(len(ws)) if tuple(ws[s : s + len(p)]) == p)))
    assert sorted((str(r.doc_id), r.n_words, sorted(tuple(p) for p in r.phrases)) for r in got) == sorted(want)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_license_templates_chain_over_changes(spark):
    mit = [w.decode() for w in licenses.words(licenses.MIT.encode())]
    rows = [
        (1, "Foo. " + licenses.MIT.upper() + " bar"), (2, " ".join(mit[:60] + ["also", "very"] + mit[60:90] + mit[91:])), (3, " ".join(mit[:10])), (4, "permission is granted to deal in the software"),
        (5, "Licensed under the Apache License, Version 2.0."), (6, "Licensed under CC BY-NC 4.0."), (7, " ".join(mit[:80] + mit[20:24] + mit[80:])), (8, f"{licenses.MIT}\n{licenses.MIT}"), (9, licenses.GPL), (10, "x " * 30_000 + licenses.ISC + " y" * 30_000),
    ]
    got = {r.doc_id: r.spans for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    labels = {i: {s["label"] for s in spans} for i, spans in got.items()}
    assert labels == {1: {"mit"}, 2: {"mit"}, 3: set(), 4: set(), 5: {"apache"}, 6: {"cc-by-nc"}, 7: {"mit"}, 8: {"mit"}, 9: {"gpl"}, 10: {"isc"}}
    whole = lambda i, n: [s for s in got[i] if s["end"] - s["start"] >= n]
    assert [(s["start"], s["end"], s["covered"]) for s in whole(1, len(mit))] == [(1, 1 + len(mit), 1.0)]
    assert [s["covered"] for s in whole(7, len(mit))] == [1.0] and len(whole(8, len(mit))) == 2 and whole(10, 50)[0]["start"] == 30_000
    assert licenses.LicenceScanner((), {"gpl": "x", "a b": "y"}).scan([b"foo", b"gpl", b"bar", b"a", b"b"])[0] == [(1, 1, "x"), (3, 2, "y")]


def brute_spans(ws, templates):
    """Spans from a table of common runs and all chains of maximal matches."""
    out = []
    for label, template in templates:
        n, m = len(ws), len(template)
        run = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                if ws[i] == template[j]:
                    run[i + 1][j + 1] = run[i][j] + 1
        longest = [max(r) for r in run]
        own = [(i - longest[i], i, j) for i in range(n + 1) if longest[i] >= licenses.MATCH_WORDS and (i == n or longest[i + 1] != longest[i] + 1) for j in range(m + 1) if run[i][j] == longest[i]]

        @functools.cache
        def best(x):
            tops = [(x[1] - x[0], x[0])]
            for y in own:
                new = x[1] - x[0] - max(0, y[1] - x[0], y[2] - (x[2] - (x[1] - x[0])))
                if y[1] < x[1] and y[2] < x[2] and x[0] - y[1] <= licenses.GAP_WORDS and new > 0:
                    tops.append((best(y)[0] + new, best(y)[1]))
            return max(tops)

        taken = []
        for c, s, e in sorted(((*best(x), x[1]) for x in own), key=lambda c: (-c[0], c[2] - c[1], c[1])):
            if c >= licenses.COVERED * m and all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out.append((c, s, e, label, c / m))
    return sorted(x[1:] for x in out if not any((y[0], y[4]) > (x[0], x[4]) and y[1] <= x[1] and x[2] <= y[2] for y in out))


def test_license_spans_against_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        vocab = [f"w{i}".encode() for i in range(rng.choice([3, 6, 20]))]
        templates = [(f"t{k}", b" ".join(rng.choice(vocab) for _ in range(rng.randrange(4, 16))).decode()) for k in range(4)]
        templates.append(("inner", " ".join(templates[0][1].split()[1:-1])))
        scanner = licenses.LicenceScanner(templates, {"w1": "one", "w1 w2": "two"})
        ws = []
        for _ in range(5):
            t = rng.choice(templates)[1].encode().split()
            at = rng.randrange(len(t))
            ws += rng.choice([t, t[:at] + [b"zz"] + t[at:], t[:at] + t[at + 1 :], t[:at] + t[max(0, at - 3) :], [rng.choice(vocab) for _ in range(6)], [b"y"] * 13])
        phrases, spans = scanner.scan(ws)
        assert sorted(spans) == brute_spans(ws, [(label, t.encode().split()) for label, t in templates])
        want = [(i, 1, "one") for i, w in enumerate(ws) if w == b"w1"] + [(i, 2, "two") for i in range(len(ws) - 1) if ws[i : i + 2] == [b"w1", b"w2"]]
        assert sorted(phrases) == sorted(want)


def brute_substrings(rows, window):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    last = 1 << 63
    least = {}
    for i, t in rows:
        ws = split(t)
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            least[k] = min(least.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        ws = split(t)
        gone = {x for s in range(len(ws) - window + 1) if least[tuple(ws[s : s + window])] < (last if i is None else i) for x in range(s, s + window)}
        out.append((str(i), len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [100_000, 40])
def test_substring_dedup_against_brute_force(spark, shard):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of\xa0", "É"]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "a " * 40), (904, "a " * 30 + "b"), (905, "a " * 13)]
    for i in range(120):
        ws = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 12, 13, 50]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            p = rng.choice(passages)
            ws[at:at] = p[: rng.choice([len(p), len(p) - 1])]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(300 + i, rows[20 + i % 7][1]) for i in range(20)] + [(None, rows[30][1]), (None, rows[31][1] + " tail"), rows[40], (rows[41][0], rows[50][1])]
    got = substring_dedup.substring_dedup(docs(spark, rows), shard_tokens=shard).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.h) for r in got) == brute_substrings(rows, 13)
    if shard == 40:
        assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def test_automaton_of_one_key_is_bounded(monkeypatch):
    import pyarrow as pa

    made = []

    class Counted(automaton.SuffixAutomaton):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(substring_dedup, "SuffixAutomaton", Counted)
    rows = [(7, i, i, 0, " ".join(f"w{i}.{k}" for k in range(22)).encode()) for i in range(2000)]
    out = list(substring_dedup._match(iter([substring_dedup._piece_batch(rows[i : i + 100]) for i in range(0, 2000, 100)]), 13, 1000))
    assert max(len(a.link) for a in made) < 3000
    assert sum(b.num_rows for b in out) > 1900 and isinstance(out[0], pa.RecordBatch)


def test_shared_keys_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key, doc = rng.integers(0, 40, 300), rng.integers(0, 6, 300)
    o = np.lexsort((doc, key))
    key, doc = key[o], doc[o]
    want = {(int(k), int(d)) for k, d in zip(key, doc, strict=True) if len(set(doc[key == k])) > 1}
    for size in (1, 2, 7, 300):
        batches = [pa.record_batch([pa.array(key[i : i + size]), pa.array(doc[i : i + size])], names=["key", "doc"]) for i in range(0, 300, size)]
        got = [(k, d) for b in substring_dedup._shared(iter(batches)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert set(got) == want
        firsts = {min(d for k2, d in want if k2 == k) for k, _ in want}
        assert firsts is not None and all(got.count((k, min(d for k2, d in want if k2 == k))) == 1 for k, _ in want)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_edit_distance():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(14)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("abé") for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
        b = "".join(b)
        for most in (0, 1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1), (a, b, most)


def brute_lines(rows, edits, least, near):
    each = [(i, n, x.strip(line_dedup.BLANKS)) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for _, _, x in each if len(x) >= least})
    group = {x: x for x in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, x in enumerate(texts):
        for y in texts[:k]:
            if min(len(x), len(y)) >= near and abs(len(x) - len(y)) <= edits and plain_distance(x, y) <= edits:
                group[find(x)] = find(y)
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, _, x in each:
        if len(x) >= least:
            first[find(x)] = min(first.get(find(x), (True, 1 << 60)), order(i))
    out = []
    for i, t in rows:
        lines, met, keep = (t or "").split("\n"), set(), []
        for x in lines:
            s = x.strip(line_dedup.BLANKS)
            if len(s) >= least:
                root = find(s)
                if first[root] != order(i) and first[root] < order(i) or root in met:
                    continue
                met.add(root)
            keep.append(x)
        out.append((str(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 1])
def test_line_dedup_against_brute_force(spark, least):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([1, 3, 7, 8, 9, 10, 11, 12, 30]))) for _ in range(25)]
    rows = [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 3000), (504, "x" * 3001), (505, "x" * 3003), (-(1 << 63), "Read more\nShare"), ((1 << 63) - 1, "Read more\nShare")]
    for i in range(70):
        lines = []
        for _ in range(rng.randrange(6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "q", "ü"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(x) + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines)))
    rows += [(None, rows[20][1]), (None, base[0] + "\n" + base[0]), rows[30], (rows[31][0], rows[32][1])]
    got = line_dedup.line_dedup(docs(spark, rows), edits=2, min_chars=least, near_chars=8).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in got) == brute_lines(rows, 2, least, 8)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_common_segments_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = "entry number {} of the book {}"
    rows = [(i, "\n".join(base.format(rng.randrange(40), rng.choice(["a", "bc", "xyz", "wxyz", "vwxyz"])) for _ in range(3))) for i in range(60)]
    rows += [(100 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(8, 12)))) for i in range(60)]
    for hot, crowd in ((3, 128), (1024, 2), (1024, 128)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0 if crowd == 2 else 1_000_000)
        got = line_dedup.line_dedup(docs(spark, rows), edits=2, near_chars=8, hot=hot, crowd=crowd).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in got) == brute_lines(rows, 2, 1, 8)


def test_one_line_in_thousands_of_documents(spark):
    same = "a very common line that stands in each of them"
    rows = spark.range(3000, numPartitions=300).select(F.col("id").alias("doc_id"), F.concat(F.lit(same + "\nown "), F.md5(F.col("id").cast("string"))).alias("text"))
    got = line_dedup.line_dedup(rows).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: 1, 1: 2999}


def test_pairs_of_a_common_segment_stay_in_proportion():
    import numpy as np
    import pyarrow as pa

    n = 6000
    key, line = np.repeat(np.array([2, 3, 8]), n), np.tile(np.arange(n), 3)  # a key's own lines, its probes, and another key's
    batches = [pa.record_batch([pa.array(x[i : i + 1000]) for x in (key, line, np.zeros(3 * n, np.int64))], names=["key", "line", "sign"]) for i in range(0, 3 * n, 1000)]
    out = [b for b in line_dedup._candidates(iter(batches), 2)]
    assert sum(b.num_rows for b in out) <= 4 * n and {x for b in out for x in b.column(0).to_pylist()} == set(range(n))


def test_near_lines_of_a_segment_give_no_more_rows_than_lines(spark):
    import numpy as np
    import pyarrow as pa

    n = 700
    batch = pa.record_batch([pa.array(x) for x in (np.full(n, 9), np.arange(n), np.zeros(n, np.int64))], names=["key", "line", "sign"])
    out = [r for b in line_dedup._candidates(iter([batch]), 2) for r in b.to_pylist()]
    assert len(out) == n and {r["a"] for r in out} == set(range(n))
    rows = spark.createDataFrame([(i, f"the same long line with a number {i:03d} in it") for i in range(n)] + [(n, "another line that nothing is near to")], "doc_id long, text string")
    texts, links = line_dedup.near_lines(rows)
    roots = {r.root for r in connected_components(links).collect()}
    assert texts.count() == n and len(roots) == 1 and links.count() < 12 * n


def test_lines_side_by_side_against_brute_force():
    import pyarrow as pa

    rng = random.Random(3)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    own = [True] * 40 + [False] * 20
    rows = [pa.record_batch([pa.array([1] * 60), pa.array(own), pa.array(range(60)), pa.array(lines)], names=["pack", "own", "id", "line"]).slice(i, 7) for i in range(0, 60, 7)]
    for edits in (0, 1, 2):
        told = [(r["a"], r["b"]) for b in line_dedup._linked(iter(rows), edits) for r in b.to_pylist()]
        near = [(i, j) for j in range(60) for i in range(min(j, 40)) if line_dedup.edit_distance(lines[i], lines[j], edits) <= edits]
        assert set(told) <= set(near) and len(told) < 60
        parts = []
        for pairs in (told, near):
            root = list(range(60))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
            parts.append(root)
        assert parts[0] == parts[1]


def test_rewrite_keeps_rows_and_columns(spark):
    same = "a line that is long enough to compare"
    df = spark.createDataFrame([(2, same + "\nshort", 9, "s"), (1, same, 9, None), (None, None, 9, "t"), (3, "own text of another document", 9, "u")], "doc_id long, text string, n_chars long, `row` string")
    out = line_dedup.rewrite(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(2, "short", 5, "s"), (1, same, 9, None), (None, None, 9, "t"), (3, "own text of another document", 9, "u")], df.schema).collect()))


def test_language_id_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 + 34!", "en", "s", 0), (10**6 + 3, "Ωξψ ћђ ქართ " * 40, None, "s", 0), (None, "the and of", None, "s", 0), (5, "x", "en", "s", 0)], df.schema)
    got = langid.identify(df.unionByName(extra)).select("doc_id", "lang", "in_held_out", "lang_id.*").withColumnRenamed("lang", "lang").collect()
    assert len(got) == df.count() + 6
    odd = {r[0]: r for r in got if r[0] is None or r[0] >= 10**6}
    assert [odd[k][3] for k in (10**6, 10**6 + 1, 10**6 + 2)] == ["und"] * 3 and odd[None][3] == "en"
    assert odd[10**6 + 3][5] and not odd[None][5]
    held = [r for r in got if r[2] and r[0] < 10**6]
    assert 100 < len(held) < 300
    assert sum(r[1] == r[3] for r in held) / len(held) > 0.97
    assert sum(r[5] for r in got) <= 8 and all(0 <= r[4] <= 1 for r in got)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r[0] for r in langid.identify(df.limit(3).withColumn("lang", F.lit(None).cast("string"))).select("lang_id.lang").collect()} == {"und"}


def brute_prediction(model, text):
    """The nearest centroid by plain loops."""
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    counts = langid.ngram_counts(text)
    v = [math.log1p(int(c)) * float(i) for c, i in zip(counts, model.idf, strict=True)]
    size = math.sqrt(sum(x * x for x in v))
    cosines = [sum(x * float(y) for x, y in zip(v, row, strict=True)) / size for row in model.centroids]
    return model.languages[max(range(len(cosines)), key=cosines.__getitem__)]


def test_language_id_rejects_what_it_has_not_learned(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(df)
    rng = random.Random(4)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 2,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 2,
        *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20)),
    ]
    assert all(model.predict(other)[2])
    clean = [r.text for r in df.filter("lang is not null and text is not null").limit(40).collect()]
    names, scores, rejected = model.predict([*clean, None, "12", "x " * 50_000])
    assert names[:40] == [brute_prediction(model, t) for t in clean] and sum(rejected[:40]) == 0 and names[40:42] == ["und", "und"] and all(0 <= x <= 1 for x in scores)
    odd = df.select("doc_id", "text", "lang", F.lit(1).alias("lang_id"), F.lit(2).alias("rank"), F.lit(3).alias("counts"))
    same = odd.filter("doc_id = 3")
    many = odd.unionByName(same).unionByName(same)
    out = langid.identify(many)
    assert out.count() == many.count() and {"rank", "counts", "lang_id", "in_held_out"} <= set(out.columns)
    tied = langid.fit(spark.createDataFrame([(1, "de", "ein wort"), (1, "en", "ein wort"), (1, "en", "ein wort")], "doc_id long, lang string, text string"))
    assert tied.predict(["ein wort"])[0] == ["de"]


def test_license_spans_inside_others():
    """Of random spans those stay that no span of more words, or as many and more of its template, holds."""
    rng = random.Random(11)
    for _ in range(300):
        spans = []
        for _ in range(rng.randint(0, 12)):
            start = rng.randint(0, 12)
            spans.append((rng.randint(1, 4), start, start + rng.randint(1, 8), rng.choice("ab"), rng.choice([0.8, 0.9, 1.0])))
        want = sorted(s[1:] for s in spans if not any((t[0], t[4]) > (s[0], s[4]) and t[1] <= s[1] and s[2] <= t[2] for t in spans))
        assert sorted(licenses._outermost(spans)) == want


def test_license_scan_takes_time_in_proportion():
    import time

    scanner = licenses.LicenceScanner()
    notice = licenses.words(b"licensed under the mit license and so on ")
    spent = []
    for n in (4_000, 16_000, 64_000):
        began = time.perf_counter()
        found = scanner.scan(notice * n)
        spent.append(time.perf_counter() - began)
        assert len(found[1]) == n
    assert spent[2] < 8 * spent[1] + 0.5 and spent[1] < 8 * spent[0] + 0.5
