"""Verified near copies against all pairs of small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import near_copies as N
from helixframe.llm import simhash
from helixframe.llm.components import connected_components


def jaccard(a, b, width=5):
    s = [{tuple(x[i : i + width]) for i in range(len(x) - width + 1)} or {tuple(x)} for x in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, rng.randint(1, 1 + len(words) // 25))) for _ in range(rng.randint(0, 3))]
    return texts


def groups(spark, texts, **how):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string")
    roots = {r.node: r.root for r in connected_components(N.near_copy_links(df, **how)).collect()}
    return roots


def test_links_are_alike_and_few_are_missed(spark):
    texts = corpus(1, 150)
    roots = groups(spark, texts)
    pairs = [(jaccard(texts[i], texts[j]), i, j) for i in range(len(texts)) for j in range(i + 1, min(i + 5, len(texts)))]
    near = [(i, j) for s, i, j in pairs if s >= 0.8]
    together = sum(roots.get(i, i) == roots.get(j, -j - 1) for i, j in near)
    assert len(near) > 100 and together >= 0.98 * len(near)
    allowed = {k: {k} for k in range(len(texts))}
    for s, i, j in pairs:  # chains of links of 0.8 and more
        if s >= 0.8 - 1e-9:
            both = allowed[i] | allowed[j]
            for k in both:
                allowed[k] = both
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if roots.get(i, i) == roots.get(j, -j - 1):
                assert j in allowed[i]


def test_one_bucket_of_all_loses_no_link(spark, monkeypatch):
    own = N._signed

    def one_bucket(batches, width):
        for b in own(batches, width):
            for r in b.to_pylist():
                yield N.pa.RecordBatch.from_pylist([r | {"bands": [7]}], schema=b.schema)

    monkeypatch.setattr(N, "_signed", one_bucket)
    texts = corpus(4, 30)
    for side in (256, 8):
        monkeypatch.setattr(N, "SIDE", side)
        roots = groups(spark, texts)
        want = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if jaccard(texts[i], texts[j]) >= 0.8 - 1e-9:
                    want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
        told = [roots.get(i, i) for i in range(len(texts))]
        assert len(set(want)) < len(texts)
        assert all((told[i] == told[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_texts_of_every_kind(spark):
    rng = random.Random(2)
    long = " ".join(f"L{rng.randrange(9999)}" for _ in range(60_000))
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", long, long.upper() + " end", "a b c d e f", "a b c d e f"]
    roots = groups(spark, texts)
    assert set(roots) & set(range(len(texts))) == {3, 4, 6, 7, 8, 9}
    assert roots[3] == roots[4] and roots[6] == roots[7] and roots[8] == roots[9] and len({roots[3], roots[6], roots[8]}) == 3
    assert groups(spark, [None]) == {} and N.near_copy_links(spark.createDataFrame([], "node long, text string")).count() == 0


def test_crowds_of_copies_and_shuffled_sets(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARE", 7)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 3)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words)] * 50 + [" ".join(edited(rng, words, 1)) for _ in range(120)]
    roots = groups(spark, texts)
    assert len({roots.get(k) for k in range(len(texts))}) == 1 and None not in {roots.get(k) for k in range(len(texts))}


def test_sets_and_similarity():
    a = N.shingle_set(b"A b c d e f g", N._Hashes(), 5)
    assert len(a) == 3 and (a == N.shingle_set(b"a B\tc d e f g", N._Hashes(), 5)).all() and not len(N.shingle_set(b" ", N._Hashes(), 5))
    x, y = np.arange(0, 90, dtype=np.uint32), np.arange(10, 100, dtype=np.uint32)
    assert N.alike(x, y, 0.8) and not N.alike(x, y, 0.81) and not N.alike(x, x[:50], 0.8)


def test_one_of_each_keeps_one_of_near_copies(spark):
    texts = corpus(4, 60)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, node string, bands int")
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    only = {r.doc_id for r in simhash.one_of_each(df, similarity=None).collect()}
    assert kept <= only and {r.doc_id for r in simhash.simhash_groups(df).filter(F.col("doc_id") == F.col("component_id")).collect()} == only
    for j in range(len(texts)):
        near = [i for i in range(max(0, j - 4), j) if jaccard(texts[i], texts[j]) >= 0.8]
        far = all(jaccard(texts[i], texts[j]) < 0.3 for i in range(max(0, j - 4), min(j + 5, len(texts))) if i != j)
        assert not (near and j in kept) or sum(1 for _ in near) <= 1
        assert not far or j in kept
    lost = [j for j in range(len(texts)) if any(jaccard(texts[i], texts[j]) >= 0.8 for i in range(max(0, j - 4), j))]
    assert sum(j not in kept for j in lost) >= 0.97 * len(lost)
