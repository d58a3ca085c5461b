import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, quality_score string, quality int"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed=1):
    """Good texts are sentences of common words; bad ones shout, with marks behind each word."""
    rng = random.Random(seed)
    words = ["stone", "river", "house", "green", "walks", "under", "light", "seven", "paper", "table", "quiet", "morning"]
    out = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        good = rng.random() < 0.7
        out.append((i, " ".join(ws) + "." if good else "".join(w.upper() + rng.choice(["!! ", "$$ ", "## "]) for w in ws), int(good)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 9) for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q, 0, "clash") for i, _, q in rows], LABELS)


def test_held_out_documents_of_the_table(spark):
    out = queries.op13_quality_classifier(spark, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    tested = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([(s >= 0.7) == q for s, q in tested]) >= 0.93
    good, bad = (np.array([s for s, q in tested if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert abs(np.mean([s - q for s, q in tested])) < 0.06  # calibrated on the whole


def test_scores_are_the_models(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"), 4, 2)))
    c = quality.Compressors(*model.dictionaries)
    for i, t, _ in rows[:50]:
        b = t.encode()
        x, tells = c.difference(b), len(b) / (len(b) + quality.HALF_BYTES)
        assert out[i]["quality_score"] == pytest.approx(1 / (1 + np.exp(-(model.weights @ [1, tells, tells * x]))))
    held = [(out[i]["quality_predicted"], q) for i, _, q in rows if out[i]["in_held_out"]]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) > 0.97


def test_held_out_labels_and_the_order_of_rows_change_nothing(spark):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    want = {r["doc_id"]: r["quality_score"] for r in quality.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.orderBy(F.desc("doc_id")).repartition(3), flipped.orderBy(F.desc("doc_id")).unionByName(labels.limit(5)))
    assert {r["doc_id"]: r["quality_score"] for r in again.collect()} == want


def test_rows_of_every_kind(spark):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    odd = [(500, None), (501, ""), (None, rows[3][1]), (3, rows[3][1]), (502, rows[3][1] * 3000)]
    more = docs.unionByName(spark.createDataFrame([(i, t, "", 0) for i, t in odd], DOCS))
    told = labels.unionByName(spark.createDataFrame([(None, 1, 0, ""), (501, None, 0, ""), (7, 5, 0, ""), (999, 1, 0, "")], LABELS))
    out = quality.classify(more, told)
    assert set(out.columns) == {*docs.columns, "quality_predicted", "in_held_out"}
    got = [(r["doc_id"], r["text"], r["quality_score"]) for r in out.collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for *_, s in got)
    of = lambda i: sorted({s for d, _, s in got if d == i})
    assert of(500) == of(501) and len(of(3)) == 1 and of(None) == of(3)
    assert (of(502)[0] >= 0.7) == bool(rows[3][2])
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_too_few_labels(spark):
    rows = corpus(30)
    docs, labels = frames(spark, rows)
    scores = lambda some: {r["quality_score"] for r in quality.classify(docs, some).collect()}
    assert scores(labels.limit(0)) == {0.5}
    one = scores(labels.filter("quality = 1"))
    assert len(one) == 1 and one.pop() > 0.9
    both = spark.createDataFrame([(1, 0, 0, ""), (1, 1, 0, "")], LABELS)
    assert scores(both) == {0.5}
    assert all(0 <= s <= 1 for s in scores(labels.filter("doc_id < 12")))


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "DICTIONARY_DOCS", 5)
    monkeypatch.setattr(quality, "CALIBRATION_DOCS", 4)
    seen = []
    real = quality.calibrated
    monkeypatch.setattr(quality, "calibrated", lambda x, size, label, weight: (seen.append((len(x), weight.sum())), real(x, size, label, weight))[1])
    docs, labels = frames(spark, corpus(300))
    assert quality.fit(docs, labels).dictionaries and seen[0][0] == 8 and seen[0][1] == pytest.approx(8)
