"""The pipeline's stages, each against what its own input asks for."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import decontaminate, packing, simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = {"en": "the of and that with in to stone river garden walks over under between light".split(), "de": "der die das und mit auf ein stein fluss garten läuft über unter zwischen licht".split()}
    line = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(12, 30)))
    rows = [(i, "\n".join(line(lang) for _ in range(8)), lang, "s", 1) for i in range(80) for lang in [rng.choice(["en", "de"])]]
    item = " ".join(f"q{rng.randrange(99)}" for _ in range(20))
    long = "\n".join(line("en") for _ in range(60)).split("\n")
    rows += [(100, rows[3][1], rows[3][2], "s", 1), (101, "\n".join(x + " end" for x in long), "en", "s", 1), (102, "\n".join(x + " end" for x in long[:-1]) + "\nother last words in this one end", "en", "s", 1)]
    rows += [(103, f"the river and {item} in the garden\n" + line("en"), "en", "s", 1), (104, None, "en", "s", None), (105, "123 456", "en", "s", 7), (None, line("en") + " without an id", "en", "s", 1)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    kept = corpus_pipeline.language_id(spark, docs, tables).cache()
    assert ids(docs) - ids(kept) == {104, 105} and kept.columns == docs.columns
    lines = corpus_pipeline.dedup_lines(spark, kept, tables).cache()
    assert ids(lines) == ids(kept) and lines.columns == docs.columns
    text = {r.doc_id: r.text for r in lines.collect()}
    assert text[100] == "" and text[102] == "other last words in this one end"
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(kept).collect()}
    near = corpus_pipeline.near_dedup(spark, kept, tables)
    assert ids(near) <= {i for i in ids(kept) if i is None or groups[i] == i} and 100 not in ids(near) and 3 in ids(near)
    assert ids(kept) - ids(near) == {100, 102}  # 102 is 101 but for one line
    clean = corpus_pipeline.decontaminated(spark, kept, tables)
    assert ids(kept) - ids(clean) == {103} and None in ids(clean)
    packed = corpus_pipeline.pack(spark, kept, tables)
    assert ids(packed) == ids(kept) and packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_run_is_its_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, docs.select(*cols).collect()))


def test_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.contamination and packing.best_fit_pack


def test_rows_are_judged_and_not_ids(spark, tables):
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    a, b, c = ("the river and the stone walk under the old light of garden " + w for w in ("one two three", "and other words that differ from it by far more", "which is a third text about something else again"))
    schema = "doc_id long, text string, lang string, `row` long, best string, fp long, n_chars long"
    row = lambda i, t, x=0: (i, t, None, x, None, x, 1)
    rows = [row(3, a), row(7, a), row(7, b), row(9, c), row(9, c), row(9, c), row(None, a), row(11, None), row(None, ""), row(5, item), row(5, "clean words of the same id"), row(5, item)]
    df = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.near_dedup(spark, df, tables)
    assert near.columns == df.columns
    want = [row(3, a), row(7, b), row(9, c), row(11, None), row(5, item), row(5, "clean words of the same id")]
    assert sorted(map(str, near.collect())) == sorted(map(str, spark.createDataFrame(want, schema).collect()))
    clean = corpus_pipeline.decontaminated(spark, df, tables)
    assert sorted(map(str, clean.collect())) == sorted(map(str, spark.createDataFrame([r for r in rows if r[1] != item], schema).collect()))
    other = [row(2, a, 1), row(2, a, 2)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(other, schema), tables).collect()
    assert len(left) == 1 and left[0].doc_id == 2
    lines = corpus_pipeline.dedup_lines(spark, df, tables)
    assert lines.columns == df.columns and lines.count() == len(rows)
    told = corpus_pipeline.language_id(spark, df.withColumn("lang", F.lit("en")), tables)
    assert told.columns == df.columns and told.filter("text is null or text = ''").count() == 0
