"""Rows that share an ordinal are taken in the order of the table, as DuckDB takes them with one thread."""

import datetime
import random

import duckdb

from helixframe.plans import registry

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def table(spark, path):
    rng, rows, day = random.Random(3), [], datetime.datetime(1995, 1, 1)
    for k in range(40):
        part, supp = 1000 + rng.randrange(500), 2000 + rng.randrange(500)
        rows += [(k, part + 7 * i, supp - 31 * i, 1 + k % 3, float(1 + rng.randrange(50)), 100.0, 0.0, 0.0, "N", "O", day) for i in range(4)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return len({r[0] for r in rows}), len(rows)


def test_mapping_qualities_of_tied_reads(spark, tmp_path):
    ties, n = table(spark, tmp_path)
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(duck.sql(f"select rname, pos0, depth, mapqs from ({registry.oracle_sql()['a12_pileup']})").fetchall())
    got = registry.queries()["a12_pileup"](spark, str(tmp_path)).select("rname", "pos0", "depth", "mapqs").collect()
    assert sorted(map(tuple, got)) == want and ties < n and max(len(x[3]) for x in want) > 2


def test_mates_of_tied_rows_are_the_same_each_time(spark, tmp_path):
    table(spark, tmp_path)
    run = lambda: sorted(map(tuple, registry.queries()["j10_fix_mates"](spark, str(tmp_path)).collect()))
    once = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run() == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = registry.queries()["j10_fix_mates"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "place" in plan
