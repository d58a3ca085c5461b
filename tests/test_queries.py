"""Every registered query against its SQL on the smallest tables."""

import collections
import os

import duckdb
import pytest

from helixframe.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = collections.Counter(str(tuple(map(plain, r))) for r in df.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    want = collections.Counter(str(tuple(map(plain, x))) for x in r.select(*(f'"{c}"' for c in cols)).fetchall())
    assert rows == want


def test_workers_get_the_package(tmp_path):
    """Python functions run in a session whose workers don't know the package's folder."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from helixframe.session import local_session
s = local_session(2, 2)
assert e.queries()["w05_collapse_wig"](s, {DIR!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=240)
