"""Every registered query of the core against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from quadrat import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str, datetime.date)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    cur = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, cur.fetchall())


@pytest.mark.parametrize("name", ["fn11_design", "ml1_ols_cluster", "tx9_merge_hierarchies", "ml13_compare_networks"])
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_names_of_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.queries()) <= set(entry.queries())


def test_entry_module_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 200"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=300)
