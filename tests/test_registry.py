"""Registered queries against DuckDB on the smallest tables."""

import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from compare import connect, difference  # noqa: E402

from cyclelake.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# All queries with SQL, but for nine that read the same facts as d2 and d12 and build them anew each time;
# tools/compare.py runs those as well.
CHECKED = sorted(n for n in registry.oracle_sql() if n.split("_")[0] not in {f"d{i}" for i in range(3, 12)})


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not present")
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(sql) >= 150


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = pd.DataFrame([r.asDict(recursive=True) for r in df.collect()], columns=df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    want = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description])
    assert difference(got, want) is None
