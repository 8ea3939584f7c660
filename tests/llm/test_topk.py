import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tables import write

from cyclelake.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row long, score long"


def vectors():
    r = random.Random(6)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.random()]) for _ in range(8)], 0, 1, 2, 3) for i in range(700)]
    rows += [rows[100], rows[100], rows[5], (700, None, 0, 1, 2, 3), (800, [1.0, None], 0, 1, 2, 3), (900, [math.nan] * 8, 0, 1, 2, 3)]
    return [*rows, (1000, [math.inf] * 8, 0, 1, 2, 3), (None, [1.0] * 8, 0, 1, 2, 3)]


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (i, q) in enumerate(usable):
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for other, (j, v) in enumerate(usable) if other != at)
            out.update((i, n, j, -s) for n, (s, j) in enumerate(found[:k], 1))
    return out


def single(x):
    """Components as the float column holds them."""
    import struct

    return x if x is None or not math.isfinite(x) else struct.unpack("f", struct.pack("f", x))[0]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = [(i, v and [single(x) for x in v], *rest) for i, v, *rest in vectors()]
    write(spark, rows, SCHEMA, tmp_path, "embeddings")
    found = Counter(map(tuple, queries.op9_exact_topk(spark, str(tmp_path)).collect()))
    assert found == brute(rows)
    with duckdb.connect() as connection:
        connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert Counter(connection.sql(queries.OP9_SQL).fetchall()) == found


@pytest.mark.parametrize(("block", "task_rows", "query_rows"), [(1, 7, 2), (64, 100, 3), (1000, 10_000, 1)])
def test_blocks_change_nothing(spark, block, task_rows, query_rows):
    rows = [(i, v and [single(x) for x in v], *rest) for i, v, *rest in vectors()][:300]
    df = spark.createDataFrame(rows, SCHEMA)
    found = topk.exact_topk(df, F.col("id") % 100 == 0, block=block, task_rows=task_rows, query_rows=query_rows)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_uneven_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0], 0, 0, 0, 0), (1, [3.0], 0, 0, 0, 0), (2, [], 0, 0, 0, 0), (3, [2.0**30, 2.0**30, 1.0], 0, 0, 0, 0), (100, [2.0**30, -(2.0**30)], 0, 0, 0, 0)]
    found = topk.exact_topk(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, k=3)
    limits = 2**63
    expected = Counter({(q, n, i, max(-limits, min(limits - 1, s))): c for (q, n, i, s), c in brute(rows, 3).items()})
    assert Counter(map(tuple, found.collect())) == expected


def test_empty_table(spark, tmp_path):
    write(spark, [], SCHEMA, tmp_path, "embeddings")
    assert queries.op9_exact_topk(spark, str(tmp_path)).collect() == []
