import zlib
from collections import Counter

import numpy as np
import pytest
from tables import awkward_texts, documents, prose, write

from cyclelake.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    out = sharding.permute(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 100 or (out != np.arange(n)).mean() > 0.9


def test_query_follows_the_law(spark, tmp_path):
    rows = documents(spark, [prose(i, 5) for i in range(200)] + awkward_texts(), tmp_path)
    found = queries.op3_feistel_shards(spark, str(tmp_path)).collect()
    octets = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len(octets(r[1])) + 8, zlib.crc32(octets(r[1]))) for r in rows)
    slots = {}
    for r in found:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # row numbers follow (key, crc32, size), nulls first, and the shard follows from the row number alone
    ordered = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.row_number))
    assert [r.row_number for r in ordered] == list(range(len(rows)))
    positions = sharding.permute(np.arange(len(rows)), len(rows), 42)
    assert all((r.position, r.shard, r.slot) == (p, p % 24, p // 24) for r, p in zip(ordered, positions.tolist(), strict=True))


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, prose(i, 3)) for i in range(300)], "doc_id long, text string")
    one = sharding.shuffle_shards(docs.coalesce(1), 5).collect()
    many = sharding.shuffle_shards(docs.repartition(7), 5).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in one} == {(r.doc_id, r.shard, r.slot) for r in many}


def test_empty_table_and_written_shards(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op3_feistel_shards(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(i, prose(i, 3)) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.shuffle_shards(docs, 4, carry=["text"]), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and set(back.select("doc_id", "text").collect()) == set(docs.collect())
