"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integer terms (dimension, value). Each task holds ranges of rows (document-range
blocks): a forward index of the block (rows by dimensions) and the maxima and minima of every term.
For a query the summed term maxima bound the score of any row in a block; blocks are visited in
falling order of that bound until it lies below the query's kth score. The kth score starts from
the best scores among the query block itself, whose rows are candidates like all others.

Queries are read in blocks of a fixed number of rows, so what is sent to the tasks is bounded; each
query block meets all rows. Every task returns its k best per query.

Defined results: vectors that are null, hold a null or a non-finite component, or have a null id
take no part; shorter vectors count as padded with zeros; an empty vector scores 0; rows that share
an id are rows of their own, and only the query's own row is left out; ties go to the smaller id. Scores
beyond 64 bits are clipped to the range of long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.llm.common import stored
from cyclelake.session import shared_folder

EXACT = 2.0**53  # products summed in doubles are exact integers below this


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part as (id, terms, row): floor(scale * component)."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    terms = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    kept = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(usable)
    rows = kept.select(F.col(key).cast("long").alias("id"), terms.alias("terms"))
    return stored(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id()))


def matrix(terms: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(terms), width), dtype=np.int64)
    for i, row in enumerate(terms):
        out[i, : len(row)] = row
    return out


def fit(terms: np.ndarray, width: int) -> np.ndarray:
    return np.pad(terms, ((0, 0), (0, max(0, width - terms.shape[1]))))


def scores(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    limits = np.iinfo(np.int64)
    return np.array([min(max(int(v), limits.min), limits.max) for v in rows.astype(object) @ query.astype(object)], dtype=np.int64)


def small_enough(rows: np.ndarray, queries: np.ndarray) -> bool:
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0.0))
    return most(rows) * most(queries) * max(1, rows.shape[1]) < EXACT


def seeds(queries: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """A lower bound of each query's kth score, from the other rows of its query block."""
    floor = np.full(len(queries), -np.inf)
    if len(queries) <= k or not small_enough(queries, queries):
        return floor
    wide = queries.astype(np.float64)
    for at in range(0, len(wide), chunk):
        found = wide[at : at + chunk] @ wide.T
        found[np.arange(len(found)), np.arange(at, at + len(found))] = -np.inf
        floor[at : at + chunk] = np.partition(found, -k, axis=1)[:, -k]
    return floor


def search_blocks(
    ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int, block: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best (index of the query, ids, scores) among the given rows."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = fit(rows, width), fit(queries, width)
    exact = small_enough(rows, queries)
    cuts = range(0, len(rows), block)
    high = np.array([rows[c : c + block].max(axis=0) for c in cuts]).astype(np.float64)
    low = np.array([rows[c : c + block].min(axis=0) for c in cuts]).astype(np.float64)
    wide = queries.astype(np.float64)
    bounds = np.maximum(wide, 0) @ high.T + np.minimum(wide, 0) @ low.T
    if not exact:
        bounds += np.abs(bounds) * 1e-9 + 1
    for q, order in enumerate(np.argsort(-bounds, axis=1, kind="stable")):
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        floor = floors[q]
        for b in order:
            if bounds[q, b] < floor:
                break
            part = slice(b * block, (b + 1) * block)
            got = scores(rows[part], queries[q], exact)
            keep = (got >= floor) & (numbers[part] != own[q])
            if not keep.any():
                continue
            best_ids, best = np.concatenate([best_ids, ids[part][keep]]), np.concatenate([best, got[keep]])
            top = np.lexsort((best_ids, -best.astype(np.float64) if exact else [-int(v) for v in best]))[:k]
            best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                floor = max(floor, best[-1])
        if len(best):
            yield q, best_ids, best


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block: int = 128,
    task_rows: int = 65_536,
    query_rows: int = 4096,
) -> DataFrame:
    """The k best rows of every query: query_id, rank, id, score. `is_query` is a condition on column `id`."""
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, key, vector, scale)
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    schema = "query_row long, query_id long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = ints.where(is_query).toLocalIterator()
    while chunk := list(islice(stream, query_rows)):  # a bounded number of queries at a time
        width = max(1, max(len(r.terms) for r in chunk))
        queries, own = matrix([r.terms for r in chunk], width), np.array([r.row for r in chunk], np.int64)
        names, floors = np.array([r.id for r in chunk], np.int64), seeds(queries, k)

        def search(batches, queries=queries, own=own, names=names, floors=floors):
            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= task_rows:
                    yield from answer(held, queries, own, names, floors)
                    held, rows = [], 0
            if rows:
                yield from answer(held, queries, own, names, floors)

        def answer(held, queries, own, names, floors):
            whole = pa.Table.from_batches(held)
            terms = whole.column("terms").to_pylist()
            rows = matrix(terms, max(1, max(map(len, terms))))
            ids, numbers = whole.column("id").to_numpy(), whole.column("row").to_numpy()
            found = list(search_blocks(ids, numbers, rows, queries, own, floors, k, block))
            if found:
                at = np.repeat([q for q, _, _ in found], [len(best) for _, _, best in found])
                columns = [own[at], names[at], np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "id", "score"])

        ints.mapInArrow(search, schema).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
