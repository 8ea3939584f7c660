"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

The shard and slot of a row follow from its row number, the row count and the seed alone:
`position = permute(row_number)`, `shard = position % shards`, `slot = position // shards`. Shard
sizes differ by one row at most and slots have no gaps.

Defined results: a null text has no bytes (size 8, crc32 0); a null key sorts first; rows that are
equal in all columns get neighbouring row numbers in either order; an empty table gives no rows.
Only key, size and crc32 are sorted, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm.common import stored

ROUNDS = 4
# Odd multiplier of the round function (any odd number mixes; this one is 2^64 divided by the golden ratio).
MIX = 0x9E3779B97F4A7C15


def half_bits(n: int) -> int:
    """Bits of each half: the smallest even-sized domain that holds n numbers."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [((seed + r + 1) * MIX) % 2**64 for r in range(ROUNDS)]


def encrypt(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """One pass of the Feistel network over numbers below 4^bits."""
    mask, shift = np.uint64(2**bits - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys:
        f = (right + np.uint64(1)) * np.uint64(MIX) + np.uint64(key)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(MIX)
        left, right = right, left ^ ((f >> np.uint64(33)) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1; numbers that leave the range walk on along their cycle."""
    bits, keys = half_bits(n), round_keys(seed)
    out = encrypt(numbers.astype(np.uint64), bits, keys)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = encrypt(out[outside], bits, keys)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Global row numbers 0..n-1 in the given order, as columns `part`, `place` and the offset of each part.

    A range partitioning sorts the rows; rows are numbered within each range and the ranges' counts
    (one per partition) give the offsets. The ranges are stored, so a repeated task sees the same rows.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, part int, place long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(place, place + rows))]
            place += rows
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])

    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))


def shuffle_shards(
    docs: DataFrame, shards: int = 24, seed: int = 42, key: str = "doc_id", text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Shard and slot of every row: key, size, text_crc32, row_number, position, shard, slot and the carried columns."""
    octets = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sized = stored(
        docs.select(
            F.col(key),
            (F.octet_length(octets).cast("long") + 8).alias("size"),
            F.crc32(octets).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
            *(carry or []),
        )
    )
    ranged = number_rows(sized, [key, "text_crc32", "size", "tie"])
    counts = dict(ranged.groupBy("part").count().collect())  # one row per partition
    offsets = np.zeros(max(counts, default=0) + 2, np.int64)
    for part, rows in counts.items():
        offsets[part + 1] = rows
    offsets, n = np.cumsum(offsets), sum(counts.values())
    kept = [key, "size", "text_crc32", *(carry or [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.select(*kept).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = offsets[batch.column("part").to_numpy(zero_copy_only=False)] + batch.column("place").to_numpy(zero_copy_only=False)
            position = permute(number, n, seed)
            made = [number, position, (position % shards).astype(np.int32), position // shards]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, made)], [*kept, "row_number", "position", "shard", "slot"]
            )

    return ranged.mapInArrow(place, f"{schema}, row_number long, position long, shard int, slot long")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard with its rows in slot order (assigned: with the carried columns to write)."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
