"""SimHash near duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit
counts. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. With the counts in unary form (00, 01, 11) it is the number of differing bits of two
64-bit codes, so it is computed like a Hamming distance.

Range join: of two embeddings at distance 3 or less, one half (16 segments) differs by 1 at most.
Each fingerprint has a home cell per half, the half's counts; the join meets equal cells and the
neighbouring cells at distance 1. Such neighbours differ in parity, so only odd cells look into
their neighbours. Candidates are bounded by the Manhattan distance of the whole embedding and then
verified on the fingerprints.

Only distinct fingerprints are joined: copies never pair up. Cells with many fingerprints are split
by the adaptive skew join.

Defined results: a text without words (also null) has fingerprint 0, linked like any other; rows with a
null key belong to a component but never name it (a component of such rows alone has a null id);
rows that share a key are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm.common import map_rows, stored, texts, words
from cyclelake.llm.components import components

SEED = 42
HASHES_AT_ONCE = 65_536
LOW_BITS = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 values (repeats count)."""
    found = words(text)
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part], stops[part], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the fingerprint (signed 64 bits) of every row."""
    kept = docs.select(*(keep or []), F.col(text).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]

    def run(batch: pa.RecordBatch) -> dict:
        made = [fingerprint(t, shingle) for t in texts(batch, "__text")]
        return {c: batch.column(c) for c in keep or []} | {"fingerprint": made}

    return map_rows(kept, run, ", ".join([*schema, "fingerprint long"]))


def _unary(f: Column) -> Column:
    """Counts of the two-bit segments in unary form."""
    low, shifted = F.lit(LOW_BITS), F.shiftrightunsigned(f, 1)
    some, both = f.bitwiseOR(shifted).bitwiseAND(low), f.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(f: Column) -> Column:
    """Home cell per half: the half's 32 bits of unary counts, bit 32 names the half."""
    code = _unary(f)
    return F.array(code.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(code, 32).bitwiseOR(F.lit(1 << 32)))


def _neighbours(cell: Column) -> Column:
    """Cells whose counts differ by one in one segment; none for even cells."""
    flipped = F.transform(F.array(*[F.lit(1 << i) for i in range(32)]), lambda bit: cell.bitwiseXOR(bit))
    high = F.lit(LOW_BITS << 1 & 0xFFFFFFFF)
    lawful = F.filter(flipped, lambda c: c.bitwiseAND(high).bitwiseAND(F.bitwise_not(F.shiftleft(c, 1))) == 0)
    odd = F.bit_count(cell.bitwiseAND(F.lit(0xFFFFFFFF))) % 2 == 1
    return F.when(odd, lawful).otherwise(F.array().cast("array<bigint>"))


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints with at most `distance` (3 or less) differing bits, each once."""
    if not 0 <= distance <= 3:
        raise ValueError("the grid covers distances up to 3")
    home = distinct.select(F.col("fingerprint").alias("b"), F.explode(_cells(F.col("fingerprint"))).alias("cell"))
    own = home.select(F.col("b").alias("a"), "cell", F.lit(True).alias("own"))
    near = own.select("a", F.explode(_neighbours(F.col("cell"))).alias("cell"), F.lit(False).alias("own"))
    a, b = F.col("a"), F.col("b")
    apart = _unary(a).bitwiseXOR(_unary(b))
    second_half = F.col("p.cell") >= F.lit(1 << 32)
    once = ~second_half | (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) > 1)  # else the first half finds it
    met = (
        (F.col("p.cell") == F.col("h.cell"))
        & (~F.col("own") | (a < b))
        & (F.bit_count(apart) <= distance)
        & once
        & (F.bit_count(a.bitwiseXOR(b)) <= distance)
    )
    return own.union(near).alias("p").join(home.alias("h"), met).select("a", "b")


def near_duplicates(prints: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
    """Rows of a stored `fingerprints` table with `root`, the fingerprint that stands for the component, and
    `component_id`, the smallest key reachable over links."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("first")))
    roots = components(links(nodes, distance), "a", "b").withColumnRenamed("node", "fingerprint")
    linked = stored(roots.join(nodes, "fingerprint"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    named = nodes.join(linked.select("fingerprint", "root").join(smallest, "root"), "fingerprint", "left")
    named = stored(named.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("smallest", "first").alias("component_id")))
    return prints.join(named, "fingerprint")


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of every component, with all columns: that of the smallest key (nulls last); of rows equal in
    all columns one stays. Texts move once, to meet the winners."""
    hashed = docs.withColumn("__hash", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    prints = stored(fingerprints(hashed, text, shingle, [key, "__hash"]))
    found = near_duplicates(prints, key, distance)
    best = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "__hash")).alias("best")
    winners = stored(found.groupBy("root").agg(best).select(F.col("best.key").alias("__key"), F.col("best.__hash").alias("__hash")))
    met = hashed.join(winners, "__hash").where(F.col(key).eqNullSafe(F.col("__key")))
    return met.dropDuplicates(["__hash", "__key"]).select(*(f"`{c}`" for c in docs.columns))
