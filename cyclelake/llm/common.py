"""What the operators share: readers, folds, words, Arrow helpers, tables cut from lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cyclelake.session import stored

__all__ = ["bit_filter", "fold", "forget", "free_names", "has_bit", "in_arrow", "map_rows", "sliced", "stored", "table", "texts", "utf8", "words"]

SLICE_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def forget(*tables: DataFrame) -> None:
    """Delete the files of `stored` tables that nothing reads any more."""
    for table in tables:
        session = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bit_filter(numbers: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, packed, with those set that the column `bit` names; 2^bits / 32,768 rows come to the driver.

    Single numbers are shuffled and each stretch of bits is made in one place: as long as few bits are set, partial
    bitmaps of all tasks would be far larger than the numbers.
    """
    placed = numbers.select((F.col("bit") + 1).alias("bit"))
    dealt = placed.withColumn("at", F.bitmap_bucket_number("bit")).repartition("at")
    blocks = dealt.groupBy("at").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for at, own in blocks.collect():
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(own, np.uint8)
    return out


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of docs has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words without white space of ASCII, A-Z lower-cased, as UTF-8 (bytes.split cuts at x20, x09-x0D)."""
    return utf8(text).lower().split()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_ROWS rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def give_back() -> None:
    """Return memory that this process no longer uses to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` over batches of at most SLICE_ROWS rows (a session setting), whose tasks give back their memory.

    Whole texts travel in these batches; with Spark's ten thousand rows each of a task's buffers holds tens of MB."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= SLICE_ROWS:
        conf.set(ARROW_ROWS, str(SLICE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """Apply a function to slices of Arrow batches; it returns the columns named in `schema`, as arrays or lists."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = function(batch)
            columns = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return in_arrow(df, run, kinds)
