"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are sorted by their first `threshold` bytes only, from the most significant digit on: a pass deals the suffixes
to groups by their next digit and drops groups of one; groups that are left after `threshold` bytes are exactly the
windows that occur more than once. Order inside the sort is by digit values, which are 64-bit hashes.

Neighbouring suffixes travel as one row while they can. The first digit of a suffix is the `GRAM`-byte string of least
hash within its first `threshold` bytes (equal windows have equal ones, at the same offset), so about a hundred
neighbours share it. Each pass knows of every row of suffixes a `core`, the bytes that all its windows share, and its
`whole`, all bytes of its windows:

* rows with a core of their own hold no repeated window and go,
* rows whose whole occurs twice hold repeated windows only and are done,
* of the rest one row for each whole is split for the next pass: first at every `CELL`th offset from
  the digit's place, then into single windows, where core and whole are the window.

A window is told by two independent 64-bit hashes. Texts are named by 95 bits of hashes and their
length, copies of a text share a name. Only numbers are shuffled, but for the bytes around rows that have to be split and
the texts of which a part is removed; bit filters tell tasks which these are, and what passes them wrongly is harmless.

Defined results: null and empty texts have no bytes, equal texts of `threshold` bytes or more are removed in full, row
by row; empty tables give no rows. Texts are cut at byte places, which may lie within a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cyclelake.llm.common import bit_filter, forget, has_bit, sliced, stored

THRESHOLD = 400
GRAM = 200  # bytes of the first digit
CELL = 12  # offsets split together in the second pass
CHUNK = 1 << 20  # suffixes of one text handled at a time
PLACE_BITS = 21  # places within a chunk
FILTER_BITS = 27
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SIZE_BITS = 31
ROW = "name_a long, name_b long, at long, core long, whole long"


def _scrambled(x: np.ndarray) -> np.ndarray:
    for mix in MIX:
        x = (x ^ (x >> np.uint64(30))) * mix
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, and a number for each byte value."""

    def __init__(self, n: int):
        self.up, self.down = (self._table(b, n) for b in (BASE, pow(BASE, -1, 1 << 64)))
        self.byte = _scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        width, step = 1, base
        while width < n:
            out[width : 2 * width] = out[: min(width, n - width)] * np.uint64(step)
            width, step = 2 * width, step * step % (1 << 64)
        return out

    def hashes(self, data: bytes, size: int) -> np.ndarray:
        """A hash of the `size` bytes from each place on."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[np.frombuffer(data, np.uint8)] * self.up[:n], out=sums[1:])
        return _scrambled((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


@lru_cache(1)
def powers(n: int) -> Powers:
    """Made once per process."""
    return Powers(n)


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each place the first place of the least hash among `width` hashes from it on."""
    n = len(hashes)
    low = np.uint64((1 << PLACE_BITS) - 1)
    marked = np.full(n + -n % width, np.uint64(2**64 - 1))
    marked[:n] = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    blocks = marked.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def suffix_rows(data: bytes, threshold: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, many, place, core) of the rows of neighbouring suffixes with one first digit, which stands at `place`."""
    for offset in range(0, len(data) - threshold + 1, CHUNK):
        hashes = powers(CHUNK + threshold).hashes(data[offset : offset + CHUNK + threshold - 1], gram)
        places = least_places(hashes, threshold - gram + 1)
        edges = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        own = places[edges]
        many = np.diff(np.append(edges, len(places)))
        yield from zip((edges + offset).tolist(), many.tolist(), (own + offset).tolist(), hashes[own].view(np.int64).tolist(), strict=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def core_of(data: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def whole_of(data: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(data, 42))


def name_of(data: bytes) -> tuple[int, int]:
    return _signed(xxhash.xxh3_64_intdigest(data)), _signed((xxhash.xxh64_intdigest(data, 42) >> 32) << SIZE_BITS | len(data))


def placed(start: int, many: int) -> int:
    return start << SIZE_BITS | many


def bit_of(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = _scrambled(out ^ column.view(np.uint64))
    return (out >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filter_of(df: DataFrame, columns: list[str]) -> np.ndarray:
    """A packed bit for each row's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_of(*(batch.column(c).to_numpy() for c in columns)))], ["bit"])

    return bit_filter(df.select(*columns).mapInArrow(run, "bit long"), FILTER_BITS)


def passing(df: DataFrame, columns: list[str], chosen: DataFrame) -> DataFrame:
    """Rows of df whose columns may occur in `chosen`."""
    bits = df.sparkSession.sparkContext.broadcast(filter_of(chosen, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, bit_of(*(batch.column(c).to_numpy() for c in columns)))))

    return df.mapInArrow(run, df.schema)


def first_rows(docs: DataFrame, text: str, threshold: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                rows = []
                for data in part.column(text).cast(pa.binary()).to_pylist():
                    if data and len(data) >= threshold:
                        name = name_of(data)
                        rows += [
                            (*name, placed(start, many), core, whole_of(data[start : start + many - 1 + threshold]))
                            for start, many, _, core in suffix_rows(data, threshold, gram)
                        ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["name_a", "name_b", "at", "core", "whole"])

    return stored(docs.select(text).mapInArrow(run, ROW))


def decide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: the rows that hold repeated windows only, and one row for each whole that has to be split."""
    groups = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    groups = stored(groups.where("n > 1").select("core", (F.col("least") != F.col("most")).alias("differ")))
    shared = stored(passing(rows, ["core"], groups).join(groups, "core"))
    forget(rows, groups)
    mixed = shared.where("differ")
    wholes = stored(mixed.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("name_a", "name_b", "at")).alias("first")))
    twice = mixed.join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"])
    spot = ["name_a", "name_b", "at"]
    return shared.where("NOT differ").select(*spot).union(twice.select(*spot)), wholes.select("first.*")


def around(docs: DataFrame, text: str, split: DataFrame, threshold: int, gram: int) -> DataFrame:
    """Rows to split with the bytes of their windows and the first digit's place among them."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(split, ["name_a", "name_b", "at"]))
    names = docs.sparkSession.sparkContext.broadcast(filter_of(split, ["name_a", "name_b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                rows = []
                for data in part.column(text).cast(pa.binary()).to_pylist():
                    if not data or len(data) < threshold:
                        continue
                    a, b = (np.array([x], np.int64) for x in name_of(data))
                    if not has_bit(names.value, bit_of(a, b))[0]:
                        continue
                    found = list(suffix_rows(data, threshold, gram))
                    at = np.array([placed(start, many) for start, many, _, _ in found], np.int64)
                    chosen = np.flatnonzero(has_bit(bits.value, bit_of(a.repeat(len(at)), b.repeat(len(at)), at)))
                    for start, many, place, _ in map(found.__getitem__, chosen.tolist()):
                        rows.append((int(a[0]), int(b[0]), start, many, place - start, data[start : start + many - 1 + threshold]))
                if rows:
                    made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)]
                    yield pa.RecordBatch.from_arrays(made, ["name_a", "name_b", "start", "many", "place", "bytes"])

    return stored(docs.select(text).mapInArrow(run, "name_a long, name_b long, start long, many long, place long, bytes binary"))


def cells(many: int, place: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, many, core start, core stop - threshold) of a row's parts with `size` offsets from the digit's place.

    Cells are laid from the place on, so equal windows lie in equal cells; the core belongs to the whole cell."""
    first = 0
    while first < many:
        offset = place - first  # of the window that starts at `first`
        low = offset // size * size  # least offset of the cell
        last = min(many - 1, place - low)
        yield first, last - first + 1, place - low, place - (low + size - 1)
        first = last + 1


def parts(blocks: DataFrame, size: int, threshold: int, split: DataFrame | None = None, within: int = 0) -> DataFrame:
    """Rows of the next pass: cells of `size` offsets; with `split`, single windows of the cells of `within` offsets named there."""
    bits = blocks.sparkSession.sparkContext.broadcast(filter_of(split, ["name_a", "name_b", "at"])) if split is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data, a, b, start = row["bytes"], row["name_a"], row["name_b"], row["start"]
                made = list(cells(row["many"], row["place"], within or size))
                if bits is not None:
                    at = np.array([placed(start + first, many) for first, many, _, _ in made], np.int64)
                    keep = has_bit(bits.value, bit_of(np.full(len(at), a), np.full(len(at), b), at))
                    made = [(i, 1, i, i) for (first, many, _, _), k in zip(made, keep.tolist(), strict=True) if k for i in range(first, first + many)]
                rows += [
                    (a, b, placed(start + first, many), core_of(data[begin : stop + threshold]), whole_of(data[first : first + many - 1 + threshold]))
                    for first, many, begin, stop in made
                ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["name_a", "name_b", "at", "core", "whole"])

    return stored(blocks.mapInArrow(run, ROW))


def repeated(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Stored (name_a, name_b, starts, stops, n_removed) of all texts with repeated windows: maximal runs of their bytes."""
    done, split = decide(first_rows(docs, text, threshold, gram))
    blocks = around(docs, text, split, threshold, gram)
    cell = min(CELL, threshold)
    second, split = decide(parts(blocks, cell, threshold))
    third, _ = decide(parts(blocks, 1, threshold, split, cell))
    spans = done.union(second).union(third).distinct()  # copies of a text share their spans
    listed = spans.groupBy("name_a", "name_b").agg(F.collect_list("at").alias("at"))  # rows of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = [], []
            for found in batch.column("at"):
                at = np.sort(found.values.to_numpy())
                begin, many = at >> SIZE_BITS, at & ((1 << SIZE_BITS) - 1)
                reach = np.maximum.accumulate(begin + many - 1 + threshold)
                opened = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                starts.append(begin[opened])
                stops.append(reach[np.append(opened[1:], len(at)) - 1])
            made = [batch.column("name_a"), batch.column("name_b"), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, stops))]
            total = pa.array([int((e - s).sum()) for s, e in zip(starts, stops, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*made, total], ["name_a", "name_b", "starts", "stops", "n_removed"])

    return stored(listed.mapInArrow(run, "name_a long, name_b long, starts array<long>, stops array<long>, n_removed long"))


def kept(data: bytes, starts: list[int], stops: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True))


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, texts: bool = False
) -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, the removed runs and, on demand, the kept bytes."""
    found = repeated(docs, text, threshold, gram)
    cut = found.where(F.col("n_removed") < F.col("name_b").bitwiseAND(F.lit((1 << SIZE_BITS) - 1)))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(cut, ["name_a", "name_b"]))
    kind = docs.schema[key].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                data = [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
                names = np.array([name_of(x) for x in data], np.int64).reshape(-1, 2)
                a, b = (np.ascontiguousarray(names[:, i]) for i in (0, 1))
                moved = has_bit(bits.value, bit_of(a, b)) | texts
                made = [pa.array(a), pa.array(b), pa.array(list(map(len, data)), pa.int64())]
                made.append(pa.array([sha256(x).hexdigest() for x in data], pa.string()))
                made.append(pa.array([x if m else None for x, m in zip(data, moved.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(key), *made], [key, "name_a", "name_b", "n_bytes", "plain", "bytes"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                starts, stops, data = (part.column(c).to_pylist() for c in ("starts", "stops", "bytes"))
                left = [kept(d or b"", s or [], e or []) for d, s, e in zip(data, starts, stops, strict=True)]
                whole = [not s for s in starts]
                digests = [p if w else sha256(x).hexdigest() for p, w, x in zip(part.column("plain").to_pylist(), whole, left, strict=True)]
                removed = part.column("n_removed").fill_null(0)
                made = [part.column(key), part.column("n_bytes"), removed, pa.array([len(s or []) for s in starts], pa.int64())]
                made += [pa.array(digests, pa.string()), part.column("starts"), part.column("stops")]
                made.append(pa.array(left if texts else [None] * len(left), pa.binary()))
                yield pa.RecordBatch.from_arrays(made, [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"])

    rows = docs.select(key, text).mapInArrow(named, f"`{key}` {kind}, name_a long, name_b long, n_bytes long, plain string, bytes binary")
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>, kept binary"
    return rows.join(found, ["name_a", "name_b"], "left").select(key, "n_bytes", "plain", "bytes", "starts", "stops", "n_removed").mapInArrow(finish, schema)
