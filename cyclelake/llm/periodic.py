"""Periodic runs of words: tiles per period octave, solved apart with Z-functions at their boundaries, then stitched.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 * q) long, that no neighbouring word extends.
Periods are dealt to scales [1, 8), [8, 16), [16, 32) and so on. On a scale below `high` a text is covered
by tiles of 4 * high words, one every 2 * high, so any max(LEAST, 2 * q) words of a run lie in one tile, and the
parts of a run in neighbouring tiles overlap by at least q words. A run repeats a whole aligned block of words at
distance q; only tiles with such a block (compared by 64-bit hashes) become rows. Each row is solved by itself: the
Z-functions of the words after and before a block's place give all periods there. Fragments are shuffled by text and
period and joined where they overlap by a period or more; different runs of one period overlap by less.

A text is in memory in the task that reads it, its tiles are spread over all tasks. Words travel as numbers within
their text. Defined results: null and empty texts have no words and no runs; equal rows are apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cyclelake.llm.common import sliced, stored

LEAST = 12  # words of a run
FIRST = 8  # the first scale holds the periods below
MIX = np.uint64(0x9E3779B97F4A7C15)
COMPARED = 1 << 20  # hashes compared at a time
FRAGMENT = "text_row long, period long, start long, stop long"


def split(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` (bytes.split cuts at those)."""
    return text.split()


def scales(n: int) -> Iterator[tuple[int, int]]:
    """(low, high) of the periods low..high-1 that can have two turns in n words."""
    low, high = 1, FIRST
    while 2 * low <= n:
        yield low, high
        low, high = high, 2 * high


def block_words(low: int) -> int:
    """Any stretch of equal words at distance q (q on the scale) holds a whole aligned block of this many words."""
    shortest = min(max(q, LEAST - q) for q in range(low, FIRST)) if low < FIRST else low
    return (shortest + 1) // 2


class Hashes:
    """Hashes of the stretches of a text's numbers, from sums of powers."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.n, (up, self.down) = n, _powers(n + 1)
        values = (ids.astype(np.uint64) + np.uint64(1)) * MIX
        values = (values ^ (values >> np.uint64(29))) * MIX
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values ^ (values >> np.uint64(32))) * up[:n], out=self.sums[1:])

    def blocks(self, size: int) -> np.ndarray:
        """A hash of the `size` numbers from each place on."""
        if size > self.n:
            return np.empty(0, np.uint64)
        out = (self.sums[size:] - self.sums[:-size]) * self.down[: self.n - size + 1]
        return out ^ (out >> np.uint64(31))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MIX and of its inverse modulo 2^64; kept for the next text."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(n, 4096).bit_length()
        bases = (int(MIX), pow(int(MIX), -1, 1 << 64))
        _POWERS[:] = [tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in bases)]
    return _POWERS[0]


def repeated_blocks(ids: np.ndarray, hashes: Hashes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks that occur again at a distance on the scale, and all their hashes.

    Blocks within a run of a shorter period, whose repeats are turns of that run only, are left out."""
    size = block_words(low)
    own = hashes.blocks(size)
    if len(own) <= low:
        return np.empty(0, np.int64), own
    aligned = np.arange(0, len(own), size)
    padded = np.concatenate([own, np.full(high + size, own[0] ^ np.uint64(1))])
    later = np.ndarray((len(aligned), high - 1), np.uint64, padded, offset=8, strides=(8 * size, 8))  # shifts 1 to high - 1
    step = max(1, COMPARED // high)
    places = []
    short = (0, 0, 0)  # period, start and stop of the last run of a shorter period
    for at in range(0, len(aligned), step):
        starts = aligned[at : at + step]
        same = later[at : at + step] == own[starts][:, None]
        for row in np.flatnonzero(same[:, low - 1 :].any(1)).tolist():
            place = int(starts[row])
            shifts = np.flatnonzero(same[row]) + 1
            d, last = int(shifts[0]), int(shifts[-1])
            if d < low and (shifts[shifts >= low] % d == 0).all():
                if not (short[0] == d and short[1] <= place < short[2]):
                    short = (d, place, place + d + _agreeing(ids[place:], ids[place + d :]))
                if place + last + size <= short[2]:
                    continue
            places.append(place)
    return np.array(places, np.int64), own


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers agree from the start on."""
    done, width, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done : min(n, done + width)] != b[done : min(n, done + width)])
        if len(differ):
            return done + int(differ[0])
        done, width = done + width, 2 * width
    return n


def z_values(s: list[int], most: int) -> list[int]:
    """z[d]: length of the longest common prefix of s and s[d:], for d below `most`."""
    n = len(s)
    z = [0] * min(most, n)
    left = right = 0
    for d in range(1, len(z)):
        k = min(right - d, z[d - left]) if d < right else 0
        while d + k < n and s[k] == s[d + k]:
            k += 1
        z[d] = k
        if d + k > right:
            left, right = d, d + k
    return z


def match_values(text: list[int], pattern: list[int], most: int) -> list[int]:
    """For the first `most` places of a text: length of the longest common prefix of the pattern and the text from there on."""
    n, m = len(text), len(pattern)
    z = z_values(pattern, most)
    out = [0] * min(most, n)
    left = right = 0
    for i in range(len(out)):
        k = min(right - i, z[i - left] if i > left else m) if i < right and i - left < len(z) else 0
        if i + k >= right or k == 0:
            while i + k < n and k < m and text[i + k] == pattern[k]:
                k += 1
            if i + k > right:
                left, right = i, i + k
        out[i] = k
    return out


def _turns(words: list[int], place: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shift d below `most`: how far words and words d later agree from the place on, and before it."""
    after, before = np.zeros(most, np.int64), np.zeros(most, np.int64)
    found = z_values(words[place:], most)
    after[: len(found)] = found
    ahead = min(most - 1, len(words) - place)  # shifts for which the place d later is in the tile
    if place and ahead:
        found = match_values(words[place + ahead - 1 :: -1], words[place - 1 :: -1], ahead)
        before[1 : ahead + 1] = found[::-1]
    return after, before


def primitive(after: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """(d, before, after) of the shifts that repeat at a place and have no smaller period over the same words."""
    shifts = np.arange(len(after))
    repeats = (after + before >= shifts) & (shifts > 0)
    out = []
    for d in np.flatnonzero(repeats).tolist():
        if not repeats[d]:
            continue
        out.append((d, int(before[d]), int(after[d])))
        many = np.arange(2 * d, len(after), d)
        repeats[many[(before[many] <= before[d]) & (after[many] + many <= after[d] + d)]] = False
    return out


def fragments(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the runs' parts within a tile, for periods of the scale."""
    found: set[tuple[int, int, int]] = set()
    known: list[tuple[int, int, int]] = []
    words, size = ids.tolist(), block_words(low)
    places, hashes = repeated_blocks(ids, Hashes(ids), low, high)
    for place in places.tolist():
        shifts = np.flatnonzero(hashes[place + low : place + high] == hashes[place]) + low
        for d, start, stop in known:  # a known run explains its own turns
            if start <= place:
                shifts = shifts[(shifts % d != 0) | (place + size + shifts > stop)]
        if not len(shifts):
            continue
        after, before = _turns(words, place, high)
        for d, back, ahead in primitive(after, before):
            part = (d, place - back, place + d + ahead)
            known.append(part)
            if d >= low and part[2] - part[1] >= max(LEAST, 2 * d):
                found.add(part)
    return sorted(found)


def tile_rows(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(low, high, start, numbers) of the tiles that may hold a run."""
    hashes = Hashes(ids)
    for low, high in scales(len(ids)):
        places, _ = repeated_blocks(ids, hashes, low, high)
        if len(places):
            step = 2 * high
            for tile in np.unique(np.concatenate([places // step, np.maximum(places // step - 1, 0)])).tolist():
                yield low, high, tile * step, ids[tile * step : tile * step + 4 * high]


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as numbers in the order of their first places."""
    return np.array(list(map(_Numbered().__getitem__, words)), np.int32)


def stitched(parts: DataFrame) -> DataFrame:
    """Whole runs: fragments of one text and period joined where they overlap by a period or more."""
    own = Window.partitionBy("text_row", "period").orderBy("start", "stop")
    reached = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reached.isNull() | (F.col("start") > reached - F.col("period")), 1).otherwise(0)
    runs = parts.withColumn("opened", opened).withColumn("run", F.sum("opened").over(own))
    return runs.groupBy("text_row", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row as the query takes them: those of every tenth key turn periodic from a place on."""
    hashed, n = zlib.crc32(b"" if key is None else b"%d" % key), len(words)
    if hashed % 10 or not n:
        return words
    g = hashed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one space, without those that a run (start, stop, period) holds after its first turn."""
    keep = np.ones(len(words), bool)
    for start, stop, period in runs:
        keep[start + period : stop] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def tiles(docs: DataFrame, key: str, text: str, changed: Callable[[int | None, list[bytes]], list[bytes]] | None) -> DataFrame:
    """Stored rows of texts and of their tiles. A text row has its key, `n` words and, if it has tiles, the words
    joined; a text without tiles has its words' hash instead. A tile row has low, high, start and numbers."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"text_row long, `{key}` {kind}, n long, words binary, plain string, low long, high long, start long, numbers array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                rows, made = [], []
                keys, found = part.column(key), part.column(text).cast(pa.binary()).to_pylist()
                names = part.column("text_row").to_pylist()
                for at, (name, value, one) in enumerate(zip(names, keys.to_pylist(), found, strict=True)):
                    words = split(one or b"")
                    words = changed(value, words) if changed else words
                    own = list(tile_rows(numbers(words))) if len(words) >= LEAST else []
                    joined = b" ".join(words)
                    rows.append((name, at, len(words), joined if own else None, None if own else sha256(joined).hexdigest()))
                    made += [(name, *x) for x in own]
                yield _rows(schema, key, keys, rows, made)

    identified = docs.select(F.monotonically_increasing_id().alias("text_row"), key, text)
    return stored(identified.mapInArrow(run, schema))


def _rows(schema: str, key: str, keys: pa.Array, rows: list[tuple], made: list[tuple]) -> pa.RecordBatch:
    name, at, n, words, plain = zip(*rows, strict=True)
    tile = list(zip(*made, strict=True)) or [()] * 5
    few, many = len(rows), len(made)
    columns = {
        "text_row": pa.array([*name, *tile[0]], pa.int64()),
        key: pa.concat_arrays([keys.take(pa.array(at)), pa.nulls(many, keys.type)]),
        "n": pa.array([*n, *[None] * many], pa.int64()),
        "words": pa.array([*words, *[None] * many], pa.binary()),
        "plain": pa.array([*plain, *[None] * many], pa.string()),
        "low": pa.array([*[None] * few, *tile[1]], pa.int64()),
        "high": pa.array([*[None] * few, *tile[2]], pa.int64()),
        "start": pa.array([*[None] * few, *tile[3]], pa.int64()),
        "numbers": pa.array([*[None] * few, *tile[4]], pa.list_(pa.int32())),
    }
    return pa.RecordBatch.from_pydict(columns)


def solve(rows: DataFrame) -> DataFrame:
    """Fragments of all tile rows; tiles are dealt evenly, whatever text they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("text_row", "low", "high", "start"))
            for at, (name, low, high, start) in enumerate(zip(*columns, strict=True)):
                ids = batch.column("numbers")[at].values.to_numpy()
                out += [(name, q, start + a, start + b) for q, a, b in fragments(ids, low, high)]
            made = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["text_row", "period", "start", "stop"])

    dealt = rows.where("numbers IS NOT NULL").select("text_row", "low", "high", "start", "numbers").repartition("text_row", "low", "start")
    return dealt.mapInArrow(run, FRAGMENT)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", changed: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Text rows (see `tiles`) and the runs (text_row, period, start, stop) of all texts."""
    rows = tiles(docs, key, text, changed)
    return rows.where("numbers IS NULL").select("text_row", key, "n", "words", "plain"), stitched(solve(rows))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", changed: Callable | None = None) -> DataFrame:
    """Per row of docs: n_runs, the longest run, all `runs` as text and the collapsed text's and the runs' sha256."""
    texts, found = runs(docs, key, text, changed)
    listed = found.groupBy("text_row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("period"), "stop"))).alias("found"))  # runs of one text
    kind = docs.schema[key].dataType.simpleString()
    apart = texts.where("words IS NOT NULL").select("text_row", "words").join(listed, "text_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                made = []
                for words, own in zip(part.column("words").to_pylist(), part.column("found").to_pylist(), strict=True):
                    own = [(r["start"], r["stop"], r["period"]) for r in own or []]
                    made.append(sha256(collapsed(split(words), own)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("text_row"), pa.array(made, pa.string())], ["text_row", "short"])

    short = apart.mapInArrow(run, "text_row long, short string")
    length = lambda r: r["stop"] - r["start"]
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), length(r).cast("string"), r["period"].cast("string"))
    described = listed.select(
        "text_row",
        F.size("found").cast("long").alias("n_runs"),
        F.array_min(F.transform("found", lambda r: F.struct((-length(r)).alias("less"), r["start"].alias("start"), r["period"].alias("period")))).alias("best"),
        F.concat_ws("", F.transform("found", lambda r: F.concat(line(r), F.lit("\n")))).alias("runs"),
    )
    whole = texts.select("text_row", key, "n", "plain").join(described, "text_row", "left").join(short, "text_row", "left")
    length = -F.col("best.less")
    return whole.select(
        F.col(key).cast(kind).alias(key),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-best.less * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.coalesce("runs", F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.coalesce("short", "plain").alias("collapsed_sha256"),
        F.coalesce("runs", F.lit("")).alias("runs"),
        F.col("n").alias("n_words"),
    )
