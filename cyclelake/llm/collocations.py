"""Phrase collocations: frequency-ranked ids split into pair tiles, frequent pairs ranked again as ids.

Words are counted per language and ranked by their counts. Texts become rows of ranks; neighbouring ranks
are pairs, dealt to tiles of TILE x TILE cells. A tile with many pairs is counted directly into a dense array
(`bincount`), all other pairs as sorted coordinates. Partial counts meet in a sum by key. Pairs that are
frequent enough are ranked like words, and (pair, next word) is counted the same way, which gives triples.

What tasks hold is bounded: at most `hot` ranked words and pairs. Less frequent words keep a 62-bit number instead of
a rank (checked to be different for all words of the corpus, else numbered with another salt); a bit filter tells
which of them may be frequent. What passes the filter wrongly is counted and dropped afterwards. No phrase is lost, as a
phrase is never more frequent than its parts.

Defined results: a null text has no words, a null language is `und`, a table without words gives no rows, equal rows
count as often as they occur. Arithmetic is on decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.llm.common import bit_filter, has_bit, in_arrow, sliced, stored

LEAST = 10  # occurrences of a candidate
COVERED = (50, 100)  # a candidate goes if a longer one around it has this share of its occurrences
TILE = 1024
DENSE = TILE * TILE // 16  # pairs of a chunk from which a tile is counted densely
CHUNK = 1 << 19  # neighbouring words counted at a time
HELD_WORDS = 400_000
FILTER_BITS = 25
NUMBERED = 1 << 62  # numbers of unranked words start here
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))  # odd multipliers

# Marks that end a piece; they become the one token BREAK. A-Z are lower-cased.
BREAK = b"."
FOLDED = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with BREAK between its pieces."""
    return text.translate(FOLDED).replace(BREAK, b" . ").split()


def by_language(batch: pa.RecordBatch, lang: str, text: str) -> dict[bytes, list[bytes]]:
    rows: dict[bytes, list[bytes]] = {}
    langs, found = (batch.column(c).cast(pa.binary()).to_pylist() for c in (lang, text))
    for name, one in zip(langs, found, strict=True):
        if one:
            rows.setdefault(b"und" if name is None else name, []).append(one)
    return rows


def count_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, word, n) of all words."""

    def rows(held: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            counts.pop(BREAK, None)
            made = [pa.array([name] * len(counts), pa.binary()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}
        for batch in batches:
            for part in sliced([batch]):
                for name, found in by_language(part, lang, text).items():
                    own = held.setdefault(name, Counter())
                    for one in found:
                        own.update(tokens(one))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    counted = in_arrow(docs.select(lang, text), run, "lang binary, word binary, n long")
    summed = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(summed.select(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "n"))


def number(word: bytes, lang: bytes, salt: int) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word + b"\0%d" % salt, 42) & (NUMBERED - 1) | NUMBERED


def numbered(salt: int) -> Column:
    """`number` of the columns word and lang."""
    digest = F.xxhash64(F.concat("lang", F.lit("\0"), "word", F.lit(f"\0{salt}")))
    return digest.bitwiseAND(F.lit(NUMBERED - 1)).bitwiseOR(F.lit(NUMBERED))


def distinct_salt(words: DataFrame) -> int:
    """The first salt that gives all words different numbers."""
    salt = 0
    while not words.groupBy(numbered(salt).alias("number")).count().where("count > 1").isEmpty():
        salt += 1
    return salt


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of several integer columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = (out ^ column.astype(np.uint64)) * MIX[0]
        out = (out ^ (out >> np.uint64(32))) * MIX[1]
    return out ^ (out >> np.uint64(29))


def grouped(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and their counts, by sorted coordinates."""
    if not len(columns[0]):
        return columns, np.empty(0, np.int64)
    keys = mixed(columns)
    order = np.argsort(keys, kind="stable")

    def edges(arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[True], np.any([x[1:] != x[:-1] for x in arrays], axis=0)])

    ordered = [x[order] for x in columns]
    first = edges(ordered)
    if (first != edges([keys[order]])).any():  # two rows share a hash
        order = np.lexsort(columns)
        ordered = [x[order] for x in columns]
        first = edges(ordered)
    at = np.flatnonzero(first)
    return [x[at] for x in ordered], np.diff(np.append(at, len(order)))


def tiled(
    left: np.ndarray, right: np.ndarray, columns: list[np.ndarray], decode: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], across: int
) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct rows of `columns` and their counts; `left` and `right` are ranks from 1, 0 for none."""
    both = (left > 0) & (right > 0)
    tile = np.where(both, (left - 1) // TILE * across + (right - 1) // TILE, -1)
    full = np.flatnonzero(np.bincount(tile[both], minlength=1) >= DENSE)
    sparse = np.ones(len(left), bool)
    for one in full.tolist():
        own = tile == one
        sparse &= ~own
        counts = np.bincount((left[own] - 1) % TILE * TILE + (right[own] - 1) % TILE, minlength=TILE * TILE)
        cells = np.flatnonzero(counts)
        yield decode(one // across * TILE + cells // TILE + 1, one % across * TILE + cells % TILE + 1), counts[cells]
    yield grouped([x[sparse] for x in columns])


def rank_words(words: DataFrame, salt: int, hot: int) -> tuple[DataFrame, Broadcast]:
    """Frequent words with their codes, and what tasks need to code texts."""
    spark = words.sparkSession
    frequent = words.where(F.col("n") >= LEAST)
    top = frequent.orderBy(F.desc("n"), "lang", "word").limit(hot).toArrow()  # at most `hot` rows
    ranks = np.arange(1, top.num_rows + 1)
    ranked = spark.createDataFrame(pa.table({"lang": top.column("lang"), "word": top.column("word"), "rank": pa.array(ranks)}))
    table = dict(zip((f"{a}\0{b}".encode() for a, b in zip(top.column("lang").to_pylist(), top.column("word").to_pylist(), strict=True)), ranks.tolist(), strict=True))
    coded = stored(frequent.join(ranked, ["lang", "word"], "left").select("lang", "word", "n", F.coalesce("rank", numbered(salt)).alias("code")))
    rest = coded.where(F.col("code") >= NUMBERED).select(F.col("code").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("bit"))
    return coded, spark.sparkContext.broadcast((table, bit_filter(rest, FILTER_BITS), salt))


class Codes(dict):
    """Word to code within one language; 0 for BREAK and words that are not frequent."""

    def __init__(self, lang: bytes, shared: tuple):
        super().__init__({BREAK: 0})
        self.lang, (self.table, self.maybe, self.salt) = lang, shared

    def __missing__(self, word: bytes) -> int:
        code = self.table.get(self.lang + b"\0" + word)
        if code is None:
            code = number(word, self.lang, self.salt)
            at = code & ((1 << FILTER_BITS) - 1)
            code = code if self.maybe[at >> 3] >> (at & 7) & 1 else 0
        if len(self) < HELD_WORDS:
            self[word] = code
        return code


def coded_rows(batches: Iterator[pa.RecordBatch], lang: str, text: str, shared: Broadcast) -> Iterator[np.ndarray]:
    """Codes of texts in chunks, with 0 between pieces and texts."""
    codes: dict[bytes, Codes] = {}
    rows, size = [], 0
    for batch in batches:
        for part in sliced([batch]):
            for name, found in by_language(part, lang, text).items():
                if name not in codes:
                    codes = codes if len(codes) < 64 else {}
                    codes[name] = Codes(name, shared.value)
                own = codes[name].__getitem__
                for one in found:
                    rows += [np.fromiter(map(own, tokens(one)), np.int64), np.zeros(1, np.int64)]
                    size += len(rows[-2]) + 1
                    if size >= CHUNK:
                        yield np.concatenate(rows)
                        rows, size = [], 0
    if rows:
        yield np.concatenate(rows)


def _batch(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*columns, counts)], [*"abc"[: len(columns)], "n"])


def _rank(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < NUMBERED, codes, 0)


def _across(hot: int) -> int:
    return -(-hot // TILE)


def count_pairs(docs: DataFrame, lang: str, text: str, shared: Broadcast, hot: int) -> DataFrame:
    """(a, b, n) of all pairs of word codes that are frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in coded_rows(batches, lang, text, shared):
            at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            a, b = codes[at], codes[at + 1]
            for columns, counts in tiled(_rank(a), _rank(b), [a, b], lambda x, y: [x, y], _across(hot)):
                yield _batch(columns, counts)

    counted = in_arrow(docs.select(lang, text), run, "a long, b long, n long")
    return stored(counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))


def rank_pairs(pairs: DataFrame, hot: int) -> Broadcast:
    """The most frequent pairs by rank, in the order of their hashes, and a filter of the other ones."""
    top = pairs.orderBy(F.desc("n"), "a", "b").limit(hot).toArrow()  # at most `hot` rows
    a, b = (top.column(c).to_numpy() for c in "ab")
    keys = mixed([a, b])
    order = np.argsort(keys)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pair_bits(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["bit"])

    maybe = bit_filter(pairs.select("a", "b").mapInArrow(bits, "bit long"), FILTER_BITS)
    return pairs.sparkSession.sparkContext.broadcast((a, b, order, keys[order], maybe))


def pair_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed([a, b]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def pair_ranks(a: np.ndarray, b: np.ndarray, shared: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (0 for none), and whether it may be frequent."""
    first, second, order, keys, maybe = shared
    hashes = mixed([a, b])
    possible = has_bit(maybe, (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
    ranks = np.zeros(len(a), np.int64)
    if len(keys):
        asked = np.flatnonzero(possible)
        found = order[np.minimum(np.searchsorted(keys, hashes[asked]), len(keys) - 1)]
        same = (first[found] == a[asked]) & (second[found] == b[asked])
        ranks[asked[same]] = found[same] + 1
    return ranks, possible


def count_triples(docs: DataFrame, lang: str, text: str, shared: Broadcast, pairs: Broadcast, hot: int) -> DataFrame:
    """(a, b, c, n) of all triples of word codes that are frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in coded_rows(batches, lang, text, shared):
            whole = (codes[:-1] > 0) & (codes[1:] > 0)
            at = np.flatnonzero(whole)
            rank, possible = np.zeros(len(whole), np.int64), np.zeros(len(whole), bool)
            rank[at], possible[at] = pair_ranks(codes[at], codes[at + 1], pairs.value)
            at = np.flatnonzero(possible[:-1] & possible[1:])
            a, b, c = codes[at], codes[at + 1], codes[at + 2]
            decode = lambda x, y: [pairs.value[0][x - 1], pairs.value[1][x - 1], y]
            for columns, counts in tiled(rank[at], _rank(c), [a, b, c], decode, _across(hot)):
                yield _batch(columns, counts)

    counted = in_arrow(docs.select(lang, text), run, "a long, b long, c long, n long")
    return stored(counted.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))


def _score(a: str, left: str, right: str) -> Column:
    exact = [f"cast({x} as decimal(19,0))" for x in (a, left, right)]
    return F.expr(f"cast(cast(1000000 as decimal(7,0)) * {exact[0]} * {exact[0]} as decimal(38,0)) div (cast({exact[1]} * {exact[2]} as decimal(38,0)))")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 2000, hot: int = 1 << 16) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words = count_words(docs, lang, text)
    coded, shared = rank_words(words, distinct_salt(words), hot)
    counted = count_pairs(docs, lang, text, shared, hot)
    three = count_triples(docs, lang, text, shared, rank_pairs(counted, hot), hot)
    one = coded.select(F.col("code").alias("a"), "lang", F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    other = coded.select(F.col("code").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    two = stored(counted.join(one, "a").join(other, "b"))
    tail = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc"), F.col("word_b").alias("word_c"), F.col("n_b").alias("n_c"))
    heads = two.withColumnRenamed("n", "n_ab")
    three = stored(three.join(heads, ["a", "b"]).join(tail, ["b", "c"]))

    inside = three.select("a", "b", "n").union(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    covered = inside.groupBy("a", "b").agg(F.max("n").alias("longer"))
    alone = two.join(covered, ["a", "b"], "left").where(F.expr(f"longer is null or {COVERED[1]} * longer < {COVERED[0]} * n"))
    pairs = alone.select(
        "lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("n").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), _score("n", "n_a", "n_b").alias("score")
    )
    cut = F.when(_score("n", "n_a", "n_bc") <= _score("n", "n_ab", "n_c"), F.lit(1)).otherwise(2)
    triples = three.withColumn("cut", cut).select(
        "lang",
        F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"),
        F.col("n").alias("a"),
        F.expr("if(cut = 1, n_a, n_ab)").alias("l"),
        F.expr("if(cut = 1, n_bc, n_c)").alias("r"),
        F.least(_score("n", "n_a", "n_bc"), _score("n", "n_ab", "n_c")).alias("score"),
    )
    return _top(pairs.union(triples), top).join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _top(phrases: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The first phrases of each language; a language is first cut down in parts, so no task sorts all its phrases."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    leaders = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("part")
