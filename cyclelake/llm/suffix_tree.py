"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's lower-case words, joined by one space and closed by an end mark. A
context is the row of up to `depth` symbols before a symbol. It is kept if it stands before at least
two training symbols and its next-symbol counts differ from those of the context one
symbol shorter: the log-likelihood gain n * KL(child, parent) must reach `least_gain`. Distributions
are smoothed towards the shorter context (Witten-Bell), at the root towards equal bytes. A symbol is
scored in the state of the longest kept suffix of what stands before it.

All counts cover all training texts, and the tree grows with them. Kept contexts with at least `least_share` of all
training symbols, at most 1 / least_share of each length, become an automaton that is sent to the tasks: its states are
these contexts with all their prefixes and suffixes. No context is more frequent than its suffixes, so a rarer kept one
is always longer than the state. A bit filter, sent too, tells symbols that may stand behind a rarer kept context;
those meet their whole chain of kept contexts in a join. What the filter passes wrongly gets the same value there.
Words are counted exactly for the unigram base. Words with at least `hot_share` of the tokens, at most 1 / hot_share
words, are sent to the tasks; all other words meet their counts in a join.

Defined results: a null or empty text is the end mark alone; bytes that no training text holds get the
smoothed rest; without training texts every byte is equally likely and the base is 0; equal rows are
scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm.common import bit_filter, has_bit, sliced, stored, texts, words

END = b"\n"  # in no word, so it is the end mark, its token, and the filling before a text
CHUNK_BYTES = 1_000_000
HELD_GRAMS, HELD_WORDS = 600_000, 150_000  # distinct ones that a counting task holds before it passes them on
LANE = 512
FILTER_BITS = 6, 27  # of the filter for rarer contexts: 2^6 each, 2^27 at most


@dataclass(frozen=True)
class Limits:
    """Parameters of the tree and of the word counts; the shares tell what is sent to the tasks, not what counts."""

    depth: int = 5
    least_share: float = 2e-6
    least_gain: float = 4.0
    hot_share: float = 1e-6


def sequence(tokens: list[bytes], depth: int) -> bytes:
    return END * depth + b" ".join(tokens) + END


@dataclass
class Chunk:
    """Some texts of a batch: their tokens, symbols, and where each text's symbols start."""

    rows: list[list[bytes]]
    symbols: np.ndarray
    starts: np.ndarray


def chunks(batch: pa.RecordBatch, text: str, depth: int) -> Iterator[Chunk]:
    """A batch in chunks of bounded size, so that only one chunk's tokens are held at a time."""
    rows, held, size = [], [], 0
    for part in sliced([batch]):
        for one in texts(part, text):
            rows.append(words(one))
            held.append(sequence(rows[-1], depth))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield _chunk(rows, held)
                rows, held, size = [], [], 0
    if rows:
        yield _chunk(rows, held)


def _chunk(rows: list[list[bytes]], held: list[bytes]) -> Chunk:
    lengths = np.array([len(x) for x in held])
    return Chunk(rows, np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths)


def scored_places(length: int, starts: np.ndarray, depth: int) -> np.ndarray:
    """True where a symbol belongs to a text, not to the filling before it."""
    own = np.ones(length, bool)
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return own


def grams(symbols: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context of full depth, symbol) pairs as numbers, and their counts."""
    keys = np.zeros(len(symbols), np.uint64)
    for j in range(depth + 1):
        keys[depth:] |= symbols[depth - j : len(symbols) - j].astype(np.uint64) << np.uint64(8 * j)
    return np.unique(keys[scored_places(len(symbols), starts, depth)], return_counts=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.add.reduceat(counts[order], first)


def count(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """Stored counts of all words (the end mark among them) and of all full-depth grams."""

    def rows(tokens: Counter, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(parts) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(tokens.keys(), pa.binary()), pa.nulls(len(keys), pa.binary())]),
                pa.concat_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(keys.astype(np.int64))]),
                pa.concat_arrays([pa.array(tokens.values(), pa.int64()), pa.array(counts.astype(np.int64))]),
            ],
            ["word", "gram", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, parts, held = Counter(), [], 0
        for batch in batches:
            for chunk in chunks(batch, text, depth):
                for row in chunk.rows:
                    tokens.update(row)
                tokens[END] += len(chunk.rows)
                parts.append(grams(chunk.symbols, chunk.starts, depth))
                held += len(parts[-1][0])
                if held > 2 * HELD_GRAMS:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD_GRAMS:
                        yield from rows(Counter(), parts)
                        parts, held = [], 0
                if len(tokens) > HELD_WORDS:
                    yield from rows(tokens, [])
                    tokens = Counter()
        yield from rows(tokens, parts)

    counted = docs.select(text).mapInArrow(run, "word binary, gram long, n long")
    return stored(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def kept_contexts(counted: DataFrame, limits: Limits) -> DataFrame:
    """Counts of the kept contexts' next symbols: length, context, symbol, n, total, kinds, hot (the root has length 0).

    `total` and `kinds` are those of the context, `hot` tells that it is sent to the tasks."""
    lengths = range(limits.depth + 1)
    suffixes = F.array(*[F.struct(F.lit(d).alias("length"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")) for d in lengths])
    levels = counted.where("gram IS NOT NULL").select(F.explode(suffixes).alias("s"), "n").groupBy("s.length", "s.key").agg(F.sum("n").alias("n"))
    context = F.shiftright("key", 8)
    levels = stored(levels.select("length", "key", context.alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n"))
    totals = stored(levels.groupBy("length", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
    symbols = totals.where("length = 0").agg(F.sum("total")).first()[0] or 0
    repeated = totals.where("total >= 2")
    child = levels.join(repeated, ["length", "context"])
    shorter = F.lit((1 << 8 * limits.depth) - 1)
    for d in range(limits.depth, 0, -1):
        shorter = F.when(F.col("length") == d, F.lit((1 << 8 * d) - 1)).otherwise(shorter)
    child = child.select("*", (F.col("length") - 1).alias("up"), F.col("key").bitwiseAND(shorter).alias("up_key"))
    parent = levels.select(F.col("length").alias("up"), F.col("key").alias("up_key"), F.col("context").alias("up_context"), F.col("n").alias("up_n"))
    parent = parent.join(totals.select(F.col("length").alias("up"), F.col("context").alias("up_context"), F.col("total").alias("up_total")), ["up", "up_context"])
    gain = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total")))
    differing = child.where("length > 0").join(parent, ["up", "up_key"]).groupBy("length", "context").agg(F.sum(gain).alias("gain"))
    kept = differing.where(F.col("gain") >= limits.least_gain).select("length", "context")
    kept = totals.join(kept.union(totals.where("length = 0").select("length", "context")), ["length", "context"])
    hot = (F.col("length") == 0) | (F.col("total") >= limits.least_share * symbols)
    return levels.join(kept.withColumn("hot", hot), ["length", "context"]).select("length", "context", "symbol", "n", "total", "kinds", "hot")


def filter_places(length: np.ndarray | int, context: np.ndarray, bits: int) -> np.ndarray:
    """Places of contexts among 2^bits."""
    key = context.astype(np.uint64) | (np.asarray(length).astype(np.uint64) << np.uint64(56))
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def rare_filter(kept: DataFrame) -> np.ndarray | None:
    """Packed bits in which all kept contexts that are not hot have theirs set; None without such contexts."""
    rare = kept.where("NOT hot").select("length", "context").distinct()
    number = rare.count()
    if not number:
        return None
    bits = min(max(15, FILTER_BITS[0] + math.ceil(math.log2(number))), FILTER_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, context = (batch.column(c).to_numpy() for c in ("length", "context"))
            yield pa.RecordBatch.from_arrays([pa.array(filter_places(length, context, bits))], ["bit"])

    return bit_filter(rare.mapInArrow(run, "bit long"), bits)


def rare_symbols(symbols: np.ndarray, lengths: np.ndarray, own: np.ndarray, depth: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams) of the own symbols that may stand behind a context of the filter, longer than their state."""
    at = np.flatnonzero(own & (lengths < depth))
    context, found, size = np.zeros(len(at), np.uint64), np.zeros(len(at), bool), (8 * len(bits)).bit_length() - 1
    for d in range(1, depth + 1):
        context |= symbols[at - d].astype(np.uint64) << np.uint64(8 * (d - 1))
        longer = np.flatnonzero(lengths[at] < d)
        found[longer] |= has_bit(bits, filter_places(d, context[longer], size))
    at, context = at[found], context[found]
    return at, ((context << np.uint64(8)) | symbols[at].astype(np.uint64)).astype(np.int64)


def chain_logarithms(grams: DataFrame, kept: DataFrame, depth: int) -> DataFrame:
    """gram, log10: the smoothed probability of each gram's symbol behind its longest kept context."""
    mask = lambda d: F.lit((1 << 8 * d) - 1)
    chain = F.array(*[F.struct(F.lit(d).alias("length"), F.shiftright("gram", 8).bitwiseAND(mask(d)).alias("context")) for d in range(depth + 1)])
    asked = grams.select("gram", F.explode(chain).alias("c")).select("gram", "c.*", F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"))

    def met(asked: DataFrame, kept: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
        contexts = kept.groupBy("length", "context").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"))  # the same in every row
        counts = kept.select("length", "context", "symbol", "n")
        return asked.join(sent(contexts), ["length", "context"]).join(sent(counts), ["length", "context", "symbol"], "left")

    # every gram meets the few contexts of at most one byte: 257 with 256 symbols each at most
    steps = met(asked.where("length < 2"), kept.where("length < 2"), F.broadcast).unionByName(met(asked.where("length >= 2"), kept.where("length >= 2"), lambda x: x))
    one = F.struct("length", F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds")
    smoothed = F.aggregate(
        F.sort_array(F.collect_list(one)), F.lit(1 / 256), lambda p, s: (s.n + s.kinds * p) / (s.total + s.kinds)  # at most depth + 1 contexts
    )
    return steps.groupBy("gram").agg(F.log10(smoothed).alias("log10"))


@dataclass
class Automaton:
    """Transitions and log10 probabilities by state and symbol class; the last class is any unseen byte."""

    classes: np.ndarray
    follow: np.ndarray
    log10: np.ndarray
    depth: int
    lengths: np.ndarray

    def read(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every symbol and its state's length. Lanes run side by side; `depth` symbols fix a lane's state."""
        width, depth = self.follow.shape[1], self.depth
        lanes = -(-len(symbols) // LANE)
        seen = np.full(lanes * LANE + depth, self.classes[END[0]], np.int64)
        seen[depth : depth + len(symbols)] = self.classes[symbols]
        out, lengths, state = np.zeros((lanes, LANE)), np.zeros((lanes, LANE), np.int8), np.zeros(lanes, np.int64)
        at = np.arange(lanes) * LANE
        follow, log10 = self.follow.ravel(), self.log10.ravel()
        for step in range(LANE + depth):
            place = state * width + seen[at + step]
            if step >= depth:
                out[:, step - depth], lengths[:, step - depth] = log10[place], self.lengths[state]
            state = follow[place].astype(np.int64)
        return out.ravel()[: len(symbols)], lengths.ravel()[: len(symbols)]


def build(length: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, depth: int) -> Automaton:
    """Automaton of kept contexts (rows of `kept_contexts`)."""
    seen = np.unique(np.concatenate([symbol[length == 0], [END[0]]])).astype(np.int64)
    classes = np.full(256, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    kept = [np.unique(context[length == d]) for d in range(depth + 1)]
    states = [np.zeros(1, np.int64), *kept[1:]]
    for d in range(depth, 1, -1):  # with all prefixes and suffixes
        states[d - 1] = np.unique(np.concatenate([states[d - 1], states[d] >> 8, states[d] & ((1 << 8 * (d - 1)) - 1)]))
    first = np.cumsum([0, *map(len, states)])
    follow = np.zeros((first[-1], width), np.int32)
    p = np.full((first[-1], width), 1 / 256)
    for d in range(depth + 1):
        own = slice(first[d], first[d + 1])
        if d:
            shorter = states[d] & ((1 << 8 * (d - 1)) - 1)
            link = first[d - 1] + np.searchsorted(states[d - 1], shorter)
            follow[own], p[own] = follow[link], p[link]
        rows = np.nonzero(length == d)[0]
        if len(rows):
            counts = np.zeros((len(states[d]), width))
            counts[np.searchsorted(states[d], context[rows]), classes[symbol[rows]]] = n[rows]
            total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            p[own] = np.where(total > 0, (counts + kinds * p[own]) / np.maximum(total + kinds, 1), p[own])
        if d < depth and len(states[d + 1]):
            before = first[d] + np.searchsorted(states[d], states[d + 1] >> 8)
            follow[before, classes[states[d + 1] & 255]] = first[d + 1] + np.arange(len(states[d + 1]))
    return Automaton(classes, follow, np.log10(p), depth, np.repeat(np.arange(depth + 1), list(map(len, states))).astype(np.int8))


@dataclass
class Model:
    automaton: Automaton
    kept: DataFrame
    rare: np.ndarray | None
    hot: dict[bytes, int]
    counts: DataFrame
    tokens: int
    distinct: int
    ends: int


def fit(docs: DataFrame, is_training: Column, text: str = "text", limits: Limits = Limits()) -> Model:  # noqa: B008
    """Word counts and automaton of the rows for which `is_training` holds."""
    counted = count(docs.where(is_training), text, limits.depth)
    counts = counted.where("word IS NOT NULL").select("word", "n")
    tokens, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    hot = counts.where(F.col("n") >= limits.hot_share * (tokens or 0)).where(F.col("word") != F.lit(END)).toArrow()
    kept = stored(kept_contexts(counted, limits))
    sent = kept.where("hot").toArrow()  # bounded by the share
    numbers = [sent.column(c).to_numpy().astype(np.int64) for c in ("length", "context", "symbol", "n")]
    known = dict(zip(hot.column("word").to_pylist(), hot.column("n").to_pylist(), strict=True))
    return Model(build(*numbers, limits.depth), kept, rare_filter(kept), known, counts, tokens or 0, distinct or 0, ends or 0)


NOTHING = np.empty(0, np.int64), np.empty(0, np.int64)


def _by_row(row: np.ndarray, gram: np.ndarray, rows: int) -> pa.ListArray:
    """The distinct grams of each row with their numbers."""
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])) if len(row) else np.empty(0, np.int64)
    offsets = np.searchsorted(row[first], np.arange(rows + 1))
    items = [pa.array(gram[first]), pa.array(np.diff(np.append(first, len(row))))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(items, ["gram", "k"]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    names = [*keep, "row", "n_tokens", "known_here", "base_here", "score_here", "rare", "deep"]
    log10_of = lambda n: math.log10((n + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
    hot_logs, end_log = {w: log10_of(n) for w, n in model.hot.items()}, log10_of(model.ends)
    shared = docs.sparkSession.sparkContext.broadcast((model.automaton, hot_logs, model.rare))  # bounded by the shares and FILTER_BITS
    ends, depth = model.ends, model.automaton.depth
    tokens, distinct = model.tokens, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, logs, bits = shared.value
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
        deep_kind = pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64())]))
        for batch in batches:
            lengths, known, sums, scores, rare, deep = [], [], [], [np.empty(0)], [], []
            for chunk in chunks(batch, "__text", depth):
                values, reached = automaton.read(chunk.symbols)
                own = scored_places(len(chunk.symbols), chunk.starts, depth)
                values[~own] = 0.0
                at, asked_grams = rare_symbols(chunk.symbols, reached, own, depth, bits) if bits is not None else NOTHING
                values[at] = 0.0
                scores.append(np.add.reduceat(values, chunk.starts))
                deep.append(_by_row(np.searchsorted(chunk.starts, at, side="right") - 1, asked_grams, len(chunk.rows)))
                asked, asked_n, offsets = [], [], [0]
                for own in chunk.rows:
                    found = [logs[w] for w in own if w in logs]
                    rest = Counter([w for w in own if w not in logs]) if len(found) < len(own) else {}
                    asked += rest.keys()
                    asked_n += rest.values()
                    offsets.append(len(asked))
                    lengths.append(len(own) + 1)
                    known.append(len(found) + (ends > 0))
                    sums.append(math.fsum(found) + end_log)
                items = pa.StructArray.from_arrays([pa.array(asked, pa.binary()), pa.array(asked_n, pa.int64())], fields=list(kind.value_type))
                rare.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items))
            columns = [np.arange(row, row + batch.num_rows), np.array(lengths, np.int64), np.array(known, np.int64), np.array(sums, float), np.concatenate(scores)]
            row += batch.num_rows
            rare, deep = (pa.concat_arrays(x) if x else pa.array([], k) for x, k in ((rare, kind), (deep, deep_kind)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns), rare.cast(kind), deep.cast(deep_kind)], names)

    made = "row long, n_tokens long, known_here long, base_here double, score_here double, rare array<struct<word: binary, k: long>>, deep array<struct<gram: long, k: long>>"
    here = stored(kept.mapInArrow(run, ", ".join([*schema, made])))
    asked = here.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    n = F.coalesce("n", F.lit(0))
    logarithm = F.log10((n + F.lit(0.1)) / F.lit(tokens + 0.1 * (distinct + 1)))
    answered = asked.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * logarithm).alias("base_there"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("known_there")
    )
    met = here.join(answered, "row", "left")
    score = F.col("score_here")
    if model.rare is not None:
        deep = here.select("row", F.explode("deep").alias("d")).select("row", "d.gram", "d.k")
        logs = chain_logarithms(deep.select("gram").distinct(), model.kept, depth)
        there = deep.join(logs, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("log10")).alias("score_there"))
        met, score = met.join(there, "row", "left"), score + F.coalesce("score_there", F.lit(0.0))
    return met.select(
        *keep, "n_tokens", (F.col("known_here") + F.coalesce("known_there", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_here") + F.coalesce("base_there", F.lit(0.0))).alias("base_score"), score.alias("score"),
    )
