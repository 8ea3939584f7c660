"""Near duplicates by exact Jaccard similarity of word shingles, over a prefix index.

A text is the set of its shingles of `shingle` words (a shorter text is one shingle). Two sets with a
similarity of `LEAST` or more share one of the first n - ceil(LEAST * n) + 1 shingles of each in any common
order, so texts that share such a prefix shingle are all candidates there are. Any order is right; to keep the
lists short the shingles most frequent in a sample of the texts come last.

The first candidates come from op4's SimHash segments over five-word fingerprints: texts of one fingerprint meet its
smallest text, and the smallest texts of fingerprints that the grid range-join links meet each other. What they join after
verification on the whole sets need not be compared again; the prefix index finds the pairs that differ in more bits.

Least and greatest text of every prefix shingle are found by an aggregation that combines before it shuffles. Shingles of
one text only go; a bit filter of the others tells a second reading which prefix shingles to list at all. Candidates in
one list are first compared with the list's smallest text, which joins most other copies; then, in lists whose texts are still
in several components, with another of its texts, chosen by a hash, as long as that joins many; then all pairs across components,
each made once, however many lists it shares. A parity sketch of about a bit per shingle bounds the number of shingles in
only one of two sets from below and drops pairs without loss; the others are verified on the whole sets, which
are read for texts of such pairs alone.

Defined results: texts of equal words are one node, named by a 64-bit hash under the first seed that gives all different texts
of the corpus different names; texts without words (also null) are equal; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm import simhash
from cyclelake.llm.common import bit_filter, forget, free_names, has_bit, map_rows, stored, texts, words
from cyclelake.llm.components import components

SEED = 42
LEAST = (4, 5)  # the similarity 0.8 as a fraction
SAMPLE, HOT = 16, 65_536  # one text in SAMPLE is counted; at most HOT shingles are sent to the tasks
MOST_BITS = 27
STRAYS = 16  # lists are compared with one of their texts again while that joins one in STRAYS texts
FIRST = 16  # lists by which a text tells whether a pair was made before


def name_of(found: list[bytes], seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(b" ".join(found), seed)


def shingles(found: list[bytes], shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    if len(found) <= shingle:
        return np.array([name_of(found)], np.uint64)
    joined = b" ".join(found)
    stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(found) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)], np.uint64))


def prefix(own: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The prefix shingles of a set; `hot` is sorted, `rank` its place in the order."""
    place = np.zeros(len(own), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        place = np.where(hot[at] == own, rank[at], 0)
    least = -(-LEAST[0] * len(own) // LEAST[1])
    return own[np.lexsort((own, place))[: len(own) - least + 1]]


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 2^k classes, as 64-bit numbers; about as many classes as shingles, at least 256.

    The two halves of a sketch added bit by bit are the sketch of half as many classes."""
    bits = 1 << max(8, (len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _possible(a: str, b: str) -> Column:
    """Whether sizes and sketches allow the similarity: |A xor B| <= (|A| + |B|) * (1 - LEAST) / (1 + LEAST)."""
    one, other = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    odd = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, i: n + i)

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda i, j: i.bitwiseXOR(j))

    many, few = F.size(one), F.size(other)
    bits = F.when(many == few, odd(one, other)).when(many == 2 * few, odd(halved(one), other)).when(2 * many == few, odd(one, halved(other)))
    most = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (LEAST[1] - LEAST[0])
    allowed = lambda x: x * (LEAST[1] + LEAST[0]) <= most
    return F.when(allowed(F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))), F.coalesce(allowed(bits), F.lit(False))).otherwise(False)


@dataclass(frozen=True)
class Filter:
    """Tells for 64-bit values whether they may be among those it was made of; 16 to 32 bits for each, 2^MOST_BITS at most."""

    bits: int
    packed: Broadcast

    def has(self, values: np.ndarray) -> np.ndarray:
        return has_bit(self.packed.value, bits_of(values, self.bits))


def bits_of(values: np.ndarray, bits: int) -> np.ndarray:
    mixed = (values.view(np.uint64) ^ (values.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(df: DataFrame, column: str) -> Filter:
    """A filter of a stored table's column."""
    bits = min(MOST_BITS, max(18, (16 * df.count()).bit_length()))
    numbered = map_rows(df.select(column), lambda batch: {"bit": bits_of(batch.column(column).to_numpy(), bits)}, "bit long")
    return Filter(bits, df.sparkSession.sparkContext.broadcast(bit_filter(numbered, bits)))


def verified(pairs: DataFrame, read_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct pairs (a, b) whose sets are similar enough; `read_sets` gives (id, own) of the texts named."""
    pairs = stored(pairs.distinct())
    asked = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = stored(read_sets(asked))
    one = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    other = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    similar = shared * (LEAST[0] + LEAST[1]) >= (F.size("own_a") + F.size("own_b")) * LEAST[0]
    found = stored(pairs.join(one, "a").join(other, "b").where(similar).select("a", "b"))
    forget(pairs, asked, sets)
    return found


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Candidates (a, b) of a stored table (id, fingerprint) of different texts: each text with the smallest of its fingerprint, and the
    smallest texts of linked fingerprints."""
    leads = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("lead")))
    own = prints.join(leads, "fingerprint").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    named = lambda side: leads.select(F.col("fingerprint").alias(side), F.col("lead").alias(f"lead_{side}"))
    linked = simhash.links(leads.select("fingerprint")).join(named("a"), "a").join(named("b"), "b")
    return own.union(linked.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (gram, id, root) of lists whose texts are in several components."""
    ends = rows.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(ends.where("low < high").select("gram"), "gram", "left_semi")


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each text with one text of each of its lists, another one every turn, where they are in different components."""
    centres = rows.groupBy("gram").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "gram", "id"), "id", "root")).alias("centre"))
    other = rows.join(centres, "gram").where("root != centre.root")
    return other.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


def possible(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    met = pairs.join(small.alias("p"), F.col("a") == F.col("p.id")).join(small.alias("q"), F.col("b") == F.col("q.id"))
    return met.where(_possible("p", "q")).select("a", "b")


def merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (gram, id, root) with the components that the links (a, b) join as one."""
    own = stored(rows.select("id", "root").distinct())
    named = lambda side: own.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    joined = found.join(named("a"), "a").join(named("b"), "b").select("root_a", "root_b")
    after = components(joined, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("now"))
    return rows.join(after, "root", "left").select("gram", "id", F.coalesce("now", "root").alias("root"))


def cross_pairs(rows: DataFrame, small: DataFrame) -> DataFrame:
    """All pairs (a, b) across components that sizes and sketches allow; a pair is made in the first of its lists, as far as the
    FIRST first lists of both texts tell."""
    first = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("gram")), 1, FIRST).alias("first"))
    rows = stored(rows.join(first.join(small, "id"), "id"))
    earliest = F.array_min(F.array_intersect("p.first", "q.first"))
    apart = (F.col("p.gram") == F.col("q.gram")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.root") != F.col("q.root"))
    met = apart & F.coalesce(earliest >= F.col("p.gram"), F.lit(True)) & _possible("p", "q")
    return rows.alias("p").join(rows.alias("q"), met).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


def links(docs: DataFrame, text: str = "text", shingle: int = 5, seed: int = SEED) -> DataFrame:
    """Pairs (a, b) of names that join all texts with a similarity of LEAST or more into their components."""
    spark = docs.sparkSession
    kept = docs.select(F.col(text).alias("__text"))

    def named(batch: pa.RecordBatch) -> dict[int, list[bytes]]:
        return {_signed(name_of(w, seed)): w for w in map(words, texts(batch, "__text"))}

    def sampled(batch: pa.RecordBatch) -> dict:
        found = [shingles(w, shingle) for n, w in named(batch).items() if n % SAMPLE == 0]
        return {"gram": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64).tolist()}

    counted = map_rows(kept, sampled, "gram long").groupBy("gram").count().where("count > 1")
    top = counted.orderBy(F.desc("count"), "gram").limit(HOT).toArrow()
    hot, n = top.column("gram").to_numpy().astype(np.int64).view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(hot)
    frequent = spark.sparkContext.broadcast((hot[order], n[order]))  # at most HOT shingles

    def listed(batch: pa.RecordBatch) -> dict:
        found = named(batch)
        rows = [prefix(shingles(w, shingle), *frequent.value).view(np.int64) for w in found.values()]
        names = np.repeat(np.array(list(found), np.int64), [len(x) for x in rows])
        return {"gram": pa.array(np.concatenate([np.empty(0, np.int64), *rows])), "id": pa.array(names)}

    ends = map_rows(kept, listed, "gram long, id long").groupBy("gram").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    lists = stored(ends.where("least < most").select("gram", "least"))
    repeated = filter_of(lists, "gram")
    def placed(batch: pa.RecordBatch) -> dict:
        grams, ids, sizes, sketches = [], [], [], []
        for name, found in named(batch).items():
            own = shingles(found, shingle)
            some = prefix(own, *frequent.value).view(np.int64)
            some = some[repeated.has(some)].tolist()
            if some:
                grams += [None, *some]
                ids += [name] * (len(some) + 1)
                sizes += [len(own), *[None] * len(some)]
                sketches += [sketch(own), *[None] * len(some)]
        return {"gram": grams, "id": ids, "n": sizes, "sketch": sketches}

    rows = stored(map_rows(kept, placed, "gram long, id long, n long, sketch array<long>"))
    shared = stored(rows.where("gram IS NOT NULL").select("gram", "id").distinct().join(lists, "gram"))
    small = stored(rows.where("gram IS NULL").drop("gram").dropDuplicates(["id"]))
    forget(rows, lists)

    def read_sets(asked: DataFrame) -> DataFrame:
        wanted = filter_of(asked, "id")

        def whole(batch: pa.RecordBatch) -> dict:
            found = named(batch)
            keep = wanted.has(np.array(list(found), np.int64)).tolist()
            made = {name: shingles(w, shingle).view(np.int64) for (name, w), k in zip(found.items(), keep, strict=True) if k}
            return {"id": list(made), "own": list(made.values())}

        return map_rows(kept, whole, "id long, own array<long>").join(asked, "id", "left_semi").dropDuplicates(["id"])

    def printed(batch: pa.RecordBatch) -> dict:
        found = {_signed(name_of(words(t), seed)): t for t in texts(batch, "__text")}
        return {"id": list(found), "fingerprint": [simhash.fingerprint(t, shingle) for t in found.values()]}

    prints = stored(map_rows(kept, printed, "id long, fingerprint long").dropDuplicates(["id"]))
    alike = verified(fingerprint_pairs(prints), read_sets)
    forget(prints)
    leads = small.withColumnRenamed("id", "least").alias("l")
    near = shared.where("id != least").select("id", "least").distinct().join(small, "id").alias("d")
    stars = near.join(leads, F.col("d.least") == F.col("l.least")).where(_possible("d", "l"))
    stars = stars.select(F.col("l.least").alias("a"), F.col("d.id").alias("b")).join(alike, ["a", "b"], "left_anti")
    joined = stored(alike.union(verified(stars, read_sets)))
    roots = components(joined, "a", "b").withColumnRenamed("node", "id")
    rooted = stored(shared.select("gram", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    rows = stored(mixed(rooted))
    forget(shared, rooted)
    found, productive = [joined], not rows.isEmpty()
    while productive:
        new = verified(possible(star_pairs(rows, len(found)), small), read_sets)
        found.append(new)
        productive = new.count() * STRAYS >= rows.select("id").distinct().count()
        before, rows = rows, stored(mixed(merged(rows, new)))
        forget(before)
    return reduce(DataFrame.union, [*found, verified(cross_pairs(rows, small), read_sets)])


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of every component, with all columns: that of the smallest key (nulls last); of rows equal in
    all columns one stays. Texts move only where a row's hash is not that of one winner alone."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first, second = free_names(docs, "hash", "more")
    hashed = docs.withColumns({first: F.xxhash64(*columns), second: F.xxhash64(F.lit(1), *columns)})
    kept = hashed.select(F.col(key).alias("__key"), F.col(first).alias("__hash"), F.col(second).alias("__more"), F.col(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()

    def rows_under(seed: int) -> DataFrame:
        def named(batch: pa.RecordBatch) -> dict:
            found = [words(t) for t in texts(batch, "__text")]
            names = {"id": [_signed(name_of(w, seed)) for w in found], "check": [_signed(name_of(w, ~seed & (1 << 64) - 1)) for w in found]}
            return {c: batch.column(c) for c in ("__key", "__hash", "__more")} | names

        return stored(map_rows(kept, named, f"__key {kind}, __hash long, __more long, id long, check long"))

    seed = SEED
    rows = rows_under(seed)
    while not rows.groupBy("id").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b").isEmpty():
        forget(rows)
        seed += 1
        rows = rows_under(seed)
    best = F.min(F.struct(F.col("__key").isNull(), F.col("__key").alias("key"), "__hash", "__more")).alias("best")
    found = components(links(docs, text, shingle, seed), "a", "b").withColumnRenamed("node", "id")
    nodes = rows.groupBy("id").agg(best)
    rooted = nodes.join(found, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best"))
    pair = ["__hash", "__more"]
    winners = stored(rooted.select(*(F.col(f"best.{c}") for c in pair)).distinct())
    # a hash that a losing row or several rows have is settled by a join; all other rows are winners
    lost = rows.join(winners, pair, "left_anti").select("__hash")
    contested = filter_of(stored(lost.union(rows.groupBy("__hash").count().where("count > 1").select("__hash"))), "__hash")

    @F.pandas_udf("boolean")
    def open_(hashes: pd.Series) -> pd.Series:  # texts stay where they are, only hashes go through Python
        return pd.Series(contested.has(hashes.to_numpy()))

    named = winners.withColumnsRenamed({"__hash": first, "__more": second})
    met = hashed.where(open_(F.col(first))).join(named, [first, second], "left_semi").dropDuplicates([first, second])
    out = [F.col(f"`{c}`") for c in docs.columns]
    return hashed.where(~open_(F.col(first))).select(*out).union(met.select(*out))
