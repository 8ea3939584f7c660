"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are single words and pairs of neighbouring words, hashed into 2^bits places. A word is a
run of letters and digits or a run of other signs, so marks glued to a word are words of their own.
All pairs of a word with itself share one place, so repetition counts whatever the word is.
A place's value is its share of the text's features times `SCALE`; a score is the sigmoid of the
sparse dot product of values and weights plus a bias.

Training reads a bounded sample: at most `max_rows` labelled rows of the training folds (all, if
there are fewer), those with the smallest hash of their key. They are read `epochs` times in hash order by one
task that makes FTRL-Proximal updates; only the weights that differ from zero leave it. Weights are
bounded by 2^bits numbers.

Defined results: a null or empty text has only the bias; a key with several labels takes the smallest;
null labels are left out; without any labelled row every score is `PRIOR`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cyclelake.llm.common import free_names, in_arrow, map_rows, sliced, stored, texts

TOKENS = re.compile(r"\w+|[^\w\s]+")
SCALE = 40.0
PRIOR = 0.5
REPEATED = 0x5EED
HASH_CACHE = 100_000
_hashes: dict[str, int] = {}


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the FTRL-Proximal update, of the feature space and of the training sample."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 2
    max_rows: int = 20_000


def features(text: str, bits: int) -> np.ndarray:
    """Places of all words and neighbouring pairs of a text, repeats included."""
    tokens = TOKENS.findall(text)
    if len(_hashes) > HASH_CACHE:
        _hashes.clear()
    known = _hashes
    out = np.empty(len(tokens), np.uint64)
    for i, token in enumerate(tokens):
        value = known.get(token)
        if value is None:
            value = known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        out[i] = value
    pairs = (out[:-1] * np.uint64(0x9E3779B1) + out[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    pairs[out[:-1] == out[1:]] = REPEATED
    return (np.concatenate([out, pairs]) & np.uint64(2**bits - 1)).astype(np.int64)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: Iterable[tuple[str, int]], p: Ftrl) -> np.ndarray:
    """Weights after one update for each row, in order; the last weight is the bias."""
    size = 2**p.bits + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return -np.sign(zi) * np.maximum(np.abs(zi) - p.l1, 0) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for text, label in rows:
        at, counts = np.unique(features(text, p.bits), return_counts=True)
        at, x = np.append(at, size - 1), np.append(counts * (SCALE / max(1, counts.sum())), 1.0)
        w = weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
        z[at] += g - sigma * w
        n[at] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, label: str = "quality", key: str = "doc_id", text: str = "text", p: Ftrl = Ftrl()) -> np.ndarray:  # noqa: B008
    """Weights learned from labelled rows for which `is_training` (a condition on the key) holds."""
    order = F.xxhash64(key)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & is_training).groupBy(key).agg(F.min(label).cast("int").alias("__label"))
    chosen = known.orderBy(order, key).limit(p.max_rows)
    sample = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)  # at most max_rows keys
    tie = F.crc32(F.coalesce("__text", F.lit("")).cast("binary"))
    read = stored(sample.select(order.alias("place"), tie.alias("tie"), "__text", "__label"))
    ordered = read.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(p.epochs)))).coalesce(1).sortWithinPartitions("epoch", "place", "tie", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = train((r for b in sliced(batches) for r in zip(texts(b, "__text"), b.column("__label").to_pylist(), strict=True)), p)
        at = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "weight"])

    learned = in_arrow(ordered, run, "at long, weight double").toArrow()
    w = np.zeros(2**p.bits + 1)
    w[learned.column("at").to_numpy()] = learned.column("weight").to_numpy()
    return w


def score(docs: DataFrame, w: np.ndarray, keep: list[str], name: str = "score", text: str = "text", p: Ftrl = Ftrl()) -> DataFrame:  # noqa: B008
    """The kept columns and the score (probability of label 1) of every row."""
    (hidden,) = free_names(docs, "__text")
    kept = docs.select(*keep, F.col(text).alias(hidden))
    schema = StructType([*kept.schema.fields[:-1], StructField(name, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(w)  # 2^bits + 1 numbers

    def run(batch: pa.RecordBatch) -> dict:
        weights, margins = shared.value, []
        for one in texts(batch, hidden):
            at = features(one, p.bits)
            margins.append(weights[-1] + (SCALE * weights[at].mean() if len(at) else 0.0))
        scores = sigmoid(np.array(margins, float)) if weights.any() else np.full(len(margins), PRIOR)
        return {c: batch.column(c) for c in keep} | {name: scores}

    return map_rows(kept, run, schema)
