"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Vector space: the words most associated with the label among the labelled examples (log-likelihood
ratio of at least `least_ratio`, `least_lift` times as frequent on one side, at most `max_terms` words), weighted by (1 + ln tf) * idf with the
document frequencies of all documents, unit length. Words that say nothing about the label would drown
the similarity, so they are no dimensions.

Index: examples in fixed ranges (blocks); per term and block the postings and their largest weight. The
sum of query weight times block maximum bounds the cosine of every example of a block; blocks are
scored in falling order of the bound until it lies below the kth cosine. The result is the exact k
nearest, ties to the smaller example.

Votes: labels weighted by cosine, drawn towards the base rate by `prior_mass`, then calibrated by a
logistic fit on the examples' own leave-one-out votes. Examples without any dimension are counted apart:
a text without any dimension gets their smoothed rate.

Examples are a bounded sample: at most `max_rows` labelled keys of the training folds, those with the
smallest hash. Terms, index and calibration are bounded by that and by `max_terms`.

Defined results: null and empty texts have no dimension; a key with several labels takes the largest;
several rows of one example key give one example; without labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm.common import map_rows, stored, texts

WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Neighbours:
    """Parameters of the vector space, the index and the votes."""

    k: int = 15
    block: int = 64
    max_terms: int = 1024
    least_ratio: float = 25.0
    least_lift: float = 4.0
    max_rows: int = 20_000
    prior_mass: float = 0.2
    evidence: int = 3


class BlockMaxIndex:
    """Unit vectors of the examples by term and block, with block maxima."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int):
        self.block, self.size = block, len(vectors)
        self.blocks = max(1, -(-len(vectors) // block))
        self.most = np.zeros((terms, self.blocks), np.float64)
        postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for i, vector in enumerate(vectors):
            for term, weight in vector.items():
                postings.setdefault((term, i // block), []).append((i % block, weight))
                self.most[term, i // block] = max(self.most[term, i // block], weight)
        self.postings = {key: (np.array([p for p, _ in rows]), np.array([w for _, w in rows])) for key, rows in postings.items()}

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0: their numbers and cosines."""
        terms = list(query)
        bounds = np.array([query[t] for t in terms]) @ self.most[terms]
        found, cosines, floor = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or bounds[b] + 1e-9 < floor:
                break
            sums = np.zeros(self.block)
            for term in terms:
                if (rows := self.postings.get((term, int(b)))) is not None:
                    sums[rows[0]] += query[term] * rows[1]
            sums = np.round(sums, 12)  # equal vectors are ties, whatever the order of their terms
            hit = np.nonzero((sums > 0) & (sums >= floor))[0]
            hit = hit[hit + b * self.block != without]
            found, cosines = np.concatenate([found, hit + b * self.block]), np.concatenate([cosines, sums[hit]])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            if len(found) == k:
                floor = cosines.min()
        return found, cosines


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    keys: list
    labels: np.ndarray
    rate: float
    empty_rate: float
    slope: float
    shift: float
    p: Neighbours

    def vector(self, terms: list[int], counts: list[int]) -> dict[int, float]:
        weights = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in zip(terms, counts, strict=True)}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        p = self.p
        return float((cosines @ self.labels[found] + p.prior_mass * self.rate) / (cosines.sum() + p.prior_mass))

    def calibrated(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(vote / (1 - vote)) + self.shift)))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        if not terms:
            return self.empty_rate, []
        found, cosines = self.index.nearest(self.vector(terms, counts), self.p.k)
        if not len(found):
            return self.empty_rate, []
        seen = [{"key": self.keys[i], "cosine": float(c), "label": int(self.labels[i])} for i, c in zip(found[: self.p.evidence], cosines, strict=False)]
        return self.calibrated(self.vote(found, cosines)), seen


def _platt(votes: list[float], labels: list[int], rounds: int = 25) -> tuple[float, float]:
    """Logistic fit of labels on the votes' log odds, slightly drawn to (1, 0) so that it always exists."""
    if not votes:
        return 1.0, 0.0
    v = np.clip(np.array(votes), 1e-6, 1 - 1e-6)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
    y, theta, start = np.array(labels, float), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (q - y) + (theta - start)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), gradient)
        theta = theta - step
    return max(float(theta[0]), 0.1), float(theta[1])


def associated_terms(sample: DataFrame, p: Neighbours, text: str = "text", label: str = "__label") -> dict[str, int]:
    """Words associated with the label by document frequency, numbered by falling log-likelihood ratio."""

    def run(batch: pa.RecordBatch) -> dict:
        sides = {0: Counter(), 1: Counter()}
        for one, y in zip(texts(batch, text), batch.column(label).to_pylist(), strict=True):
            sides[y].update(set(WORDS.findall(one.lower())))
        found = list(sides[0].keys() | sides[1].keys())
        return {"term": found, "n0": [sides[0][t] for t in found], "n1": [sides[1][t] for t in found]}

    counts = map_rows(sample.select(text, label), run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = (int(x or 0) for x in sample.agg(F.sum(1 - F.col(label)), F.sum(label)).first())
    if not all0 or not all1:
        return {}
    share = (F.col("n0") + F.col("n1")) / (all0 + all1)

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    ratio = 2 * (
        part(F.col("n0"), share * all0) + part(F.col("n1"), share * all1)
        + part(all0 - F.col("n0"), (1 - share) * all0) + part(all1 - F.col("n1"), (1 - share) * all1)
    )
    lift = ((F.col("n1") + 0.5) / (all1 + 1)) / ((F.col("n0") + 0.5) / (all0 + 1))
    strong = (lift >= p.least_lift) | (lift <= 1 / p.least_lift)
    best = counts.where((F.col("n0") + F.col("n1") > 1) & strong).withColumn("ratio", ratio).where(F.col("ratio") >= p.least_ratio)
    rows = best.orderBy(F.desc(F.round("ratio", 6)), "term").limit(p.max_terms).select("term").collect()
    return {r.term: i for i, r in enumerate(rows)}


def term_counts(docs: DataFrame, terms: dict[str, int], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with the numbers and counts of the terms in every text."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]

    def run(batch: pa.RecordBatch) -> dict:
        counted = [Counter([w for w in WORDS.findall(one.lower()) if w in terms]) for one in texts(batch, "__text")]
        made = [sorted((terms[w], n) for w, n in c.items()) for c in counted]
        return {c: batch.column(c) for c in keep} | {"terms": [[t for t, _ in m] for m in made], "counts": [[n for _, n in m] for m in made]}

    return map_rows(kept, run, ", ".join([*schema, "terms array<int>, counts array<int>"]))


def document_frequencies(counted: DataFrame, terms: int) -> np.ndarray:
    """In how many rows of term counts each term occurs. A task adds its rows up and passes on one number per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = np.zeros(terms)
    if terms:
        for r in counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per term
            found[r.term] = r.n
    return found


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", p: Neighbours = Neighbours()) -> tuple[Model, DataFrame]:  # noqa: B008
    """The model, and the stored term counts of all documents (key, terms, counts)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & is_training).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    chosen = stored(known.orderBy(F.xxhash64(key), key).limit(p.max_rows))
    sample = docs.select(key, text).join(F.broadcast(chosen), key)  # at most max_rows keys
    terms = associated_terms(sample, p, text)
    counted = stored(term_counts(docs, terms, [key], text))
    frequency = document_frequencies(counted, len(terms))
    idf = np.log((1 + counted.count()) / (1 + frequency)) + 1
    examples = counted.join(F.broadcast(chosen), key).groupBy(key).agg(F.min(F.struct("terms", "counts")).alias("v"), F.max("__label").alias("y"))
    rows = sorted(examples.collect(), key=lambda r: r[0])
    empty = [r.y for r in rows if not r.v.terms]
    full = [r for r in rows if r.v.terms]
    rate = sum(r.y for r in rows) / len(rows) if rows else 0.0
    model = Model(terms, idf, BlockMaxIndex([], len(terms), p.block), [r[0] for r in full], np.array([r.y for r in full], float), rate, (sum(empty) + rate) / (len(empty) + 1), 1.0, 0.0, p)
    vectors = [model.vector(r.v.terms, r.v.counts) for r in full]
    model.index = BlockMaxIndex(vectors, len(terms), p.block)
    votes = [model.vote(*model.index.nearest(v, p.k, without=i)) for i, v in enumerate(vectors)]
    model.slope, model.shift = _platt(votes, [r.y for r in full])
    return model, counted


def score(counted: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Key, score and evidence (nearest examples with cosine and label) of every row of term counts."""
    kind = counted.schema[key].dataType.simpleString()
    shared = counted.sparkSession.sparkContext.broadcast(model)  # bounded by max_rows examples and max_terms terms

    def run(batch: pa.RecordBatch) -> dict:
        model, known, made = shared.value, {}, []
        for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            signature = (*terms, -1, *counts)
            if signature not in known:
                known[signature] = model.score(terms, counts)
            made.append(known[signature])
        return {key: batch.column(key), "score": [s for s, _ in made], "evidence": [e for _, e in made]}

    return map_rows(counted.select(key, "terms", "counts"), run, f"`{key}` {kind}, score double, evidence array<struct<key: {kind}, cosine: double, label: int>>")
