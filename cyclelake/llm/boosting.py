"""Boosted regression trees for the logistic loss, on arrays or on a stored table of any size.

Trees are grown level by level on histograms, sums of gradients and Hessians by node, feature and bin. Over a table the tasks
add them up, one job a level; the driver sees the sums and the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cyclelake.llm.common import in_arrow


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner node i has children 2i+1 and 2i+2; values are those of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray, level: int) -> np.ndarray:
        """Which node of a level each row is in, from 0."""
        node = np.zeros(len(x), np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return node - (2**level - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x, (len(self.feature) + 1).bit_length() - 1)]


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((tree(x) for tree in self.trees), np.zeros(len(x)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], 1)


def sums(x: np.ndarray, slots: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, tree: Tree, level: int, bins: int) -> np.ndarray:
    """Sums of gradients and of Hessians by node, feature and bin of a level; by node alone at the leaves."""
    p, node, features = sigmoid(margin), tree.place(x, level), x.shape[1]
    gradient, hessian = weight * (p - y), weight * p * (1 - p)
    if 2**level > len(tree.feature):
        return np.stack([np.bincount(node, v, 2**level) for v in (gradient, hessian)])
    slot = ((node[:, None] * features + np.arange(features)) * bins + slots).ravel()
    return np.stack([np.bincount(slot, np.repeat(v, features), 2**level * features * bins) for v in (gradient, hessian)])


def grow(
    added: Callable[[list[Tree], Tree, int], np.ndarray], start: float, edges: list[np.ndarray], rounds: int, depth: int, rate: float, l2: float, bins: int
) -> Boosted:
    """Trees from `added(trees so far, tree at work, level)`, the sums over all rows."""
    features, trees = len(edges), []
    for _ in range(rounds):
        tree = Tree(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth))
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            g, h = (v.reshape(nodes, features, bins).cumsum(2) for v in added(trees, tree, level))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            flat, whole = gain.reshape(nodes, -1), (all_g**2 / (all_h + l2)).max((1, 2))
            most = flat.max(1)
            # the first of equal gains, which differ in their last digits by the order in which rows were summed
            best = (flat >= (most - 1e-9 * (np.abs(most) + whole))[:, None]).argmax(1)
            for i, at in enumerate(best):
                f, b = divmod(int(at), bins)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    tree.feature[first + i], tree.cut[first + i] = f, edges[f][b]
        g, h = added(trees, tree, depth)
        trees.append(Tree(tree.feature, tree.cut, -rate * g / (h + l2)))
    return Boosted(start, trees)


def _start(share: float) -> float:
    share = float(np.clip(share, 1e-4, 1 - 1e-4))
    return float(np.log(share / (1 - share)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, bins: int = 32, weight: np.ndarray | None = None
) -> Boosted:
    """Trees of the rows of x; a row of weight n counts as n rows."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    slots, start = binned(x, edges), _start(np.average(y, weights=weight))
    margins = [np.full(len(y), start)]

    def added(trees: list[Tree], tree: Tree, level: int) -> np.ndarray:
        for done in trees[len(margins) - 1 :]:
            margins.append(margins[-1] + done(x))
            margins[-2] = np.empty(0)
        return sums(x, slots, y, weight, margins[-1], tree, level, bins)

    return grow(added, start, edges, rounds, depth, rate, l2, bins)


def edges_of(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """The bin edges `fit` takes of arrays, from the counts of each feature's values."""
    counted = rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").count()
    own = Window.partitionBy("feature")  # a row per distinct value
    placed = counted.withColumn("last", F.sum("count").over(own.orderBy("value"))).withColumn("n", F.sum("count").over(own))
    ranks = F.array(*[F.floor(F.lit(float(q)) * (F.col("n") - 1)) for q in np.linspace(0, 1, bins + 1)[1:-1]])
    picked = placed.where(F.exists(ranks, lambda r: (r >= F.col("last") - F.col("count")) & (r < F.col("last"))))
    edges: dict[int, list[float]] = {}
    for r in picked.select("feature", "value").collect():  # fewer than `bins` a feature
        edges.setdefault(r.feature, []).append(r.value)
    return [np.array(sorted(edges[f]), float) for f in sorted(edges)]


def columns_of(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and weight of a batch."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, features)
    y, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight"))
    return x, y, weight


def fit_rows(rows: DataFrame, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, bins: int = 32) -> Boosted:
    """`fit` of all rows of a stored table (x array<float>, y, weight); a task holds one batch, a job makes one level."""
    edges = edges_of(rows, bins)
    features = len(edges)
    whole = rows.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("y")).alias("ones")).first()
    start = _start(whole.ones / whole.n)

    def added(trees: list[Tree], tree: Tree, level: int) -> np.ndarray:
        length = 2**level * (features * bins if level < depth else 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, length))
            for batch in batches:
                x, y, weight = columns_of(batch, features)
                margin = np.full(len(y), start)
                for done in trees:
                    margin = margin + done(x)
                total += sums(x, binned(x, edges), y, weight, margin, tree, level, bins)
            at = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["slot", "g", "h"])

        out = np.zeros((2, length))
        made = in_arrow(rows.select("x", "y", "weight"), run, "slot long, g double, h double")
        for r in made.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # at most `length` rows
            out[:, r.slot] = r.g, r.h
        return out

    return grow(added, start, edges, rounds, depth, rate, l2, bins)
