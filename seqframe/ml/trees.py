"""M4: extremely randomised trees, grown level by level on Spark.

Every tree sees all rows (no bootstrap). In a node each feature gets one random
cut between its least and largest value there; the feature whose cut reduces the
variance most splits the node. Values are first placed in fine bins with
global quantiles as edges. One pass a level counts rows, sums of y and of y*y
by (tree, node, feature, bin) on the executors; that table holds all that a
level needs: a node's value range, the random cuts' two sides, and the leaves' means.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.ml.models import _Base, _features_array, _JsonParams
from seqframe.ml.optim import summed

#: Numbers that one pass of a level sums in a task at most; more trees or nodes take more passes.
MAX_SUMS = 1 << 24


def bin_edges(d: DataFrame, bins: int) -> np.ndarray:
    """(features x bins - 1): approximate quantiles of every feature over all rows; a value is in the bin of the edges below it."""
    probs = [i / bins for i in range(1, bins)]
    long = d.select(F.posexplode("x").alias("i", "v"))
    got = long.groupBy("i").agg(F.percentile_approx("v", probs, 20 * bins).alias("q")).collect()  # features x bins numbers
    return np.array([r["q"] for r in sorted(got, key=lambda r: r["i"])], float)


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros(x.shape, int)


def place_rows(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The node each row has reached."""
    node = np.zeros(len(bins), np.int64)
    feature, cut, child = tree["feature"], tree["cut"], tree["child"]
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        at = node[inner]
        right = bins[inner, feature[at]] >= cut[at]
        node[inner] = child[at] + right


def random_cuts(table: np.ndarray, seed: int, tree: int, node: int) -> np.ndarray:
    """For each feature a bin at which its right side begins, drawn between the first and last bin with rows; -1 where there is one bin.

    ``table`` is (features, bins, 3). The draw depends on (seed, tree, node) alone.
    """
    u = np.random.default_rng([seed, tree, node]).random(len(table))
    has = table[:, :, 0] > 0
    first, last = has.argmax(1), has.shape[1] - 1 - has[:, ::-1].argmax(1)
    return np.where(last > first, first + 1 + np.floor(u * (last - first)).astype(int), -1)


def best_cut(table: np.ndarray, cuts: np.ndarray) -> tuple[int, float]:
    """(feature, reduction of the sum of squares) of the best of the cuts, the first of equals; -1 without any."""
    total = table[0].sum(0)
    ss = total[2] - total[1] ** 2 / total[0]
    best, gain = -1, 0.0
    for j, c in enumerate(cuts.tolist()):
        if c < 0:
            continue
        left = table[j, :c].sum(0)
        right = total - left
        if left[0] > 0 and right[0] > 0:
            g = ss - (left[2] - left[1] ** 2 / left[0]) - (right[2] - right[1] ** 2 / right[0])
            if g > gain + 1e-12 * max(abs(ss), 1e-300):
                best, gain = j, float(g)
    return best, gain


def _new_tree() -> dict:
    return {"feature": np.array([-1]), "cut": np.array([0]), "child": np.array([0]), "value": np.array([0.0]), "n": np.array([0.0]), "gain": np.array([0.0])}


def _split(tree: dict, node: int, feature: int, cut: int, gain: float) -> int:
    """Give the node two children; returns the left one's number, the right one is the next."""
    left = len(tree["feature"])
    for name, fill in (("feature", -1), ("cut", 0), ("child", 0), ("value", 0.0), ("n", 0.0), ("gain", 0.0)):
        tree[name] = np.append(tree[name], [fill, fill])
    tree["feature"][node], tree["cut"][node], tree["child"][node], tree["gain"][node] = feature, cut, left, gain
    return left


def grow(rows: DataFrame, dim: int, bins: int, edges: np.ndarray, n_trees: int, depth: int, min_rows: int, seed: int) -> list[dict]:
    """``rows`` are (x, y); grown trees with the mean of y in every node."""
    trees = [_new_tree() for _ in range(n_trees)]
    open_nodes = [(k, 0) for k in range(n_trees)]
    width, sc = dim * bins * 3, rows.sparkSession.sparkContext
    for level in range(depth + 1):
        todo, open_nodes = open_nodes, []
        step = max(1, MAX_SUMS // max(width, 1))
        for lo in range(0, len(todo), step):
            own = todo[lo:lo + step]
            sent = sc.broadcast((edges, {k: trees[k] for k in {k for k, _ in own}}, {x: i for i, x in enumerate(own)}))

            def run(batches):
                cuts, known, slot = sent.value
                acc = np.zeros((len(slot), dim * bins, 3))
                for pdf in batches:
                    if not len(pdf):
                        continue
                    y, b = pdf["y"].to_numpy(), to_bins(np.stack(pdf["x"].to_numpy()), cuts)
                    flat = b + np.arange(dim) * bins
                    for k, tree in known.items():
                        node = place_rows(b, tree)
                        at = np.array([slot.get((k, v), -1) for v in range(len(tree["feature"]))])[node]
                        keep = at >= 0
                        cell = (at[keep, None] * (dim * bins) + flat[keep]).ravel()
                        for c, w in enumerate((np.ones(len(y)), y, y * y)):
                            acc[:, :, c] += np.bincount(cell, np.repeat(w[keep], dim), len(slot) * dim * bins).reshape(len(slot), -1)
                return acc.ravel()

            tables = summed(rows, run, len(own) * width).reshape(len(own), dim, bins, 3)
            sent.unpersist()
            for (k, node), table in zip(own, tables):
                n, y, yy = table[0].sum(0)
                tree = trees[k]
                tree["n"][node], tree["value"][node] = n, y / n if n else 0.0
                if level < depth and n >= 2 * min_rows and yy - y * y / n > 1e-12 * max(yy, 1e-300):
                    cuts = random_cuts(table, seed, k, node)
                    feature, gain = best_cut(table, cuts)
                    if feature >= 0:
                        left = _split(tree, node, feature, int(cuts[feature]), gain)
                        open_nodes += [(k, left), (k, left + 1)]
        if not open_nodes:
            break
    return trees


class RandomTrees(Estimator, _Base, DefaultParamsReadable, DefaultParamsWritable):
    """Extremely randomised regression trees. A node with fewer than twice
    ``minRows`` rows, of equal labels or without a cut that helps is a leaf."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature's values", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "rows of a leaf that allow a split to be tried", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees=100, maxDepth=8, maxBins=64, minRows=1, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=8, maxBins=64, minRows=1, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        d = df.select(_features_array(df, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
        edges = bin_edges(d, self.getOrDefault(self.maxBins))
        trees = grow(d, len(edges), self.getOrDefault(self.maxBins), edges, self.getOrDefault(self.numTrees), self.getOrDefault(self.maxDepth),
                     self.getOrDefault(self.minRows), self.getSeed())
        d.unpersist()
        m = RandomTreesModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        m._set_state({"edges": edges.tolist(), "trees": [{k: v.tolist() for k, v in t.items()} for t in trees]})
        return m


class RandomTreesModel(Model, _Base, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """``prediction``: mean over the trees of the leaf's mean label."""

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def trees(self) -> list[dict]:
        return [{k: np.array(v) for k, v in t.items()} for t in self._state()["trees"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        edges, sent = np.array(self._state()["edges"]), df.sparkSession.sparkContext.broadcast(self.trees())

        @F.pandas_udf("double")
        def predict(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            b = to_bins(np.stack(xs.to_numpy()), edges)
            return pd.Series(np.mean([t["value"][place_rows(b, t)] for t in sent.value], axis=0))

        return df.withColumn(self.getPredictionCol(), predict(_features_array(df, self.getFeaturesCol())))
