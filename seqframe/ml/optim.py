"""Data-parallel gradient optimisation shared by the custom estimators.

Each step broadcasts the parameter vector, every task computes the summed
gradient and loss of its rows (numpy over Arrow batches in ``mapInPandas``),
and ``summed`` adds the task results on the executors, in pieces and in two
levels, so that no task receives a vector from every partition. Only
the parameter-sized sum reaches the driver, where Adam updates the vector.
The per-row data never leaves the executors; the training table is persisted
once, dealt to its mini-batches once, and a lost executor recomputes its
partitions from the lineage.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.hashing import stable_uniform

# grad_fn(params, X, y, extra) -> (summed gradient, summed loss)
GradFn = Callable[[np.ndarray, np.ndarray, np.ndarray, dict], tuple[np.ndarray, float]]


@dataclass
class Adam:
    lr: float = 1e-2
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def step(self, w: np.ndarray, g: np.ndarray, lr: float | None = None) -> np.ndarray:
        if self.m is None:
            self.m, self.v = np.zeros_like(w), np.zeros_like(w)
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        mh = self.m / (1 - self.beta1 ** self.t)
        vh = self.v / (1 - self.beta2 ** self.t)
        return w - (self.lr if lr is None else lr) * mh / (np.sqrt(vh) + self.eps)


#: Numbers of a vector that are summed as one piece.
PIECE = 1 << 15


def summed(rows: DataFrame, run: Callable, size: int) -> np.ndarray:
    """The sum over all partitions of ``run(batches)``, a vector of ``size`` numbers.

    Each partition's vector is cut in pieces; pieces are added in about
    sqrt(P) groups of partitions first, then over the groups.
    """
    parts = max(1, rows.rdd.getNumPartitions())
    groups = max(1, math.ceil(math.sqrt(parts)))

    def pieces(batches):
        v, group = run(batches), TaskContext.get().partitionId() % groups
        at = range(0, size, PIECE)
        yield pd.DataFrame({"piece": list(range(len(at))), "grp": group, "v": [v[i:i + PIECE].tolist() for i in at]})

    x = rows.mapInPandas(pieces, "piece int, grp int, v array<double>").withColumn("v", array_to_vector("v"))
    if groups > 2:
        x = x.groupBy("piece", "grp").agg(Summarizer.sum(F.col("v")).alias("v"))
    got = x.groupBy("piece").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    if not got:
        return np.zeros(size)
    return np.concatenate([r["v"].toArray() for r in sorted(got, key=lambda r: r["piece"])])


def stacked(arrays: pd.Series) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    rows = arrays.to_numpy()
    if len(set(map(len, rows))) > 1:
        raise ValueError("all rows must have the same number of values")
    return np.concatenate(rows).reshape(len(rows), -1)


@dataclass
class TrainingTable:
    """A persisted (features x, labels y ARRAY<DOUBLE>, u) table ready for repeated passes.

    ``u`` is a stable uniform per row that deals it to a mini-batch: batch b of
    B takes rows with floor(u * B) == b.
    """
    df: DataFrame
    dim: int
    n: int
    extra: dict = field(default_factory=dict)
    dealt: dict[int, list[DataFrame]] = field(default_factory=dict)

    def batches(self, count: int) -> list[DataFrame]:
        """The table dealt to ``count`` persisted batches; each row is in one of them, so an epoch reads it once."""
        if count <= 1:
            return [self.df]
        if count not in self.dealt:
            of = F.floor(F.col("u") * count)
            self.dealt[count] = [self.df.where(of == b).persist(StorageLevel.MEMORY_AND_DISK) for b in range(count)]
        return self.dealt[count]

    def unpersist(self):
        for tables in self.dealt.values():
            for t in tables:
                t.unpersist()
        self.df.unpersist()


def prepare(df: DataFrame, features: str, label: str, key: str | None = None, seed: int = 0) -> TrainingTable:
    """``u`` follows the key, or without one the row's own numbers: it is the same when a partition is computed again."""
    is_arr = df.schema[label].dataType.simpleString().startswith("array")
    y = F.col(label).cast("array<double>") if is_arr else F.array(F.col(label).cast("double"))
    x = F.col(features).cast("array<double>")
    u = stable_uniform(seed, key) if key else F.shiftrightunsigned(F.xxhash64(F.lit(seed), x, y), 11) / F.lit(float(1 << 53))
    t = df.select(x.alias("x"), y.alias("y"), u.alias("u")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    return TrainingTable(t, int(stats["d"] or 0), int(stats["n"]))


def gradient(table: TrainingTable, params: np.ndarray, grad_fn: GradFn, extra: dict | None = None,
             batch: tuple[int, int] | None = None) -> tuple[np.ndarray, float, int]:
    """Summed gradient, summed loss and row count over the table (or over
    mini-batch ``batch=(b, B)``), computed on the executors. ``grad_fn`` finds
    its partition's number and a count of the chunks before in ``extra["at"]``."""
    rows = table.df if batch is None else table.batches(batch[1])[batch[0]]
    bc = table.df.sparkSession.sparkContext.broadcast((params, extra or {}))
    k = len(params)

    def run(batches):
        w, ex = bc.value
        acc, part = np.zeros(k + 2), TaskContext.get().partitionId()
        for i, pdf in enumerate(batches):
            if len(pdf):
                g, loss = grad_fn(w, stacked(pdf["x"]), stacked(pdf["y"]), dict(ex, at=(part, i)))
                acc[:k] += g
                acc[k:] += loss, len(pdf)
        return acc

    s = summed(rows, run, k + 2)
    bc.unpersist()
    return s[:k], float(s[k]), int(s[k + 1])


def minimize(table: TrainingTable, w0: np.ndarray, grad_fn: GradFn, *, epochs: int = 50, batches: int = 1,
             lr: float = 1e-2, l2: float = 0.0, extra: dict | None = None,
             schedule: Callable[[int], float] | None = None,
             on_epoch: Callable[[int, np.ndarray, float], bool] | None = None) -> tuple[np.ndarray, list[float]]:
    """Adam over mean loss (+ l2/2 ||w||^2). ``on_epoch(epoch, w, loss)``
    may return True to stop (early stopping). Returns (w, epoch losses)."""
    opt = Adam(lr=lr)
    w = w0.astype(float).copy()
    history = []
    step = 0
    for ep in range(epochs):
        tot, cnt = 0.0, 0
        for b in range(batches):
            g, loss, n = gradient(table, w, grad_fn, dict(extra or {}, step=step), (b, batches) if batches > 1 else None)
            if n == 0:
                continue
            g = g / n + l2 * w
            w = opt.step(w, g, schedule(step) if schedule else None)
            step += 1
            tot += loss
            cnt += n
        history.append(tot / max(cnt, 1))
        if on_epoch is not None and on_epoch(ep + 1, w, history[-1]):
            break
    return w, history
