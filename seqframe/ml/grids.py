"""Grids of models fitted together, over plain or nested folds (H1, H5, H6 for M1, M2, M3).

A training set is a pair (o, i): the rows whose fold in round o is neither i
nor -1; it is scored on the rows whose fold is i. A plain k-fold run has one round. A
nested run has a round for each outer fold, in which the outer test rows have
fold -1 and the others an inner fold; the set (o, -1) trains on all the
others and is scored on the outer test rows. Every row carries its folds as one short
array, so no row is copied, and key and texts stay behind.

All candidates and training sets share their passes over the rows:

* the scalers of all sets come from one pass;
* kernel regression (``svr_grid``): a pass makes the random features of a
  set and gamma once for every C and epsilon, and one step's gradients of all
  models are one vector;
* Gaussian process (``gp_grid``): the restarts of a smaller candidate are the
  first ones of a larger, and all restarts of all sets move together;
* Lasso (``lasso_grid``): X'X and X'y by fold are summed in column blocks on the executors,
  and each set's coefficients for all alphas are found there by coordinate descent.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.hashing import stable_hash
from seqframe.ml import gp
from seqframe.ml.models import _rff
from seqframe.ml.optim import Adam, summed
from seqframe.operators import metrics as mt
from seqframe.operators.relational import attach_row
from seqframe.operators.selection import _hash, hash_cuts
from seqframe.operators.split import kfold
from seqframe.session import cut_lineage, literal_table

#: Numbers that one pass sums in a task at most (256 MB); more training sets take more passes.
MAX_SUMS = 1 << 25


@dataclass
class FoldSets:
    rows: DataFrame  # key, x, y, f
    sets: list[tuple[int, int]]
    dim: int
    n: np.ndarray  # rows of each set's training part
    mu: np.ndarray  # sets x dim
    sd: np.ndarray
    y_mu: np.ndarray
    y_sd: np.ndarray

    def unpersist(self):
        self.rows.unpersist()


def train_mask(f: np.ndarray, o: int, i: int) -> np.ndarray:
    return (f[:, o] != -1) & (f[:, o] != i)


def test_mask(f: np.ndarray, o: int, i: int) -> np.ndarray:
    return f[:, o] == i


def _arrays(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), np.stack(pdf["f"].to_numpy())


def nested_folds(df: DataFrame, key: str, k: int, seed: int, inner_seed: int, out: str = "f") -> DataFrame:
    """``df`` with an array of k folds: at o, -1 for rows of outer fold o, else the inner fold of an exact k-fold of the others.

    The inner folds are cut from keys alone: k groups of hash cuts, attached as one row.
    """
    d = kfold(df, key, k, seed, out="_outer")
    rounds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: o != F.col("_outer")))
    keys = d.select(F.col(key), rounds.alias("_o"))
    def ends(n):
        q, r = F.floor(n / F.lit(k)).cast("bigint"), (n % F.lit(k)).cast("bigint")
        return [F.lit(i) * q + F.least(F.lit(i), r) for i in range(1, k)]
    cuts = hash_cuts(keys, key, inner_seed, ends, ["_o"]).select("_o", F.array(*[f"t{i}" for i in range(k - 1)]).alias("c"))
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_o", "c"))).alias("_cuts"))  # k entries
    here = F.struct(_hash(key, inner_seed).alias("h"), F.col(key).alias("k"))
    def fold(o):
        past = F.filter(F.element_at("_cuts", o), lambda t: t.isNull() | (here > t))
        return F.when(F.col("_outer") == o, F.lit(-1)).otherwise(F.size(past))
    return attach_row(d, cuts).withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), fold)).drop("_cuts", "_outer")


def fold_sets(df: DataFrame, key: str, k: int = 5, seed: int = 42, features: str = "features", label: str = "label",
              nested: bool = False, inner_seed: int = 43) -> FoldSets:
    """Key, features, label and folds persisted, with every training set's scaler (population std, 0 -> 1)."""
    d = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    d = nested_folds(d, "key", k, seed, inner_seed) if nested else kfold(d, "key", k, seed, out="_fold").withColumn("f", F.array("_fold"))
    d = d.select("key", "x", "y", "f").persist(StorageLevel.MEMORY_AND_DISK)
    dim = d.agg(F.max(F.size("x"))).first()[0] or 0
    sets = [(o, i) for o in range(k if nested else 1) for i in [*range(k), *([-1] if nested else [])]]
    width = 2 * dim + 3

    def run(batches):
        acc = np.zeros((len(sets), width))
        for pdf in batches:
            if len(pdf):
                x, y, f = _arrays(pdf)
                for s, (o, i) in enumerate(sets):
                    own = train_mask(f, o, i)
                    xs, ys = x[own], y[own]
                    acc[s] += np.concatenate([[own.sum(), ys.sum(), ys @ ys], xs.sum(0), (xs * xs).sum(0)])
        return acc.ravel()

    a = summed(d, run, len(sets) * width).reshape(len(sets), width)
    n = np.maximum(a[:, 0], 1)[:, None]
    mu = a[:, 3:3 + dim] / n
    var = np.maximum(a[:, 3 + dim:] / n - mu * mu, 0)
    # a constant column's variance is rounding noise next to its square
    sd = np.where(var > 1e-12 * np.maximum(mu * mu, 1e-300), np.sqrt(var), 1.0)
    y_mu = a[:, 1] / n[:, 0]
    y_var = np.maximum(a[:, 2] / n[:, 0] - y_mu ** 2, 0)
    return FoldSets(d, sets, dim, a[:, 0], mu, sd, y_mu, np.where(y_var > 0, np.sqrt(y_var), 1.0))


def _scored(t: FoldSets, spark: SparkSession, predict, n_candidates: int, metric: str) -> np.ndarray:
    """Scores (sets x candidates) of ``predict(set, scaled x)`` -> (rows, candidates) on the sets' test rows, in one grouped pass."""
    sets, mu, sd = t.sets, t.mu, t.sd

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, f = _arrays(pdf)
            for s, (o, i) in enumerate(sets):
                own = test_mask(f, o, i)
                if own.any():
                    p = predict(s, (x[own] - mu[s]) / sd[s])
                    yield pd.DataFrame({"s": np.int32(s), "c": np.tile(np.arange(n_candidates, dtype=np.int32), own.sum()),
                                        "y": np.repeat(y[own], n_candidates), "p": p.ravel()})

    preds = cut_lineage(t.rows.mapInPandas(run, "s int, c int, y double, p double"))
    out = np.full((len(sets), n_candidates), np.nan)
    for r in mt.score(preds, metric, "y", "p", ["s", "c"], "v").collect():  # sets x candidates numbers
        out[r["s"], r["c"]] = np.nan if r["v"] is None else r["v"]
    return out


# --- kernel regression -------------------------------------------------------

def svr_grid(t: FoldSets, candidates: list[dict], metric: str = "spearman", n_components: int = 256, epochs: int = 15,
             lr: float = 0.01, seed: int = 42) -> np.ndarray:
    """Scores (sets x candidates) of kernel regressions with numeric gamma, C and epsilon, all fitted together.

    Every model is the one that ``KernelSVR`` fits alone on the scaled training
    rows: the same random features, ridge start and Adam steps.
    """
    gammas = sorted({float(c["gamma"]) for c in candidates})
    own = [[j for j, c in enumerate(candidates) if float(c["gamma"]) == g] for g in gammas]
    rng, dim, k = np.random.default_rng(seed), t.dim, n_components
    w0 = rng.normal(0.0, 1.0, size=(dim, k))
    b = rng.uniform(0, 2 * np.pi, size=k)
    sets, mu, sd, n = t.sets, t.mu, t.sd, np.maximum(t.n, 1)
    eps = [np.array([float(candidates[j]["epsilon"]) for j in js]) for js in own]
    sc = t.rows.sparkSession.sparkContext
    fixed = sc.broadcast((w0, b))
    root = math.sqrt(2.0 / k)

    def features(x, g):
        fw, fb = fixed.value
        return _rff(x, math.sqrt(2 * g) * fw, fb)

    def ridge(first, last):
        def run(batches):
            acc = np.zeros((last - first, len(gammas), (k + 1) * (k + 2)))
            for pdf in batches:
                if len(pdf):
                    x, y, f = _arrays(pdf)
                    for s in range(first, last):
                        rows = train_mask(f, *sets[s])
                        xs = (x[rows] - mu[s]) / sd[s]
                        for gi, g in enumerate(gammas):
                            z = np.hstack([features(xs, g), np.ones((len(xs), 1))])
                            acc[s - first, gi] += np.concatenate([(z.T @ z).ravel(), z.T @ y[rows]])
            return acc.ravel()
        return summed(t.rows, run, (last - first) * len(gammas) * (k + 1) * (k + 2)).reshape(last - first, len(gammas), -1)

    weights = [np.zeros((len(sets), k + 1, len(js))) for js in own]
    step = max(1, MAX_SUMS // (len(gammas) * (k + 1) * (k + 2)))
    l2 = [np.array([[1.0 / (float(candidates[j]["C"]) * n[s]) for j in js] for s in range(len(sets))]) for js in own]
    for first in range(0, len(sets), step):
        last = min(first + step, len(sets))
        a = ridge(first, last)
        for s in range(first, last):
            for gi, js in enumerate(own):
                gram = a[s - first, gi, :(k + 1) ** 2].reshape(k + 1, k + 1) / n[s]
                for c in range(len(js)):
                    reg = np.eye(k + 1) * max(l2[gi][s, c], 1e-6)
                    reg[-1, -1] = 0.0
                    weights[gi][s, :, c] = np.linalg.solve(gram + reg + 1e-9 * np.eye(k + 1), a[s - first, gi, (k + 1) ** 2:] / n[s])
    shapes = [w.shape for w in weights]
    ends = np.cumsum([w.size for w in weights])
    flat = np.concatenate([w.ravel() for w in weights])
    decay = np.concatenate([np.broadcast_to(x[:, None, :], shape).ravel() for x, shape in zip(l2, shapes)])
    rows_of = np.concatenate([np.broadcast_to(n[:, None, None], shape).ravel() for shape in shapes])

    def split(v):
        return [p.reshape(shape) for p, shape in zip(np.split(v, ends[:-1]), shapes)]

    opt = Adam(lr=lr)
    for _ in range(epochs):
        sent = sc.broadcast(flat)

        def run(batches):
            now = split(sent.value)
            acc = [np.zeros(shape) for shape in shapes]
            for pdf in batches:
                if not len(pdf):
                    continue
                x, y, f = _arrays(pdf)
                for s, (o, i) in enumerate(sets):
                    rows = train_mask(f, o, i)
                    xs, ys = (x[rows] - mu[s]) / sd[s], y[rows][:, None]
                    for gi, g in enumerate(gammas):
                        z, w = features(xs, g), now[gi][s]
                        r = z @ w[:-1] + w[-1] - ys
                        sign = np.sign(r) * (np.abs(r) > eps[gi])
                        acc[gi][s, :-1] += z.T @ sign
                        acc[gi][s, -1] += sign.sum(0)
            return np.concatenate([a.ravel() for a in acc])

        flat = opt.step(flat, summed(t.rows, run, len(flat)) / rows_of + decay * flat)
        sent.unpersist()
    sent = sc.broadcast(flat)

    def predict(s, xs):
        out, now = np.zeros((len(xs), len(candidates))), split(sent.value)
        for gi, (g, js) in enumerate(zip(gammas, own)):
            w = now[gi][s]
            out[:, js] = features(xs, g) @ w[:-1] + w[-1]
        return out

    return _scored(t, t.rows.sparkSession, predict, len(candidates), metric)


# --- Gaussian process --------------------------------------------------------

def gp_grid(t: FoldSets, candidates: list[dict], metric: str = "spearman", n_inducing: int = 64, steps: int = 10, seed: int = 42) -> np.ndarray:
    """Scores (sets x candidates) of Gaussian processes with 1 to ``n_restarts_optimizer`` restarts, all fitted together.

    Each set's inducing rows are its training rows with the lowest key hashes, as ``SparseGP`` takes them.
    """
    wanted = [int(c["n_restarts_optimizer"]) for c in candidates]
    hashed = t.rows.select("x", "f", stable_hash(seed, "key").alias("h"), "key")
    inducing = []
    for s, (o, i) in enumerate(t.sets):
        own = hashed.where((F.col("f")[o] != -1) & (F.col("f")[o] != i)).orderBy("h", "key").limit(n_inducing).select("x").collect()
        inducing.append((np.array([r["x"] for r in own]).reshape(len(own), t.dim) - t.mu[s]) / t.sd[s])
    mu, sd, y_mu, y_sd, sets = t.mu, t.sd, t.y_mu, t.y_sd, t.sets

    def parts(pdf):
        x, y, f = _arrays(pdf)
        for s, (o, i) in enumerate(sets):
            rows = train_mask(f, o, i)
            yield s, (x[rows] - mu[s]) / sd[s], (y[rows] - y_mu[s]) / y_sd[s]

    trails = gp.restarts(t.rows, parts, inducing, t.n, max(wanted), steps, seed, MAX_SUMS, least=min(wanted))
    fits = [[gp.best(own[:r]) for r in wanted] for own in trails]
    sent = t.rows.sparkSession.sparkContext.broadcast([[(x.length, x.alpha) for x in own] for own in fits])
    z = t.rows.sparkSession.sparkContext.broadcast(inducing)

    def predict(s, xs):
        return np.stack([gp.rbf(xs, z.value[s], length) @ alpha for length, alpha in sent.value[s]], 1) * y_sd[s] + y_mu[s]

    return _scored(t, t.rows.sparkSession, predict, len(candidates), metric)


# --- Lasso -------------------------------------------------------------------

BLOCK = 512


def _gram_blocks(t: FoldSets, rounds: list[int], folds: list[int]) -> DataFrame:
    """(o, v, i, j, m): for the rows of fold v in round o, block (i, j), i <= j, of [x 1 y]'[x 1 y], summed on the executors."""
    d = t.dim + 2
    at = [(lo, min(lo + BLOCK, d)) for lo in range(0, d, BLOCK)]

    def run(batches):
        acc = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, f = _arrays(pdf)
            a = np.hstack([x, np.ones((len(x), 1)), y[:, None]])
            for o in rounds:
                for v in folds:
                    own = a[f[:, o] == v]
                    if len(own):
                        for i, (lo, hi) in enumerate(at):
                            for j, (lo2, hi2) in enumerate(at[i:], i):
                                m = own[:, lo:hi].T @ own[:, lo2:hi2]
                                if (o, v, i, j) in acc:
                                    acc[o, v, i, j] += m
                                else:
                                    acc[o, v, i, j] = m
        for (o, v, i, j), m in acc.items():
            yield pd.DataFrame({"o": [o], "v": [v], "i": [i], "j": [j], "m": [m.astype("<f8").tobytes()]})

    parts = t.rows.mapInPandas(run, "o int, v int, i int, j int, m binary")

    def add(pdf):
        m = sum(np.frombuffer(b, "<f8") for b in pdf["m"])
        return pdf.iloc[:1].assign(m=[m.tobytes()])

    groups = max(1, math.ceil(math.sqrt(t.rows.rdd.getNumPartitions())))
    if groups > 2:  # in groups of partitions first
        cols = ["o", "v", "i", "j"]
        parts = parts.withColumn("g", F.spark_partition_id() % groups).groupBy("g", *cols).applyInPandas(
            lambda pdf: add(pdf)[[*cols, "m"]], "o int, v int, i int, j int, m binary")
    return parts.groupBy("o", "v", "i", "j").applyInPandas(add, "o int, v int, i int, j int, m binary")


def descend(c: np.ndarray, xy: np.ndarray, alphas: list[float], sweeps: int = 2000, tol: float = 1e-9) -> list[np.ndarray]:
    """Lasso coefficients for each alpha (objective w'Cw/2 - xy'w + alpha |w|_1), by coordinate descent with warm starts.

    Sweeps go over the coordinates that are not zero; the others are entered where their gradient exceeds alpha.
    """
    d, out, w = len(xy), {}, np.zeros(len(xy))
    diag, grad = np.diag(c).copy(), xy.copy()  # grad = xy - C w
    free = diag > 1e-12
    for a in sorted(set(alphas), reverse=True):
        active = free & ((w != 0) | (np.abs(grad) > a))
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(active).tolist():
                rho = grad[j] + diag[j] * w[j]
                new = math.copysign(max(abs(rho) - a, 0.0), rho) / diag[j]
                if new != w[j]:
                    grad -= c[:, j] * (new - w[j])
                    moved = max(moved, abs(new - w[j]) * math.sqrt(diag[j]))
                    w[j] = new
            if moved < tol:
                more = free & ~active & (np.abs(grad) > a + tol)
                if not more.any():
                    break
                active |= more
        out[a] = w.copy()
    return [out[a] for a in alphas]


def lasso_models(t: FoldSets, alphas: list[float]) -> DataFrame:
    """(s, w): every training set's coefficients for all alphas (alphas x (dim + 1), the intercept last, as bytes).

    They apply to features scaled by the set's own mean and population std.
    A set's Gram matrix exists in one task at a time, never on the driver.
    """
    folds = sorted({i for _, i in t.sets})
    rounds = sorted({o for o, _ in t.sets})
    d, sets = t.dim, t.sets
    per_pass = max(1, MAX_SUMS // (len(folds) * (d + 2) ** 2))
    by_round = {o: [(s, i) for s, (oo, i) in enumerate(sets) if oo == o] for o in rounds}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((d + 2, d + 2))
        for i, j, m in zip(pdf["i"], pdf["j"], pdf["m"]):
            lo, lo2 = i * BLOCK, j * BLOCK
            hi, hi2 = min(lo + BLOCK, d + 2), min(lo2 + BLOCK, d + 2)
            own = np.frombuffer(m, "<f8").reshape(hi - lo, hi2 - lo2)
            g[lo:hi, lo2:hi2] += own
            if i != j:
                g[lo2:hi2, lo:hi] += own.T
        n = max(g[d, d], 1.0)
        mu, y_mu = g[:d, d] / n, g[d, d + 1] / n
        cov = g[:d, :d] / n - np.outer(mu, mu)
        var = np.maximum(np.diag(cov), 0)
        sd = np.where(var > 1e-12 * np.maximum(mu * mu, 1e-300), np.sqrt(var), 1.0)
        xy = (g[:d, d + 1] / n - mu * y_mu) / sd
        w = np.stack([np.append(v, y_mu) for v in descend(cov / np.outer(sd, sd), xy, alphas)])
        return pd.DataFrame({"s": [int(pdf["s"].iloc[0])], "w": [w.astype("<f8").tobytes()]})

    out = None
    for lo in range(0, len(rounds), per_pass):
        own = rounds[lo:lo + per_pass]
        blocks = _gram_blocks(t, own, folds)
        # a fold's blocks belong to every training set of the round but its own
        pairs = [(o, v, s) for o in own for v in folds for s, i in by_round[o] if v not in (-1, i)]
        members = literal_table(t.rows.sparkSession, pairs, ["o", "v", "s"])
        solved = blocks.join(F.broadcast(members), ["o", "v"]).select("s", "i", "j", "m").groupBy("s").applyInPandas(solve, "s int, w binary")
        out = solved if out is None else out.unionAll(solved)
    return cut_lineage(out)


def _lasso_weights(t: FoldSets, models: DataFrame, alphas: list[float]) -> list[np.ndarray]:
    got = {r["s"]: np.frombuffer(bytes(r["w"]), "<f8").reshape(len(alphas), t.dim + 1) for r in models.collect()}  # parameters only
    empty = np.zeros((len(alphas), t.dim + 1))
    return [got.get(s, empty) for s in range(len(t.sets))]


def lasso_grid(t: FoldSets, candidates: list[dict], metric: str = "spearman") -> np.ndarray:
    """Scores (sets x candidates) of the Lasso for every alpha."""
    alphas = [float(c["alpha"]) for c in candidates]
    sent = t.rows.sparkSession.sparkContext.broadcast(_lasso_weights(t, lasso_models(t, alphas), alphas))

    def predict(s, xs):
        w = sent.value[s]
        return xs @ w[:, :-1].T + w[:, -1]

    return _scored(t, t.rows.sparkSession, predict, len(alphas), metric)


def lasso_kkt(t: FoldSets, alphas: list[float], tol: float = 1e-6) -> DataFrame:
    """(o, fold, alpha, n_nonzero, violations) of every set and alpha: coordinates that break the optimality conditions.

    The gradients come from a pass over the rows' residuals, not from the Gram matrices the models were found with.
    """
    weights = _lasso_weights(t, lasso_models(t, alphas), alphas)
    sent = t.rows.sparkSession.sparkContext.broadcast(weights)
    sets, mu, sd, size = t.sets, t.mu, t.sd, len(alphas) * (t.dim + 1)

    def run(batches):
        acc = np.zeros((len(sets), size))
        for pdf in batches:
            if len(pdf):
                x, y, f = _arrays(pdf)
                for s, (o, i) in enumerate(sets):
                    rows = train_mask(f, o, i)
                    xs, w = (x[rows] - mu[s]) / sd[s], sent.value[s]
                    r = y[rows][:, None] - xs @ w[:, :-1].T - w[:, -1]
                    acc[s] += np.hstack([r.T @ xs, r.sum(0)[:, None]]).ravel()
        return acc.ravel()

    g = summed(t.rows, run, len(sets) * size).reshape(len(sets), len(alphas), t.dim + 1) / np.maximum(t.n, 1)[:, None, None]
    rows = []
    for s, (o, i) in enumerate(sets):
        for c, a in enumerate(alphas):
            w, grad = weights[s][c, :-1], g[s, c, :-1]
            bad = np.where(w != 0, np.abs(grad - a * np.sign(w)) > tol, np.abs(grad) > a + tol)
            rows.append((o, i, float(a), int((w != 0).sum()), int(bad.sum()) + int(abs(g[s, c, -1]) > tol)))
    return literal_table(t.rows.sparkSession, rows, ["o", "fold", "alpha", "n_nonzero", "violations"])


# --- selection ---------------------------------------------------------------

GRID_FITS = {"svr": svr_grid, "gpr": gp_grid, "linr": lasso_grid}


def _mean(values: np.ndarray) -> float:
    """Mean of the folds; NaN if one has none, as its candidate cannot be compared."""
    return float(np.mean(values))


def _best(means: list[float], larger: bool) -> int | None:
    """First best candidate; None when no candidate has a number in every fold."""
    real = [j for j, m in enumerate(means) if not math.isnan(m)]
    return (max if larger else min)(real, key=lambda j: means[j]) if real else None


def grid_trials(model: str, candidates: list[dict], df: DataFrame, key: str, k: int = 5, metric: str = "spearman", seed: int = 42,
                features: str = "features", label: str = "label", **fit) -> tuple[DataFrame, dict | None]:
    """H1: (trial, params, value, fold_scores, best) of every candidate, and the best one's parameters (None: no candidate has finite scores)."""
    larger = mt.SCORERS[metric][1]
    t = fold_sets(df, key, k, seed, features, label)
    scores = GRID_FITS[model](t, candidates, metric, **fit)
    t.unpersist()
    means = [_mean(scores[:, j]) for j in range(len(candidates))]
    best = _best(means, larger)
    rows = [(j, json.dumps(c, sort_keys=True), means[j], scores[:, j].tolist(), j == best) for j, c in enumerate(candidates)]
    return literal_table(df.sparkSession, rows, ["trial", "params", "value", "fold_scores", "best"]), None if best is None else candidates[best]


def nested_trials(model: str, candidates: list[dict], df: DataFrame, key: str, k: int = 5, metric: str = "spearman", seed: int = 42,
                  inner_seed: int = 43, features: str = "features", label: str = "label", **fit) -> DataFrame:
    """H6: (fold, best_params, inner_score, score): each outer fold's best candidate by its inner folds, scored on the outer fold.

    An outer fold in which no candidate has a finite score in every inner fold has null parameters and NaN scores.
    """
    larger = mt.SCORERS[metric][1]
    t = fold_sets(df, key, k, seed, features, label, True, inner_seed)
    scores = GRID_FITS[model](t, candidates, metric, **fit)
    t.unpersist()
    at, rows = {x: s for s, x in enumerate(t.sets)}, []
    for o in range(k):
        means = [_mean(np.array([scores[at[o, i], j] for i in range(k)])) for j in range(len(candidates))]
        best = _best(means, larger)
        rows.append((o, None, float("nan"), float("nan")) if best is None else
                    (o, json.dumps(candidates[best], sort_keys=True), means[best], float(scores[at[o, -1], best])))
    return literal_table(df.sparkSession, rows, ["fold", "best_params", "inner_score", "score"]).withColumn(
        "best_params", F.col("best_params").cast("string"))
