"""Estimators (M1-M6).

M1 is a configured ``pyspark.ml`` estimator, M4 is in ``trees``. M2, M3, M5 and M6 are
``pyspark.ml`` Estimator/Model subclasses whose fitting is a sequence of
distributed aggregations (``seqframe.ml.optim``) and whose ``transform`` is an
Arrow-batched pandas UDF over the feature arrays. All take an ARRAY<DOUBLE>
(or ML vector) features column and a DOUBLE (or ARRAY<DOUBLE>) label.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.hashing import stable_hash
from seqframe.ml import gp, optim


# --- M1: a pyspark.ml estimator ----------------------------------------

def lasso(alpha: float = 1.0, max_iter: int = 1000, featuresCol: str = "features_vec",
          labelCol: str = "label") -> LinearRegression:
    """M1: L1-penalised least squares, objective 1/(2n)·RSS + alpha·||w||_1
    (no internal standardisation, like the usual Lasso definition)."""
    return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=max_iter,
                            featuresCol=featuresCol, labelCol=labelCol)


def as_vector(df: DataFrame, features: str = "features", out: str = "features_vec") -> DataFrame:
    """ARRAY<DOUBLE> -> ML vector column for the built-in estimators."""
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def _features_array(df: DataFrame, col: str):
    t = df.schema[col].dataType.simpleString()
    return vector_to_array(F.col(col)) if t == "vector" else F.col(col).cast("array<double>")


class _JsonParams(Params):
    state = Param(Params._dummy(), "state", "fitted parameters (JSON)", TypeConverters.toString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _set_state(self, d: dict):
        self._set(state=json.dumps(d))


class _Base(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    pass


# --- M2: random-Fourier-feature support-vector regression -------------------

def _rff(X: np.ndarray, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = X @ W
    z += b
    np.cos(z, out=z)
    z *= np.sqrt(2.0 / W.shape[1])
    return z


def _svr_grad(w, X, y, ex):
    Z = _rff(X, ex["W"], ex["b"])
    f = Z @ w[:-1] + w[-1]
    r = f - y[:, 0]
    active = np.abs(r) > ex["eps"]
    s = np.sign(r) * active
    g = np.concatenate([Z.T @ s, [s.sum()]])
    return g, float(np.maximum(np.abs(r) - ex["eps"], 0).sum())


def _ridge_start(t: "optim.TrainingTable", W, b, l2: float) -> np.ndarray:
    """Warm start: ridge solution on the random features from one
    aggregation of Z'Z and Z'y (D x D, parameter-sized)."""
    D = W.shape[1]
    bc = t.df.sparkSession.sparkContext.broadcast((W, b))

    def agg(batches):
        Wb, bb = bc.value
        acc = np.zeros((D + 1) * (D + 1) + (D + 1))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            Z = _rff(optim.stacked(pdf["x"]), Wb, bb)
            Z = np.hstack([Z, np.ones((len(Z), 1))])
            y = optim.stacked(pdf["y"])[:, 0]
            acc[:(D + 1) ** 2] += (Z.T @ Z).ravel()
            acc[(D + 1) ** 2:] += Z.T @ y
        return acc

    a = optim.summed(t.df, agg, (D + 1) * (D + 1) + (D + 1))
    bc.unpersist()
    A = a[:(D + 1) ** 2].reshape(D + 1, D + 1) / max(t.n, 1)
    reg = np.eye(D + 1) * max(l2, 1e-6)
    reg[-1, -1] = 0.0
    return np.linalg.solve(A + reg + 1e-9 * np.eye(D + 1), a[(D + 1) ** 2:] / max(t.n, 1))


class KernelSVR(Estimator, _Base, DefaultParamsReadable, DefaultParamsWritable):
    """M2: epsilon-insensitive regression on random Fourier features of an
    RBF kernel (approximates RBF-SVR; exact SMO is O(n^2) and single-node).
    gamma='scale' gives 1/(d·Var(X)), as for the usual RBF default."""

    C = Param(Params._dummy(), "C", "inverse L2 strength", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "RBF gamma or 'scale'", TypeConverters.toString)
    epsilon = Param(Params._dummy(), "epsilon", "insensitive tube", TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "random features", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes", TypeConverters.toInt)
    lr = Param(Params._dummy(), "lr", "Adam step", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=1.0, gamma="scale", epsilon=0.1, nComponents=256, epochs=15, lr=0.01, seed=42,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(C=1.0, gamma="scale", epsilon=0.1, nComponents=256, epochs=15, lr=0.01, seed=42,
                         featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        x = _features_array(df, self.getFeaturesCol())
        t = optim.prepare(df.withColumn("_x", x).withColumn("_y", F.array(F.col(self.getLabelCol()).cast("double"))),
                          "_x", "_y", seed=self.getSeed())
        g = self.getOrDefault(self.gamma)
        if g == "scale":
            s = t.df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")).first()["s"]
            mu, var, n = s["mean"].toArray(), s["variance"].toArray(), float(s["count"])
            pop = var * (n - 1) / n if n > 1 else var
            total_var = float(np.mean(pop + mu ** 2) - np.mean(mu) ** 2)
            gamma = 1.0 / (t.dim * total_var) if total_var > 0 else 1.0
        else:
            gamma = float(g)
        rng = np.random.default_rng(self.getSeed())
        D = self.getOrDefault(self.nComponents)
        W = rng.normal(0.0, np.sqrt(2 * gamma), size=(t.dim, D))
        b = rng.uniform(0, 2 * np.pi, size=D)
        ex = {"W": W, "b": b, "eps": self.getOrDefault(self.epsilon)}
        l2 = 1.0 / (self.getOrDefault(self.C) * max(t.n, 1))
        w0 = _ridge_start(t, W, b, l2)
        w, hist = optim.minimize(t, w0, _svr_grad, epochs=self.getOrDefault(self.epochs),
                                 lr=self.getOrDefault(self.lr), l2=l2, extra=ex)
        t.unpersist()
        m = KernelSVRModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        m._set_state({"W": W.tolist(), "b": b.tolist(), "w": w.tolist(), "gamma": gamma, "loss": hist})
        return m


class KernelSVRModel(Model, _Base, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        W, b, w = np.array(st["W"]), np.array(st["b"]), np.array(st["w"])

        @F.pandas_udf("double")
        def predict(xs: pd.Series) -> pd.Series:
            X = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, W.shape[0]))
            return pd.Series(_rff(X, W, b) @ w[:-1] + w[-1])

        return df.withColumn(self.getPredictionCol(), predict(_features_array(df, self.getFeaturesCol())))


# --- M3: inducing-point (subset-of-regressors) Gaussian process -------------

class SparseGP(Estimator, _Base, DefaultParamsReadable, DefaultParamsWritable):
    """M3: GP regression with an RBF kernel approximated through m inducing
    rows (subset of regressors). Length scale and noise maximise the evidence
    from ``nRestarts`` starts, which share one distributed pass a step
    (``seqframe.ml.gp``); given ``lengthScales`` are only compared, with the
    given noise. normalize_y standardises y."""

    nInducing = Param(Params._dummy(), "nInducing", "inducing rows", TypeConverters.toInt)
    noise = Param(Params._dummy(), "noise", "noise variance used with given length scales", TypeConverters.toFloat)
    lengthScales = Param(Params._dummy(), "lengthScales", "length scales to compare (empty: optimise)", TypeConverters.toListFloat)
    nRestarts = Param(Params._dummy(), "nRestarts", "starts of the optimisation", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "steps of each start", TypeConverters.toInt)
    normalizeY = Param(Params._dummy(), "normalizeY", "standardise y", TypeConverters.toBoolean)
    keyCol = Param(Params._dummy(), "keyCol", "row key for picking inducing rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, nInducing=128, noise=0.1, lengthScales=None, nRestarts=3, steps=10, normalizeY=True, keyCol="",
                 seed=42, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(nInducing=128, noise=0.1, lengthScales=[], nRestarts=3, steps=10, normalizeY=True, keyCol="",
                         seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")
        kw = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kw)

    def _fit(self, df: DataFrame):
        x = _features_array(df, self.getFeaturesCol())
        key = self.getOrDefault(self.keyCol)
        d = df.select(x.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
                      (stable_hash(self.getSeed(), key) if key else F.xxhash64(x)).alias("_h"), (F.col(key) if key else F.lit(0)).alias("_k"))
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
        st = d.agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n")).first()
        mu, sd = (float(st["mu"]), float(st["sd"] or 1.0) or 1.0) if self.getOrDefault(self.normalizeY) else (0.0, 1.0)
        m = self.getOrDefault(self.nInducing)
        def pick(rows):  # m rows: the method's size
            return np.array([r["x"] for r in rows.limit(m).select("x").collect()])

        Z = pick(d.orderBy("_h", "_k"))

        def parts(pdf):
            yield 0, np.stack(pdf["x"].to_numpy()), (pdf["y"].to_numpy() - mu) / sd

        given = list(self.getOrDefault(self.lengthScales))
        def fitted(jitters):
            return gp.restarts(d, parts, [Z], np.array([float(st["n"])]), self.getOrDefault(self.nRestarts), self.getOrDefault(self.steps),
                               self.getSeed(), 1 << 25, given or None, self.getOrDefault(self.noise) if given else None, jitters=jitters)[0]

        fits = fitted(gp.JITTERS if key else gp.JITTERS[:1])
        if not key and all(f is None for f in fits):  # copies have one hash and may fill all m places
            Z = pick(d.select("_h", "x").distinct().orderBy("_h"))
            fits = fitted(gp.JITTERS)
        d.unpersist()
        fit = gp.best(fits)
        model = SparseGPModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        model._set_state({"Z": Z.tolist(), "ls": fit.length, "alpha": fit.alpha.tolist(), "Minv": fit.minv.tolist(),
                          "noise": fit.noise, "mu": mu, "sd": sd, "lml": fit.evidence, "candidates": [f.length for f in fits if f is not None]})
        return model


class SparseGPModel(Model, _Base, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction`` (mean) and ``prediction_std``."""

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        Z, alpha, Minv = np.array(st["Z"]), np.array(st["alpha"]), np.array(st["Minv"])
        ls, noise, mu, sd = st["ls"], st["noise"], st["mu"], st["sd"]

        @F.pandas_udf("struct<mean:double,std:double>")
        def predict(xs: pd.Series) -> pd.DataFrame:
            if len(xs) == 0:
                return pd.DataFrame({"mean": [], "std": []})
            X = np.stack(xs.to_numpy())
            K = gp.rbf(X, Z, ls)
            mean = K @ alpha * sd + mu
            var = noise * np.einsum("ij,jk,ik->i", K, Minv, K)
            return pd.DataFrame({"mean": mean, "std": np.sqrt(np.maximum(var, 0)) * sd})

        p = self.getPredictionCol()
        out = df.withColumn("_gp", predict(_features_array(df, self.getFeaturesCol())))
        return out.withColumn(p, F.col("_gp.mean")).withColumn(p + "_std", F.col("_gp.std")).drop("_gp")


# --- M5 / M6: feed-forward network ------------------------------------------

def _shapes(sizes):
    return [(sizes[i], sizes[i + 1]) for i in range(len(sizes) - 1)]


def _unpack(w, sizes):
    out, off = [], 0
    for a, b in _shapes(sizes):
        W = w[off:off + a * b].reshape(a, b)
        off += a * b
        bb = w[off:off + b]
        off += b
        out.append((W, bb))
    return out


def _act(z, kind):
    return np.maximum(z, 0) if kind == "relu" else np.tanh(z)


def _dact(z, a, kind):
    return (z > 0).astype(float) if kind == "relu" else 1.0 - a * a


def _forward(w, X, ex, train: bool, rng=None):
    layers = _unpack(w, ex["sizes"])
    if train and ex.get("input_dropout", 0) > 0:
        X = X * (rng.random(X.shape) >= ex["input_dropout"]) / (1.0 - ex["input_dropout"])
    acts, pre, masks = [X], [], []
    a = X
    for i, (W, b) in enumerate(layers):
        z = a @ W + b
        pre.append(z)
        if i < len(layers) - 1:
            a = _act(z, ex["activation"])
            if train and ex["dropout"] > 0:
                mask = (rng.random(a.shape) >= ex["dropout"]) / (1.0 - ex["dropout"])
                a = a * mask
                masks.append(mask)
            else:
                masks.append(None)
            acts.append(a)
        else:
            a = z
    return a, acts, pre, masks, layers


def _loss_grad_out(out, Y, kind):
    n, k = out.shape
    if kind == "mse":
        r = out - Y
        return float((r * r).sum() / k), 2.0 * r / k
    if kind == "ce":
        z = out - out.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        idx = Y[:, 0].astype(int)
        loss = float(-np.log(np.maximum(p[np.arange(n), idx], 1e-300)).sum())
        g = p.copy()
        g[np.arange(n), idx] -= 1.0
        return loss, g
    if kind == "bce":
        loss = float((np.maximum(out, 0) - out * Y + np.log1p(np.exp(-np.abs(out)))).sum() / k)
        return loss, (1.0 / (1.0 + np.exp(-out)) - Y) / k
    raise ValueError(f"unknown loss {kind!r}")


def _mlp_grad(w, X, Y, ex):
    train = ex.get("train", True)
    # new masks in every step, the same ones when a task of the step is run again
    rng = np.random.default_rng([ex.get("seed", 0), ex.get("step", 0), *ex.get("at", (0, 0))])
    out, acts, pre, masks, layers = _forward(w, X, ex, train=train, rng=rng)
    loss, g = _loss_grad_out(out, Y, ex["loss"])
    if not train:
        return np.zeros_like(w), loss
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        W, _ = layers[i]
        a_prev = acts[i]
        grads.append((a_prev.T @ g, g.sum(0)))
        if i > 0:
            g = g @ W.T
            if masks[i - 1] is not None:
                g = g * masks[i - 1]
            g = g * _dact(pre[i - 1], np.tanh(pre[i - 1]) if ex["activation"] == "tanh" else None, ex["activation"])
    grads.reverse()
    flat = np.concatenate([np.concatenate([gw.ravel(), gb]) for gw, gb in grads])
    return flat, loss


class FeedForward(Estimator, _Base, DefaultParamsReadable, DefaultParamsWritable):
    """M5: d -> hidden... -> out network, ReLU/tanh, dropout, MSE / cross-
    entropy / BCE, Adam on data-parallel mini-batch gradients, optional early
    stopping on a validation table (strict-improvement patience rule; the
    best weights are kept). ``history`` of the model holds per-epoch losses.
    M6 (pooled-embedding head) is ``FeedForward(hidden=[h], activation='tanh')``."""

    hidden = Param(Params._dummy(), "hidden", "hidden sizes", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "relu or tanh", TypeConverters.toString)
    dropout = Param(Params._dummy(), "dropout", "dropout rate", TypeConverters.toFloat)
    loss = Param(Params._dummy(), "loss", "mse, ce or bce", TypeConverters.toString)
    nOut = Param(Params._dummy(), "nOut", "outputs (classes for ce)", TypeConverters.toInt)
    lr = Param(Params._dummy(), "lr", "Adam step", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "max epochs", TypeConverters.toInt)
    batches = Param(Params._dummy(), "batches", "mini-batches per epoch", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "early-stopping patience (0: off)", TypeConverters.toInt)
    inputDropout = Param(Params._dummy(), "inputDropout", "dropout rate of the features", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, hidden=(64, 64), activation="relu", dropout=0.0, inputDropout=0.0, loss="mse", nOut=1, lr=1e-3,
                 epochs=50, batches=1, patience=0, seed=42, featuresCol="features", labelCol="label",
                 predictionCol="prediction"):
        super().__init__()
        self._setDefault(hidden=[64, 64], activation="relu", dropout=0.0, inputDropout=0.0, loss="mse", nOut=1, lr=1e-3,
                         epochs=50, batches=1, patience=0, seed=42, featuresCol="features", labelCol="label",
                         predictionCol="prediction")
        kw = dict(self._input_kwargs)
        if "hidden" in kw:
            kw["hidden"] = list(kw["hidden"])
        self._set(**kw)
        self._validation = None

    def setValidation(self, df: DataFrame) -> "FeedForward":
        self._validation = df
        return self

    def _table(self, df: DataFrame):
        lab = F.col(self.getLabelCol())
        is_arr = df.schema[self.getLabelCol()].dataType.simpleString().startswith("array")
        y = lab.cast("array<double>") if is_arr else F.array(lab.cast("double"))
        return optim.prepare(df.withColumn("_x", _features_array(df, self.getFeaturesCol())).withColumn("_y", y),
                             "_x", "_y", seed=self.getSeed())

    def _fit(self, df: DataFrame):
        t = self._table(df)
        v = self._table(self._validation) if self._validation is not None else None
        sizes = [t.dim] + list(self.getOrDefault(self.hidden)) + [self.getOrDefault(self.nOut)]
        rng = np.random.default_rng(self.getSeed())
        w0 = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2.0 / a), size=a * b), np.zeros(b)])
                             for a, b in _shapes(sizes)])
        ex = {"sizes": sizes, "activation": self.getOrDefault(self.activation),
              "dropout": self.getOrDefault(self.dropout), "input_dropout": self.getOrDefault(self.inputDropout),
              "loss": self.getOrDefault(self.loss), "seed": self.getSeed()}
        patience = self.getOrDefault(self.patience)
        hist: list[dict] = []
        state = {"best": None, "best_w": w0, "since": 0, "stop": None}

        def on_epoch(ep, w, train_loss):
            row = {"epoch": ep, "loss": train_loss}
            if v is not None:
                _, vl, vn = optim.gradient(v, w, _mlp_grad, dict(ex, train=False))
                row["val_loss"] = vl / max(vn, 1)
                if state["best"] is None or row["val_loss"] < state["best"]:
                    state.update(best=row["val_loss"], best_w=w.copy(), since=0, best_epoch=ep)
                else:
                    state["since"] += 1
            hist.append(row)
            if patience and v is not None and state["since"] >= patience:
                state["stop"] = ep
                return True
            return False

        w, _ = optim.minimize(t, w0, _mlp_grad, epochs=self.getOrDefault(self.epochs),
                              batches=self.getOrDefault(self.batches), lr=self.getOrDefault(self.lr),
                              extra=ex, on_epoch=on_epoch)
        if v is not None and state["best"] is not None:
            w = state["best_w"]
            v.unpersist()
        t.unpersist()
        m = FeedForwardModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        m._set_state({"w": w.tolist(), "sizes": sizes, "activation": ex["activation"], "loss": ex["loss"],
                      "history": hist, "stop_epoch": state["stop"], "best_epoch": state.get("best_epoch")})
        return m


class FeedForwardModel(Model, _Base, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """``prediction``: regression value / class index (ce) / label
    probabilities (bce, array). ``scores``: raw outputs."""

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def history(self) -> list[dict]:
        return self._state()["history"]

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        w = np.array(st["w"])
        ex = {"sizes": st["sizes"], "activation": st["activation"], "dropout": 0.0}

        @F.pandas_udf("array<double>")
        def scores(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            out, *_ = _forward(w, np.stack(xs.to_numpy()), ex, train=False)
            return pd.Series(list(out))

        res = df.withColumn("scores", scores(_features_array(df, self.getFeaturesCol())))
        p = self.getPredictionCol()
        if st["loss"] == "ce":
            return res.withColumn(p, (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))
        if st["loss"] == "bce":
            return res.withColumn(p, F.transform("scores", lambda z: 1.0 / (1.0 + F.exp(-z))))
        return res.withColumn(p, F.col("scores")[0])


def pooled_head(hidden: int = 128, dropout: float = 0.1, loss: str = "mse", n_out: int = 1, **kw) -> FeedForward:
    """M6: mean-pooled embedding -> dropout -> dense -> tanh -> dropout -> out,
    loss by label kind (mse regression, ce single-label, bce multi-label)."""
    return FeedForward(hidden=[hidden], activation="tanh", dropout=dropout, inputDropout=dropout, loss=loss, nOut=n_out, **kw)
