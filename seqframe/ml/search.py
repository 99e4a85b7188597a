"""Model selection (H1-H10), leaderboard (M7) and ranked prediction (M8).

General path: every candidate x fold fit is an ordinary Spark fit of a
``pyspark.ml`` estimator on a filtered, persisted fold table; the scaler is
fitted on each training fold only. Candidates can be fitted concurrently
(``parallelism``: several Spark jobs in flight from driver threads).

Grids of the Lasso, kernel regression and Gaussian process are fitted
together, over plain or nested folds, by ``seqframe.ml.grids``.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (DecisionTreeRegressor, FMRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.ml import grids
from seqframe.ml.evaluators import scorer
from seqframe.ml.models import FeedForward, KernelSVR, SparseGP, lasso
from seqframe.ml.trees import RandomTrees
from seqframe.ml.scaler import PopulationScaler
from seqframe.operators import metrics as mt
from seqframe.operators.split import kfold
from seqframe.session import literal_table

# Fixed values -------------------------------------------------------------
# Hyper-parameter grids of the practice workflow.
GRIDS = {
    "svr": {"gamma": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1], "C": [1e-2, 1e-1, 1e0, 1e1, 1e2],
            "epsilon": [1e-4, 1e-3, 1e-2, 1e-1, 1e0]},
    "linr": {"alpha": [1e-2, 2e-2, 5e-2, 1e-1, 2e-1, 5e-1, 1, 2, 5, 1e+1, 2e+1, 5e+1, 1e+2]},
    "gpr": {"n_restarts_optimizer": [5, 10, 15, 20]},
}
# --------------------------------------------------------------------------

Make = Callable[[dict], object]  # params -> unfitted estimator (featuresCol="features_vec")


MODELS: dict[str, Make] = {
    "linr": lambda p: lasso(alpha=float(p.get("alpha", 1.0))),
    "svr": lambda p: KernelSVR(C=float(p.get("C", 1.0)), gamma=str(p.get("gamma", "scale")),
                               epsilon=float(p.get("epsilon", 0.1)), featuresCol="features_vec"),
    "gpr": lambda p: SparseGP(nRestarts=int(p.get("n_restarts_optimizer", 3)), normalizeY=True,
                              featuresCol="features_vec"),
    "trees": lambda p: RandomTrees(numTrees=int(p.get("n_estimators", 100)), featuresCol="features_vec"),
    "mlp": lambda p: FeedForward(hidden=[int(p.get("hidden", 64))] * int(p.get("layers", 2)),
                                 dropout=float(p.get("dropout", 0.0)), lr=float(p.get("lr", 1e-3)),
                                 epochs=int(p.get("epochs", 30)), featuresCol="features_vec"),
}


def grid(spec: dict) -> list[dict]:
    """All combinations of a {name: [values]} grid (ParamGridBuilder order)."""
    out = [{}]
    for k, vals in spec.items():
        out = [dict(o, **{k: v}) for o in out for v in vals]
    return out


# --- scaling inside each training fold ---------------------------------------

def fit_scaled(make: Make, params: dict, train: DataFrame, features: str = "features"):
    """Fit a population z-scaler on ``train`` and the model on the scaled
    rows. Returns (scaler_model, model)."""
    sc = PopulationScaler(inputCol=features, outputCol="_scaled").fit(train)
    tr = sc.transform(train).withColumn("features_vec", array_to_vector("_scaled"))
    return sc, make(params).fit(tr)


def predict_scaled(sc, model, df: DataFrame) -> DataFrame:
    x = sc.transform(df).withColumn("features_vec", array_to_vector("_scaled"))
    return model.transform(x).drop("_scaled", "features_vec")


# --- H5 / H1 / H2: general cross-validation ----------------------------------

def _fold_table(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return kfold(df, key, k, seed).persist(StorageLevel.MEMORY_AND_DISK)


def _held_out(make: Make, params: dict, f: DataFrame, k: int, features: str, label: str,
              tag: int = 0) -> DataFrame:
    """Fit on every training fold (eager Spark fits) and return the lazy
    held-out predictions of all folds as one table (cand, fold, y, p)."""
    parts = []
    for i in range(k):
        tr, te = f.where(F.col("fold") != i), f.where(F.col("fold") == i)
        sc, m = fit_scaled(make, params, tr, features)
        parts.append(predict_scaled(sc, m, te).select(
            F.lit(tag).alias("cand"), F.lit(i).alias("fold"),
            F.col(label).cast("double").alias("y"), F.col("prediction").cast("double").alias("p")))
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def _grouped_scores(preds: DataFrame, metric: str, n_cand: int, k: int) -> list[list[float]]:
    """Score every (candidate, fold) group in one distributed pass; only the
    n_cand x k numbers reach the driver."""
    got = {(r["cand"], r["fold"]): r["s"] for r in mt.score(preds, metric, "y", "p", ["cand", "fold"], "s").collect()}
    return [[float("nan") if got.get((c, i)) is None else float(got[(c, i)]) for i in range(k)]
            for c in range(n_cand)]


# candidates whose held-out predictions are scored together in one pass
SCORE_CHUNK = 16


def cv_scores(make: Make, candidates: list[dict], f: DataFrame, k: int, metric: str = "spearman",
              features: str = "features", label: str = "label", parallelism: int = 1) -> list[list[float]]:
    """k fold scores of every candidate on a fold table. Fits run as Spark
    jobs (optionally several in flight); the held-out predictions of up to
    ``SCORE_CHUNK`` candidates are scored by one grouped metric pass."""
    scores: list[list[float]] = []
    for lo in range(0, len(candidates), SCORE_CHUNK):
        chunk = candidates[lo:lo + SCORE_CHUNK]

        def run(ic):
            return _held_out(make, ic[1], f, k, features, label, ic[0])

        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as ex:
                preds = list(ex.map(run, enumerate(chunk)))
        else:
            preds = [run(ic) for ic in enumerate(chunk)]
        allp = preds[0]
        for d in preds[1:]:
            allp = allp.unionByName(d)
        scores.extend(_grouped_scores(allp, metric, len(chunk), k))
    return scores


def cross_validate(make: Make, params: dict, df: DataFrame, key: str, k: int = 5, metric: str = "spearman",
                   seed: int = 42, features: str = "features", label: str = "label",
                   folds: DataFrame | None = None) -> list[float]:
    """H5: k fold scores (scaler and model fitted on each training fold)."""
    f = folds if folds is not None else _fold_table(df, key, k, seed)
    scorer(metric, labelCol=label)  # unknown names raise before any fit
    scores = cv_scores(make, [params], f, k, metric, features, label)[0]
    if folds is None:
        f.unpersist()
    return scores


def scores_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return literal_table(spark, rows, names)


def grid_search(make: Make, candidates: list[dict], df: DataFrame, key: str, k: int = 5,
                metric: str = "spearman", seed: int = 42, parallelism: int = 1, refit: bool = True,
                features: str = "features", label: str = "label"):
    """H1: k-fold score of every candidate; best by mean (direction from the
    scorer); optional refit on all rows. Returns (trials DataFrame, best
    params, (scaler, model) or None)."""
    f = _fold_table(df, key, k, seed)
    larger = scorer(metric).isLargerBetter()

    all_scores = cv_scores(make, candidates, f, k, metric, features, label, parallelism)
    f.unpersist()
    means = [float(np.mean(s)) if not any(math.isnan(x) for x in s) else float("nan") for s in all_scores]
    order = [i for i in range(len(candidates)) if not math.isnan(means[i])]
    best_i = (max if larger else min)(order, key=lambda i: means[i]) if order else 0
    rows = [(i, json.dumps(candidates[i], sort_keys=True), means[i], [float(x) for x in all_scores[i]])
            for i in range(len(candidates))]
    trials = literal_table(df.sparkSession, [(r[0], r[1], r[2]) for r in rows], ["trial", "params", "value"])
    fitted = fit_scaled(make, candidates[best_i], df, features) if refit else None
    return trials, candidates[best_i], fitted


def param_space(spec: dict) -> dict:
    """H4: two numbers -> log-uniform range (integers if both are ints);
    two strings or more than two values -> categorical; one value -> error."""
    out = {}
    for name, vals in spec.items():
        vals = list(vals)
        if len(vals) < 2:
            raise ValueError(f"parameter {name!r} needs at least two values")
        if len(vals) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals):
            kind = "int" if all(isinstance(v, int) for v in vals) else "log"
            out[name] = (kind, min(vals), max(vals))
        else:
            out[name] = ("choice", vals)
    return out


def _sample(space: dict, rng: np.random.Generator) -> dict:
    p = {}
    for k, s in space.items():
        if s[0] == "choice":
            p[k] = s[1][int(rng.integers(len(s[1])))]
        elif s[0] == "int":
            p[k] = int(rng.integers(s[1], s[2] + 1))
        else:
            p[k] = float(math.exp(rng.uniform(math.log(s[1]), math.log(s[2]))))
    return p


def random_search(make: Make, spec: dict, df: DataFrame, key: str, n_iter: int = 10, seed: int = 42, **kw):
    """H2: ``n_iter`` seeded candidates from the space, then as grid_search."""
    space = param_space(spec)
    rng = np.random.default_rng(seed)
    return grid_search(make, [_sample(space, rng) for _ in range(n_iter)], df, key, seed=seed, **kw)


def _near(value, s: tuple, n: int, rng: np.random.Generator):
    """A draw around ``value`` whose spread shrinks with the number of trials; the value itself for a choice."""
    if s[0] == "choice":
        return value
    if s[0] == "int":
        spread = max(1.0, (s[2] - s[1]) / (2 * math.sqrt(n)))
        return int(min(max(round(rng.normal(value, spread)), s[1]), s[2]))
    lo, hi = math.log(s[1]), math.log(s[2])
    x = rng.normal(math.log(value), (hi - lo) / (2 * math.sqrt(n)))
    return float(math.exp(x if lo <= x <= hi else rng.uniform(lo, hi)))


def _propose(space: dict, history: list[tuple[dict, float]], rng, larger: bool, n_cand: int = 24,
             gamma: float = 0.25) -> dict:
    """Density-ratio proposer: split finished trials into good / bad, score
    random candidates by l(x)/g(x) with Parzen densities per parameter."""
    vals = [v for _, v in history if not math.isnan(v)]
    if len(vals) < 3:
        return _sample(space, rng)
    ranked = sorted([h for h in history if not math.isnan(h[1])], key=lambda h: h[1], reverse=larger)
    ng = max(1, int(math.ceil(gamma * len(ranked))))
    good, bad = [h[0] for h in ranked[:ng]], [h[0] for h in ranked[ng:]] or [h[0] for h in ranked]

    def dens(x, pts, s):
        if s[0] == "choice":
            c = sum(1 for p in pts if p == x)
            return (c + 1.0) / (len(pts) + len(s[1]))
        lo, hi = (math.log(s[1]), math.log(s[2])) if s[0] == "log" else (s[1], s[2] + 1)
        t = (lambda v: math.log(v)) if s[0] == "log" else (lambda v: float(v))
        bw = max((hi - lo) / max(len(pts), 1) ** 0.5, 1e-9)
        return sum(math.exp(-0.5 * ((t(x) - t(p)) / bw) ** 2) for p in pts) / (len(pts) * bw) + 1e-12

    best, best_score = None, -1.0
    for _ in range(n_cand):
        base = good[int(rng.integers(len(good)))]
        c = _sample(space, rng)
        for k, s in space.items():  # near a good point, never on it where the range is continuous
            if rng.random() < 0.5:
                c[k] = _near(base[k], s, len(vals), rng)
        r = 1.0
        for k, s in space.items():
            r *= dens(c[k], [g[k] for g in good], s) / dens(c[k], [b[k] for b in bad], s)
        if r > best_score:
            best, best_score = c, r
    return best


def adaptive_search(make: Make, spec: dict, df: DataFrame, key: str, n_trials: int = 10, k: int = 5,
                    metric: str = "spearman", seed: int = 42, features: str = "features", label: str = "label",
                    fixed: dict | None = None):
    """H3: propose-evaluate-update search; each trial's k-fold fits are Spark
    jobs. Returns (trials DataFrame (trial, params, value), best params)."""
    space = param_space(spec)
    rng = np.random.default_rng(seed)
    larger = scorer(metric).isLargerBetter()
    f = _fold_table(df, key, k, seed)
    history = []
    for _ in range(n_trials):
        p = dict(fixed or {}, **_propose(space, history, rng, larger))
        s = cross_validate(make, p, df, key, k, metric, seed, features, label, folds=f)
        v = float(np.mean(s))
        history.append((p, v))
    f.unpersist()
    trials = literal_table(df.sparkSession, [(i, json.dumps(p, sort_keys=True), v) for i, (p, v) in enumerate(history)],
                           ["trial", "params", "value"])
    best = mt.best_trial(trials, maximize=larger).first()
    return trials, json.loads(best["params"])


def nested_cv(make: Make, candidates: list[dict], df: DataFrame, key: str, k: int = 5, metric: str = "spearman",
              seed: int = 42, inner_seed: int = 43, features: str = "features", label: str = "label"):
    """H6: for each outer fold, grid search on the outer training rows (inner
    k-fold), score the refitted best on the outer test fold.
    Returns a list of (fold, score, best params)."""
    f = _fold_table(df, key, k, seed)
    scorer(metric, labelCol=label)  # unknown names raise before any fit
    bests, preds = [], None
    for i in range(k):
        tr = f.where(F.col("fold") != i).drop("fold")
        te = f.where(F.col("fold") == i)
        _, best, (sc, m) = grid_search(make, candidates, tr, key, k, metric, inner_seed, features=features, label=label)
        bests.append(best)
        p = predict_scaled(sc, m, te).select(F.lit(0).alias("cand"), "fold", F.col(label).cast("double").alias("y"),
                                             F.col("prediction").cast("double").alias("p"))
        preds = p if preds is None else preds.unionByName(p)
    outer = _grouped_scores(preds, metric, 1, k)[0]  # all outer folds in one pass
    f.unpersist()
    return [(i, outer[i], bests[i]) for i in range(k)]


def _better(new: float, old: float, larger: bool) -> bool:
    """Whether ``new`` is better than ``old``; any number is better than NaN, and NaN than nothing."""
    if np.isnan(new):
        return False
    return bool(np.isnan(old) or (new > old if larger else new < old))


def default_vs_tuned(make: Make, spec: dict, train: DataFrame, test: DataFrame, key: str, metric: str = "spearman",
                     n_trials: int = 5, seed: int = 42, features: str = "features", label: str = "label"):
    """H8: default fit vs searched fit (refit on train with the best), both
    scored once on test; the better one is reported."""
    ev = scorer(metric, labelCol=label)
    sc, m = fit_scaled(make, {}, train, features)
    default = ev.evaluate(predict_scaled(sc, m, test))
    trials, best = adaptive_search(make, spec, train, key, n_trials, metric=metric, seed=seed, features=features,
                                   label=label)
    sc2, m2 = fit_scaled(make, best, train, features)
    tuned = ev.evaluate(predict_scaled(sc2, m2, test))
    better = _better(tuned, default, ev.isLargerBetter())
    return {"default": default, "tuned": tuned, "best_params": best, "reported": tuned if better else default,
            "trials": trials}


TRIALS = "stage int, trial int, params string, value double, error string"


def stored_trials(spark: SparkSession, path: str) -> list[dict]:
    """The trials of a run table, in order; none when the table does not exist yet."""
    try:
        found = spark.read.schema(TRIALS).parquet(path).collect()  # one row a trial
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [r.asDict() for r in sorted(found, key=lambda r: (r["stage"], r["trial"]))]


def staged_search(spark: SparkSession, evaluate: Callable[[dict], float], stages: list[dict], path: str, n_trials: int = 5,
                  larger: bool = True, seed: int = 42) -> tuple[DataFrame, dict | None, int]:
    """H9: tune the parameters of one stage after the other, each from the best of the stages before.

    Every finished trial is appended to the run table ``path`` before the next one
    starts. A run on a table with trials goes on behind the last one: stored trials
    are not evaluated again, and a proposal depends only on the seed, its stage
    and number and the trials before. A trial that raises is stored with
    its error and no value, and is skipped. A stage's best is kept only if it is better than what
    was kept before. Returns the trials with ``kept`` (1 on the best one), the parameters kept (None: every
    trial failed) and how many trials this call evaluated.
    """
    done = {(r["stage"], r["trial"]): r for r in stored_trials(spark, path)}
    best, best_value, kept, evaluated = None, float("nan"), None, 0
    for stage, spec in enumerate(stages, 1):
        space, fixed, history = param_space(spec), dict(best or {}), []
        for trial in range(n_trials):
            row = done.get((stage, trial))
            if row is None:
                params = dict(fixed, **_propose(space, history, np.random.default_rng([seed, stage, trial]), larger))
                row = {"stage": stage, "trial": trial, "params": json.dumps(params, sort_keys=True), "value": None, "error": None}
                try:
                    row["value"] = float(evaluate(params))
                except Exception as e:  # noqa: BLE001  (whatever a fit raises is the trial's outcome)
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                spark.createDataFrame([row], TRIALS).coalesce(1).write.mode("append").parquet(path)
                done[stage, trial] = row
                evaluated += 1
            params, value = json.loads(row["params"]), float("nan") if row["value"] is None else row["value"]
            history.append(({k: params[k] for k in space}, value))
            if _better(value, best_value, larger):
                best, best_value, kept = params, value, (stage, trial)
    rows = [(r["stage"], r["trial"], r["params"], float("nan") if r["value"] is None else r["value"], r["error"] or "", int(k == kept))
            for k, r in sorted(done.items())]
    return literal_table(spark, rows, ["stage", "trial", "params", "value", "error", "kept"]), best, evaluated


def two_stage_search(make: Make, spec1: dict, spec2: dict, train: DataFrame, valid: DataFrame, path: str, n_trials: int = 5,
                     metric: str = "spearman", seed: int = 42, features: str = "features", label: str = "label"):
    """H9: structure (spec1) first, then the rest (spec2), each trial fitted on ``train`` and scored on ``valid``; see ``staged_search``."""
    ev = scorer(metric, labelCol=label)

    def evaluate(params: dict) -> float:
        sc, m = fit_scaled(make, params, train, features)
        return ev.evaluate(predict_scaled(sc, m, valid))

    return staged_search(train.sparkSession, evaluate, [spec1, spec2], path, n_trials, ev.isLargerBetter(), seed)


def leaderboard(train: DataFrame, test: DataFrame, metric: str = "spearman", features: str = "features",
                label: str = "label", extra: dict[str, Make] | None = None) -> DataFrame:
    """M7: fit every default regressor, score on test, with fit seconds;
    sorted best first."""
    makers: dict[str, Make] = {
        "ols": lambda p: LinearRegression(featuresCol="features_vec"),
        "ridge": lambda p: LinearRegression(regParam=1.0, elasticNetParam=0.0, featuresCol="features_vec"),
        "lasso": lambda p: lasso(0.1),
        "elastic_net": lambda p: LinearRegression(regParam=0.1, elasticNetParam=0.5, featuresCol="features_vec"),
        "glm_gaussian": lambda p: GeneralizedLinearRegression(family="gaussian", featuresCol="features_vec"),
        "decision_tree": lambda p: DecisionTreeRegressor(featuresCol="features_vec", seed=42),
        "random_forest": lambda p: RandomForestRegressor(featuresCol="features_vec", seed=42),
        "gbt": lambda p: GBTRegressor(featuresCol="features_vec", seed=42),
        "fm": lambda p: FMRegressor(featuresCol="features_vec", seed=42),
        "kernel_svr": MODELS["svr"],
        "sparse_gp": MODELS["gpr"],
    }
    makers.update(extra or {})
    ev = scorer(metric, labelCol=label)
    names, fit_s, preds = list(makers), [], None
    for i, name in enumerate(names):
        t0 = time.time()
        sc, m = fit_scaled(makers[name], {}, train, features)
        fit_s.append(time.time() - t0)
        p = predict_scaled(sc, m, test).select(F.lit(i).alias("cand"), F.lit(0).alias("fold"),
                                               F.col(label).cast("double").alias("y"),
                                               F.col("prediction").cast("double").alias("p"))
        preds = p if preds is None else preds.unionByName(p)
    scores = _grouped_scores(preds, metric, len(names), 1)  # every model's test score in one pass
    rows = [(name, scores[i][0], fit_s[i]) for i, name in enumerate(names)]
    board = literal_table(train.sparkSession, rows, ["model", "score", "fit_seconds"])
    return board.orderBy(F.col("score").desc() if ev.isLargerBetter() else F.col("score").asc(), "model")


def predict_rank(sc, model, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """M8: scale with the training scaler, predict, sort best first."""
    return predict_scaled(sc, model, df).orderBy(F.col(prediction).desc())


WORKFLOW_MODES = ("select", "construct", "predict", "all")


def workflow(make: Make, candidates: list[dict], df: DataFrame, key: str, pred_df: DataFrame | None = None,
             mode: str = "all", k: int = 5, metric: str = "spearman", seed: int = 42,
             features: str = "features", label: str = "label") -> dict:
    """Select (nested CV of default vs grid), construct (grid search on
    all rows, refit the best) and predict (rank ``pred_df`` with the refitted
    scaler and model). Every fit and score runs as Spark jobs; the result
    holds Python numbers and DataFrames, nothing row-sized."""
    if mode not in WORKFLOW_MODES:
        raise ValueError(f"unknown workflow mode {mode!r}; expected one of {WORKFLOW_MODES}")
    res: dict = {}
    if mode in ("select", "all"):
        res["default_cv"] = cross_validate(make, {}, df, key, k, metric, seed, features, label)
        res["nested_cv"] = nested_cv(make, candidates, df, key, k, metric, seed, features=features, label=label)
    if mode in ("construct", "predict", "all"):
        trials, best, fitted = grid_search(make, candidates, df, key, k, metric, seed, features=features, label=label)
        res.update(trials=trials, best_params=best, fitted=fitted)
        if mode in ("predict", "all") and pred_df is not None:
            res["ranked"] = predict_rank(*fitted, pred_df)
    return res


# --- Lasso through the shared grids ---------------------------------------

def lasso_cv(df: DataFrame, key: str, alphas: list[float], k: int = 5, metric: str = "spearman", seed: int = 42,
             features: str = "features", label: str = "label") -> DataFrame:
    """H5/H1 for M1: (fold, candidate, alpha, score), all candidates and folds from one set of Gram blocks."""
    t = grids.fold_sets(df, key, k, seed, features, label)
    scores = grids.lasso_grid(t, [{"alpha": a} for a in alphas], metric)
    t.unpersist()
    rows = [(i, j, float(a), float(scores[i, j])) for i in range(k) for j, a in enumerate(alphas)]
    return literal_table(df.sparkSession, rows, ["fold", "candidate", "alpha", "score"])


def lasso_nested_cv(df: DataFrame, key: str, alphas: list[float], k: int = 5, metric: str = "spearman",
                    seed: int = 42, inner_seed: int = 43, features: str = "features", label: str = "label") -> DataFrame:
    """H6 for M1: (fold, best_alpha, inner_score, score): the outer-fold score of the best candidate of the inner folds.

    Best is the largest mean of inner scores among candidates that have one in every fold; without any, null and NaN."""
    t = grids.nested_trials("linr", [{"alpha": a} for a in alphas], df, key, k, metric, seed, inner_seed, features, label)
    return t.select("fold", F.get_json_object("best_params", "$.alpha").cast("double").alias("best_alpha"), "inner_score", "score")
