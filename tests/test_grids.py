"""Grids fitted together against plain loops and dense solutions; sums and batches of the optimiser."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.ml import gp, grids, optim
from seqframe.ml import search as se
from seqframe.ml.models import FeedForward, KernelSVR, SparseGP, _mlp_grad


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(83, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, 0]
    x[:, 3] = 4.0  # a constant column
    y = np.sin(x[:, 0]) + 0.2 * x[:, 1] + 3 * x[:, 2] + 0.1 * rng.normal(size=83)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(83)], "id long, features array<double>, label double")
    return df.repartition(11).cache()


def test_nested_folds_are_exact_and_copy_no_row(spark, table):
    rows = grids.nested_folds(table, "id", 5, 42, 43).collect()
    assert len(rows) == 83
    for o in range(5):
        sizes = Counter(r.f[o] for r in rows)
        rest = 83 - sizes[-1]
        assert sizes[-1] == 83 // 5 + (o < 83 % 5)
        assert [sizes[i] for i in range(5)] == [rest // 5 + (i < rest % 5) for i in range(5)]
    for r in rows:
        assert sum(v == -1 for v in r.f) == 1


def test_svr_grid_equals_a_plain_loop(spark, table):
    cands = se.grid({"gamma": [0.02, 0.3], "C": [0.1, 10.0], "epsilon": [0.01, 0.3]})
    t = grids.fold_sets(table, "id", 3)
    got = grids.svr_grid(t, cands, n_components=24, epochs=4)
    t.unpersist()
    make = lambda p: KernelSVR(C=p["C"], gamma=str(p["gamma"]), epsilon=p["epsilon"], nComponents=24, epochs=4, featuresCol="features_vec")
    f = se._fold_table(table, "id", 3, 42)
    picked = [0, 3, 6, 7]
    want = se.cv_scores(make, [cands[j] for j in picked], f, 3)
    assert got[:, picked].T == pytest.approx(np.array(want), abs=1e-6)
    trials, best = grids.grid_trials("svr", cands, table, "id", 3, n_components=24, epochs=4)
    rows = trials.orderBy("trial").collect()
    assert [json.loads(r.params) for r in rows] == cands and [r.value for r in rows] == pytest.approx(got.mean(0).tolist())
    assert best == cands[int(np.argmax(got.mean(0)))] and [r.best for r in rows].count(True) == 1


def test_lasso_grid_blocks_and_optimality(spark, monkeypatch):
    monkeypatch.setattr(grids, "BLOCK", 16)
    monkeypatch.setattr(grids, "MAX_SUMS", 40_000)  # several passes
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 70))
    y = x[:, :5] @ [3, -2, 1, 0.5, 0.2] + 0.3 * rng.normal(size=120)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(120)], "id long, features array<double>, label double").repartition(7)
    alphas = [0.5, 0.01, 0.1, 100.0]
    t = grids.fold_sets(df, "id", 3, nested=True)
    kkt = grids.lasso_kkt(t, alphas).collect()
    assert len(kkt) == len(t.sets) * 4 and all(r.violations == 0 for r in kkt)
    assert all((r.n_nonzero == 0) == (r.alpha == 100.0) for r in kkt)
    t.unpersist()
    nested = grids.nested_trials("linr", [{"alpha": a} for a in alphas], df, "id", 3).orderBy("fold").collect()
    assert all(json.loads(r.best_params)["alpha"] < 1 and r.score > 0.9 and r.inner_score > 0.9 for r in nested)
    plain, best = grids.grid_trials("linr", [{"alpha": a} for a in alphas], df, "id", 3)
    f = se._fold_table(df, "id", 3, 42)
    want = se.cv_scores(se.MODELS["linr"], [{"alpha": a} for a in (0.5, 0.1)], f, 3)
    rows = plain.orderBy("trial").collect()
    assert rows[0].fold_scores == pytest.approx(want[0], abs=1e-3) and rows[2].fold_scores == pytest.approx(want[1], abs=1e-3)
    assert math.isnan(rows[3].value) and not rows[3].best and best["alpha"] < 1
    only, none = grids.grid_trials("linr", [{"alpha": 100.0}], df, "id", 3)
    assert none is None and not only.first().best
    row = grids.nested_trials("linr", [{"alpha": 100.0}], df, "id", 3).first()
    assert row.best_params is None and math.isnan(row.score)


def dense_evidence(x, y, length, noise):
    k = gp.rbf(x, x, length) + (noise + gp.JITTER) * np.eye(len(x))
    return -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + len(x) * math.log(2 * math.pi))


def test_gp_evidence_slope_and_exactness(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=30)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(30)], "x array<double>, y double").repartition(4)

    def parts(pdf):
        yield 0, np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()

    sums, yy = gp.evidence_sums(df, parts, [x], [[0.7, 0.7 * math.exp(1e-5)]], 1 << 20)
    a, b = [gp.evidence(s, x, length, 0.05, 30, yy[0]) for s, length in zip(sums[0], (0.7, 0.7 * math.exp(1e-5)))]
    assert a.evidence == pytest.approx(dense_evidence(x, y, 0.7, 0.05), abs=1e-3)  # every row is inducing
    assert (b.evidence - a.evidence) / 1e-5 == pytest.approx(a.slope, rel=2e-2, abs=1e-2)
    got = gp.restarts(df, parts, [x], np.array([30.0]), 5, 10, 1, 1 << 20)[0]
    doubled = gp.restarts(df, parts, [x], np.array([30.0]), 0, 0, 1, 1 << 20, given=[math.sqrt(2) * 2.0 ** k for k in range(-1, 3)], noise=0.1)[0]
    assert gp.best(got).evidence > gp.best(doubled).evidence
    best = gp.best(got)
    grid = max(dense_evidence(x, y, le, no) for le in np.exp(np.linspace(-2, 3, 40)) for no in np.exp(np.linspace(-8, 1, 40)))
    assert best.evidence > grid - 0.05
    assert gp.starts(2, 5, 1) == gp.starts(2, 20, 1)[:5]


def test_gp_grid_equals_a_plain_loop(spark, table):
    cands = [{"n_restarts_optimizer": r} for r in (1, 4)]
    t = grids.fold_sets(table, "id", 3)
    got = grids.gp_grid(t, cands, n_inducing=20, steps=4)
    t.unpersist()
    make = lambda p: SparseGP(nInducing=20, nRestarts=p["n_restarts_optimizer"], steps=4, keyCol="id", featuresCol="features_vec")
    f = se._fold_table(table, "id", 3, 42)
    assert got.T == pytest.approx(np.array(se.cv_scores(make, cands, f, 3)), abs=1e-3)
    assert (got > 0.8).all()


def test_two_level_sums_and_batches(spark, monkeypatch):
    monkeypatch.setattr(optim, "PIECE", 7)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=(200, 1))
    df = spark.createDataFrame([(x[i].tolist(), float(y[i, 0])) for i in range(200)], "features array<double>, label double").repartition(12)
    t = optim.prepare(df, "features", "label", seed=4)
    w = rng.normal(size=3 * 4 + 4 + 4 + 1)
    ex = {"sizes": [3, 4, 1], "activation": "tanh", "dropout": 0.0, "loss": "mse"}
    g, loss, n = optim.gradient(t, w, _mlp_grad, ex)
    want, want_loss = _mlp_grad(w, x, y, ex)
    assert n == 200 and g == pytest.approx(want) and loss == pytest.approx(want_loss)
    parts = [optim.gradient(t, w, _mlp_grad, ex, (b, 4)) for b in range(4)]
    assert sum(p[2] for p in parts) == 200 and sum(p[0] for p in parts) == pytest.approx(want) and all(p[2] > 20 for p in parts)
    assert len(t.batches(4)) == 4 and t.batches(4) is t.batches(4)
    u = sorted(r.u for r in t.df.select("u").collect())
    again = sorted(r.u for r in optim.prepare(df.repartition(3), "features", "label", seed=4).df.select("u").collect())
    assert u == again and 0 <= u[0] and u[-1] < 1
    t.unpersist()


def test_dropout_masks_change_by_step_and_repeat_in_a_rerun():
    x, y, w = np.ones((50, 3)), np.zeros((50, 1)), np.linspace(-1, 1, 3 * 4 + 4 + 4 + 1)
    ex = {"sizes": [3, 4, 1], "activation": "tanh", "dropout": 0.5, "input_dropout": 0.5, "loss": "mse", "seed": 1, "at": (2, 0)}
    one, again, two = [_mlp_grad(w, x, y, dict(ex, step=s))[0] for s in (0, 0, 1)]
    assert (one == again).all() and (one != two).any()
    part = _mlp_grad(w, x, y, dict(ex, step=0, at=(3, 0)))[0]
    assert (one != part).any()
    only_input = [_mlp_grad(w, x, y, dict(ex, dropout=0.0, step=s))[0] for s in (0, 1)]
    assert (only_input[0] != only_input[1]).any()


def test_batched_network_learns(spark, table):
    net = FeedForward(hidden=[16], epochs=40, batches=3, lr=0.02, dropout=0.1, inputDropout=0.05, featuresCol="features").fit(
        table.withColumn("features", F.transform("features", lambda v: v / 5)))
    losses = [h["loss"] for h in net.history()]
    assert losses[-1] < 0.5 * losses[0]
