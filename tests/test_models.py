"""Estimators and model selection (M1-M8, H1-H9) on small fixtures,
compared with dense numpy solutions where one exists."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seqframe.ml import gp, grids
from seqframe.ml import search as se
from seqframe.ml.evaluators import scorer
from seqframe.ml.models import FeedForward, KernelSVR, SparseGP, as_vector, pooled_head


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 4))
    y = np.sin(X[:, 0]) + 0.5 * X[:, 1] ** 2 + 0.3 * X[:, 2] + 0.05 * rng.normal(size=200)
    return spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(200)],
                                 "id long, features array<double>, label double")


def test_lasso_models_match_spark(spark, data):
    t = grids.fold_sets(data, "id", 2)
    w = grids._lasso_weights(t, grids.lasso_models(t, [0.05]), [0.05])[0][0]
    t.unpersist()
    train = grids.kfold(data, "id", 2).where("fold <> 0").drop("fold")
    sc, lr = se.fit_scaled(lambda p: LinearRegression(regParam=0.05, elasticNetParam=1.0, standardization=False,
                                                       featuresCol="features_vec", tol=1e-10, maxIter=500), {}, train)
    assert np.allclose(w[:-1], lr.coefficients.toArray(), atol=1e-4)
    assert w[-1] == pytest.approx(lr.intercept, abs=1e-4)


def test_lasso_cv_and_nested(spark, data):
    cv = se.lasso_cv(data, "id", [0.01, 0.1, 10.0], k=5)
    rows = cv.collect()
    assert len(rows) == 15
    big = [r["score"] for r in rows if r["alpha"] == 10.0]
    assert all(math.isnan(s) for s in big)  # all-zero model: constant predictions -> NaN
    nested = se.lasso_nested_cv(data, "id", [0.01, 0.1, 10.0], k=3).collect()
    assert len(nested) == 3 and all(r["best_alpha"] in (0.01, 0.1) for r in nested)


def test_kernel_svr_gp_network_fit(spark, data):
    ev = scorer("spearman")
    assert ev.evaluate(KernelSVR().fit(data).transform(data)) > 0.8
    gp = SparseGP(nInducing=50, keyCol="id").fit(data).transform(data)
    assert ev.evaluate(gp) > 0.8 and "prediction_std" in gp.columns
    net = FeedForward(hidden=[16, 16], epochs=60, lr=0.02).fit(data)
    assert ev.evaluate(net.transform(data)) > 0.8


def test_network_early_stopping_keeps_best(spark, data):
    net = FeedForward(hidden=[8], epochs=40, lr=0.05, patience=2).setValidation(data.limit(50))
    m = net.fit(data)
    h = m.history()
    assert "val_loss" in h[0]
    best = min(range(len(h)), key=lambda i: h[i]["val_loss"])
    assert m._state()["best_epoch"] == h[best]["epoch"]


def test_pooled_head_multilabel(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 3))
    Y = np.stack([(X[:, 0] > 0), (X[:, 1] > 0)], 1).astype(float)
    df = spark.createDataFrame([(X[i].tolist(), Y[i].tolist()) for i in range(120)], "features array<double>, t array<double>")
    m = pooled_head(hidden=8, dropout=0.0, loss="bce", n_out=2, lr=0.05, epochs=60, labelCol="t").fit(df)
    p = np.array([r["prediction"] for r in m.transform(df).collect()])
    assert ((p > 0.5) == (Y > 0.5)).mean() > 0.85


def test_scorer_and_space_rules():
    with pytest.raises(ValueError):
        scorer("bogus")
    assert scorer("rmse").isLargerBetter() is False and scorer("spr").isLargerBetter() is True
    sp = se.param_space({"lr": [1e-5, 1e-2], "n": [32, 128], "act": ["relu", "tanh"], "d": [0.1, 0.2, 0.3]})
    assert sp["lr"][0] == "log" and sp["n"][0] == "int" and sp["act"][0] == "choice" and sp["d"][0] == "choice"
    with pytest.raises(ValueError):
        se.param_space({"x": [1]})
    assert len(se.grid(se.GRIDS["svr"])) == 125 and len(se.grid(se.GRIDS["linr"])) == 13


def test_grid_and_adaptive_search(spark, data):
    trials, best, fitted = se.grid_search(se.MODELS["linr"], [{"alpha": 0.01}, {"alpha": 5.0}], data, "id", k=3)
    assert best == {"alpha": 0.01} and trials.count() == 2 and fitted is not None
    t2, b2 = se.adaptive_search(se.MODELS["linr"], {"alpha": [1e-3, 1.0]}, data, "id", n_trials=4, k=3)
    assert t2.count() == 4 and 1e-3 <= b2["alpha"] <= 1.0


def test_leaderboard_and_predict_rank(spark, data):
    from seqframe.operators import split as spl
    d = spl.train_test(data, "id", 0.2)
    tr, te = spl.filter_split(d, "train"), spl.filter_split(d, "test")
    board = se.leaderboard(tr, te, "r2").collect()
    assert len(board) == 11 and board[0]["score"] >= board[-1]["score"]
    sc, m = se.fit_scaled(se.MODELS["linr"], {"alpha": 0.01}, tr)
    ranked = [r["prediction"] for r in se.predict_rank(sc, m, te).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_workflow_modes(spark, data):
    cands = [{"alpha": 0.01}, {"alpha": 5.0}]
    pred = data.limit(20)  # a small prediction list for the test
    w = se.workflow(se.MODELS["linr"], cands, data, "id", pred, mode="predict", k=3)
    assert w["best_params"] == {"alpha": 0.01}
    ranked = [r["prediction"] for r in w["ranked"].collect()]
    assert len(ranked) == 20 and ranked == sorted(ranked, reverse=True)
    sel = se.workflow(se.MODELS["linr"], cands, data, "id", mode="select", k=3)
    assert len(sel["default_cv"]) == 3 and len(sel["nested_cv"]) == 3
    with pytest.raises(ValueError):
        se.workflow(se.MODELS["linr"], cands, data, "id", mode="mp")


def test_proposals_follow_good_trials_and_do_not_repeat():
    space = se.param_space({"alpha": [1e-4, 1.0], "n": [1, 100], "act": ["relu", "tanh"]})
    rng = np.random.default_rng(0)
    history = [({"alpha": 10.0 ** -i, "n": 10 * i + 1, "act": "tanh" if i < 2 else "relu"}, -abs(i - 1.0)) for i in range(4)] * 3
    history = [(dict(p, alpha=p["alpha"] * (1 + 0.01 * j)), v) for j, (p, v) in enumerate(history)]
    got = [se._propose(space, history, rng, True) for _ in range(40)]
    assert len({p["alpha"] for p in got}) == 40 and all(1e-4 <= p["alpha"] <= 1.0 and 1 <= p["n"] <= 100 for p in got)
    drawn = [se._sample(space, rng) for _ in range(400)]
    far = lambda ps: np.median([abs(math.log10(p["alpha"]) + 1) for p in ps])
    assert far(got) < 0.8 * far(drawn)


def test_cosine_features_against_a_loop(spark):
    from seqframe.operators import features as ft
    seqs = ["ACD", "", None, "W" * 50 + "é", "MKTAYIAKQR" * 30, "CAD"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, s string").repartition(2)
    got = {r.id: r.features for r in ft.cosine_features(df, "s", ft.Z3_HELLBERG, 4).collect()}
    for i, s in enumerate(seqs):
        if s is None:
            assert got[i] is None
            continue
        want = [sum(ft.Z3_HELLBERG.get(a, [0, 0, 0])[d] * math.cos(math.pi * k * (p + 0.5) / len(s)) for p, a in enumerate(s)) / max(len(s), 1)
                for d in range(3) for k in range(4)]
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[0][0] == pytest.approx(got[5][0]) and got[0][1] != pytest.approx(got[5][1])


def test_gp_of_copied_rows(spark, data, monkeypatch):
    """Many copies of few rows: without a key all inducing rows were copies; where their matrix has no inverse, distinct rows are taken."""
    d = data.where("id < 40").crossJoin(spark.range(60).withColumnRenamed("id", "copy")).select("features", "label")
    real = np.linalg.inv

    def inv(a):  # what 240,000 rows bring about by rounding
        if len({tuple(r) for r in a.round(6).tolist()}) < len(a):
            raise np.linalg.LinAlgError("Singular matrix")
        return real(a)

    monkeypatch.setattr(gp.np.linalg, "inv", inv)
    m = SparseGP(nInducing=30, nRestarts=2, steps=2).fit(d)
    assert len({tuple(z) for z in m._state()["Z"]}) == 30
    assert np.isfinite(m.transform(d).agg(F.sum("prediction")).first()[0])


def test_gp_restarts_without_a_positive_definite_system(monkeypatch):
    """Sums next to which the first jitter is lost by rounding: the set was left without a fit."""
    z, k = np.zeros((20, 2)), np.full(400, 1e12)
    sums = gp.Sums(np.concatenate([k, np.zeros(400), np.full(20, 1e12), np.zeros(20)]), 20)
    monkeypatch.setattr(gp, "evidence_sums", lambda *a: ([[sums] * len(own) for own in a[3]], np.array([1e12])))
    fits = gp.restarts(None, None, [z], np.array([1e12]), 2, 1, 0, 1)[0]
    assert np.isfinite(gp.best(fits).evidence)


def test_stacked_and_random_features_keep_their_values():
    import pandas as pd

    from seqframe.ml.models import _rff
    from seqframe.ml.optim import stacked
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(50, 6)), rng.normal(size=(6, 16)), rng.uniform(size=16)
    assert (stacked(pd.Series(list(x))) == x).all()
    with pytest.raises(ValueError):
        stacked(pd.Series([x[0], x[1][:2], x[2][:4]]))
    assert (_rff(x, w, b) == np.sqrt(2.0 / 16) * np.cos(x @ w + b)).all()
