"""Metrics (A5-A19) and training-history operators."""

import math

import pytest
from pyspark.sql import functions as F

from seqframe.ml.scaler import PopulationScaler
from seqframe.operators import history as hi
from seqframe.operators import metrics as mt

VAL_LOSSES = [4.2226, 0.9216, 0.7723, 0.5480, 0.5077, 0.4048, 0.4440, 0.3876, 0.3265, 0.2957, 0.2333,
              0.2531, 0.2109, 0.1973, 0.2196, 0.1780, 0.1855, 0.1906, 0.1730, 0.1735]


def test_population_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    m = PopulationScaler(inputCol="x", outputCol="z").fit(df)
    z = [r["z"] for r in m.transform(df).collect()]
    assert [round(v[0], 6) for v in z] == [-1.224745, 0.0, 1.224745]
    assert [v[1] for v in z] == [0.0, 0.0, 0.0]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    assert mt.rmse(df, "y", "p").first()[0] == pytest.approx(math.sqrt(0.5 / 3))
    assert mt.r2(df, "y", "p").first()[0] == pytest.approx(1 - 0.5 / 2.0)
    c = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert mt.r2(c, "y", "p").first()[0] == 1.0
    assert mt.pearson(df, "y", "p").first()[0] == pytest.approx(1.0)


def test_accuracy_masked_and_perplexity(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (-100, 5), (4, 4)], "label int, pred int")
    assert mt.masked_accuracy(df, "label", "pred").first()[0] == pytest.approx(2 / 3)
    lp = spark.createDataFrame([(math.log(0.5),), (math.log(0.25),)], "lp double")
    assert mt.perplexity(lp, "lp").first()[0] == pytest.approx(math.exp(-(math.log(0.5) + math.log(0.25)) / 2))
    b = spark.createDataFrame([(0.5, 10), (1.0, 30)], "loss double, n long")
    assert mt.weighted_loss(b, "loss", "n").first()[0] == pytest.approx((5 + 30) / 40)


def test_best_trial_golden(spark):
    vals = [0.6257, 0.6713, 0.6191, 0.6077, 0.6211]
    df = spark.createDataFrame([(i, v, "p") for i, v in enumerate(vals)], "trial int, value double, params string")
    assert mt.best_trial(df).first()["trial"] == 1
    tie = spark.createDataFrame([(0, 0.5, "a"), (1, 0.7, "b"), (2, 0.7, "c")], "trial int, value double, params string")
    assert mt.best_trial(tie).first()["trial"] == 1


def test_cv_mean_lists_folds(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 0, 0.4), ("b", 0, 0.1)], "candidate string, fold int, score double")
    r = {x["candidate"]: x for x in mt.cv_mean(df).collect()}
    assert r["a"]["mean_score"] == pytest.approx(0.3) and r["a"]["fold_scores"] == [0.4, 0.2]


@pytest.mark.parametrize("patience,stop,best", [(1, 7, 6), (2, 18, 16), (3, None, 19)])
def test_early_stopping_golden(spark, patience, stop, best):
    h = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(VAL_LOSSES)], "run int, epoch int, val_loss double")
    r = hi.early_stopping(h, patience).first()
    assert r["stop_epoch"] == stop and r["best_epoch"] == best


def test_early_stopping_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(hi, "CHUNK", 3)
    h = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(VAL_LOSSES)], "run int, epoch int, val_loss double")
    r = hi.early_stopping(h, 2).first()
    assert (r["stop_epoch"], r["best_epoch"]) == (18, 16)


def test_lr_schedule_golden(spark):
    sched = {r["step"]: r["lr"] for r in hi.lr_schedule(spark, 1180, 1e-5, 500).collect()}
    assert sched[58] == pytest.approx(1.16e-6)
    assert sched[471] == pytest.approx(9.42e-6)
    assert sched[530] == pytest.approx(9.952052e-6, rel=1e-6)


def test_merge_history_and_report(spark):
    rows = [(1, e, "train", float(e)) for e in range(1, 22)] + [(1, e, "eval", 10.0 + e) for e in range(1, 22)]
    m = hi.merge_history(spark.createDataFrame(rows, "run int, epoch int, kind string, value double"))
    rep = sorted(r["epoch"] for r in hi.history_report(m).collect())
    assert rep == [1, 10, 20]
    one = m.where("epoch = 10").first()
    assert (one["loss"], one["eval_loss"]) == (10.0, 20.0)


def test_best_trial_ranks_nan_and_null_last(spark):
    rows = spark.createDataFrame([(0, 0.3), (1, float("nan")), (2, 0.5), (3, None)], "trial int, value double")
    for maximize, want in ((True, 2), (False, 0)):
        assert mt.best_trial(rows, maximize=maximize).first()["trial"] == want


def test_better_never_prefers_nan():
    from seqframe.ml.search import _better
    nan = float("nan")
    assert _better(0.1, nan, True) and not _better(nan, 0.1, True) and not _better(nan, nan, False)
    assert _better(0.2, 0.1, True) and _better(0.1, 0.2, False)
