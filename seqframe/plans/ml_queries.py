"""Registered queries: estimators and model selection (rows-only checks).

Inputs are the labelled family (``labelled``: documents-derived sequences
with ``labels.quality``) featurised by the courses of descriptors along the whole
sequence, and the ``embeddings`` table. Iterative fits have no SQL equivalent.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from seqframe.ml import grids
from seqframe.ml import search as se
from seqframe.ml.evaluators import scorer
from seqframe.ml.models import FeedForward, SparseGP, pooled_head
from seqframe.ml.trees import RandomTrees
from seqframe.operators import features as ft
from seqframe.operators import metrics as mt
from seqframe.operators import mutants as mz
from seqframe.operators import pooling as pl
from seqframe.operators import split as sp
from seqframe.plans.registry import query
from seqframe.session import cut_lineage, literal_table
from seqframe.sources import tables as t

R = 6
ALPHAS = se.GRIDS["linr"]["alpha"]


ALPHA_SPACE = [1e-4, 3e-2]


def _courses(df, seq):
    return ft.cosine_features(df, seq, ft.Z3_HELLBERG)


def _featurised(spark, sf):
    """Key, features and label, written once: the fits read no text."""
    return cut_lineage(_courses(t.labelled(spark, sf), "sequence").select("seq_id", "features", "label"))


def _train_test(spark, sf):
    d = cut_lineage(sp.train_test(_featurised(spark, sf), "seq_id", 0.2, seed=42))
    return sp.filter_split(d, "train"), sp.filter_split(d, "test")


@query("lasso_cv_scores", ("M1", "H1", "H5", "H7", "A18", "W2"))
def lasso_cv_scores(spark, sf):
    """5-fold Spearman of every alpha of the Lasso grid, with the mean."""
    s = se.lasso_cv(_featurised(spark, sf), "seq_id", ALPHAS)
    m = mt.cv_mean(s, "score", ["candidate"]).select("candidate", "mean_score")
    return s.join(m, "candidate").select("fold", "candidate", "alpha", F.round("score", R).alias("score"),
                                         F.round("mean_score", R).alias("mean_score"))


@query("lasso_nested_cv", ("H6", "H1", "M1", "A19"))
def lasso_nested_cv(spark, sf):
    """Nested CV: inner grid search per outer fold, outer-fold scores."""
    return se.lasso_nested_cv(_featurised(spark, sf), "seq_id", ALPHAS)


KKT_SQL = f"""SELECT CAST(o AS INTEGER) AS outer_fold, CAST(i AS INTEGER) AS inner_fold, alpha, CAST(0 AS INTEGER) AS violations
FROM (SELECT unnest(generate_series(0, 4)) AS o), (SELECT unnest(generate_series(-1, 4)) AS i),
  (SELECT unnest([{', '.join(repr(float(a)) for a in se.GRIDS['linr']['alpha'])}]::DOUBLE[]) AS alpha)"""


@query("lasso_kkt", ("M1", "H6"), KKT_SQL)
def lasso_kkt(spark, sf):
    """Optimality of every coefficient vector of the nested Lasso run (5 x 6 training sets, 13 alphas), checked
    against the residuals of a pass over the rows: no coordinate breaks the conditions."""
    s = grids.fold_sets(_featurised(spark, sf), "seq_id", nested=True)
    k = grids.lasso_kkt(s, ALPHAS)
    s.unpersist()
    return k.select(F.col("o").alias("outer_fold"), F.col("fold").alias("inner_fold"), "alpha", "violations")


@query("svr_grid_search", ("M2", "H1", "H7"))
def svr_grid_search(spark, sf):
    """All 125 candidates of the kernel-regression grid over 5 folds, fitted together."""
    trials, _ = grids.grid_trials("svr", se.grid(se.GRIDS["svr"]), _featurised(spark, sf), "seq_id", n_components=64)
    return trials.select("trial", "params", F.round("value", R).alias("value"), "best")


@query("svr_nested_cv", ("M2", "H6"))
def svr_nested_cv(spark, sf):
    """The same grid inside every outer fold: 30 training sets x 125 candidates in the same number of passes."""
    n = grids.nested_trials("svr", se.grid(se.GRIDS["svr"]), _featurised(spark, sf), "seq_id", n_components=32)
    return n.select("fold", "best_params", F.round("inner_score", R).alias("inner_score"), F.round("score", R).alias("score"))


@query("gpr_grid_search", ("M3", "H1"))
def gpr_grid_search(spark, sf):
    """Gaussian processes with 5, 10, 15 and 20 restarts over 5 folds, restarts moved together."""
    trials, _ = grids.grid_trials("gpr", se.grid(se.GRIDS["gpr"]), _featurised(spark, sf), "seq_id", n_inducing=48, steps=8)
    return trials.select("trial", "params", F.round("value", R).alias("value"), "best")


@query("gpr_nested_cv", ("M3", "H6"))
def gpr_nested_cv(spark, sf):
    n = grids.nested_trials("gpr", se.grid(se.GRIDS["gpr"]), _featurised(spark, sf), "seq_id", n_inducing=24, steps=6)
    return n.select("fold", "best_params", F.round("inner_score", R).alias("inner_score"), F.round("score", R).alias("score"))


@query("kernel_svr_cv", ("M2", "H5"))
def kernel_svr_cv(spark, sf):
    """5-fold scores of the default kernel SVR (random Fourier features)."""
    scores = se.cross_validate(se.MODELS["svr"], {}, _featurised(spark, sf), "seq_id")
    return literal_table(spark, [(i, float(s)) for i, s in enumerate(scores)], ["fold", "score"])


@query("sparse_gp_predict", ("M3", "M8", "A6", "A8", "A9", "W4"))
def sparse_gp_predict(spark, sf):
    """GP fitted on the train split, scored on test (mean and spread)."""
    tr, te = _train_test(spark, sf)
    sc, m = se.fit_scaled(lambda p: SparseGP(nInducing=64, keyCol="seq_id", featuresCol="features_vec"), {}, tr)
    p = se.predict_scaled(sc, m, te)
    return p.agg(F.count(F.lit(1)).alias("n"), mt.pearson_expr("label", "prediction").alias("pearson"),
                 F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("rmse"),
                 mt.r2_expr("label", "prediction").alias("r2"), F.avg("prediction_std").alias("mean_std"))


@query("tree_ensemble_score", ("M4",))
def tree_ensemble_score(spark, sf):
    """50 extremely randomised trees grown level by level, one pass a level."""
    tr, te = _train_test(spark, sf)
    sc, m = se.fit_scaled(lambda p: RandomTrees(numTrees=50, maxDepth=6, featuresCol="features_vec"), {}, tr)
    p = se.predict_scaled(sc, m, te)
    return mt.spearman(p, "label", "prediction").select(F.round("spearman", R).alias("spearman"))


def _emb_splits(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                                                F.col("label").cast("double").alias("label"))
    return sp.train_valid_test(e, "vec_id", 0.2, 42)


@query("feedforward_embeddings", ("M5", "W6", "W3", "A10", "A12"))
def feedforward_embeddings(spark, sf):
    """2-hidden-layer network on embeddings (10 classes, cross-entropy),
    early stopping on the validation split; per-epoch history with the test
    accuracy of the kept (best) weights."""
    s = _emb_splits(spark, sf)
    net = FeedForward(hidden=[64, 64], loss="ce", nOut=10, lr=5e-3, epochs=30, batches=2, patience=5, dropout=0.1)
    net.setValidation(sp.filter_split(s, "valid"))
    m = net.fit(sp.filter_split(s, "train"))
    acc = scorer("acc").evaluate(m.transform(sp.filter_split(s, "test")))
    hist = [(int(h["epoch"]), float(h["loss"]), float(h.get("val_loss", float("nan"))), float(acc)) for h in m.history()]
    return literal_table(spark, hist, ["epoch", "loss", "val_loss", "test_accuracy"])


@query("pooled_head_multilabel", ("M6", "A14"))
def pooled_head_multilabel(spark, sf):
    """One-hidden-layer tanh head with binary cross-entropy on one-hot
    targets (multi-label form); mean test BCE of the predictions."""
    s = _emb_splits(spark, sf).withColumn(
        "targets", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label").cast("int")).cast("double")))
    head = pooled_head(hidden=32, dropout=0.1, loss="bce", n_out=10, lr=5e-3, epochs=15, labelCol="targets")
    m = head.fit(sp.filter_split(s, "train"))
    p = m.transform(sp.filter_split(s, "test"))
    return mt.mean_bce(p, "scores", "targets").select(F.round("bce", R).alias("bce"))


@query("two_stage_network", ("H9", "H3", "M6", "S9"))
def two_stage_network(spark, sf):
    """Hidden size and dropout of the pooled head first, then its learning rate, over a stored run table. The search is called
    again on that table: ``evaluated_again`` is the number of trials it repeats, none."""
    import uuid

    from seqframe.session import scratch_path

    s = cut_lineage(_emb_splits(spark, sf))
    tr, va = sp.filter_split(s, "train"), sp.filter_split(s, "valid")

    def make(p):
        return pooled_head(hidden=int(p["hidden"]), dropout=float(p["dropout"]), lr=float(p.get("lr", 5e-3)), loss="ce", n_out=10, epochs=6,
                           batches=2, featuresCol="features_vec")

    args = (make, {"hidden": [16, 64], "dropout": [0.0, 0.1, 0.3]}, {"lr": [1e-3, 1e-1]}, tr, va,
            scratch_path(spark, f"trials-{uuid.uuid4().hex}"), 3, "acc")
    se.two_stage_search(*args)
    trials, _, again = se.two_stage_search(*args)
    return trials.select("stage", "trial", "params", F.round("value", R).alias("value"), "kept", F.lit(again).alias("evaluated_again"))


@query("regressor_leaderboard", ("M7", "T1"))
def regressor_leaderboard(spark, sf):
    tr, te = _train_test(spark, sf)
    return se.leaderboard(tr, te, "spearman").select("model", F.round("score", R).alias("score"))


@query("predict_rank_mutants", ("M8", "H10", "Z2", "T1"))
def predict_rank_mutants(spark, sf):
    """Fit on the labelled family, predict every single-residue mutant of
    the wild type, ranked (the unseen prediction list)."""
    lab = _featurised(spark, sf)
    wt = t.wild_type(t.references(spark, sf))
    muts = _courses(mz.single_residue_mutants(wt), "mutant_sequence")
    w = se.workflow(se.MODELS["linr"], [{"alpha": 0.001}, {"alpha": 0.01}], lab, "seq_id", muts, mode="predict")
    return w["ranked"].select("mutant", F.round("prediction", R).alias("prediction"),
                              F.lit(json.dumps(w["best_params"])).alias("params"))


@query("adaptive_search_trials", ("H3", "H4", "A19"))
def adaptive_search_trials(spark, sf):
    trials, best = se.adaptive_search(se.MODELS["linr"], {"alpha": ALPHA_SPACE}, _featurised(spark, sf), "seq_id",
                                      n_trials=8, k=3)
    return trials.select("trial", "params", F.round("value", R).alias("value"))


@query("default_vs_tuned", ("H8",))
def default_vs_tuned(spark, sf):
    tr, te = _train_test(spark, sf)
    r = se.default_vs_tuned(se.MODELS["linr"], {"alpha": ALPHA_SPACE}, tr, te, "seq_id", n_trials=4)
    return literal_table(spark, [(float(r["default"]), float(r["tuned"]), float(r["reported"]),
                                  json.dumps(r["best_params"]))], ["default", "tuned", "reported", "best_params"])


@query("pool_compare", ("F4",))
def pool_compare(spark, sf):
    """Window-descriptor encoder + mean/max/sum pooling, one Lasso per pool."""
    enc = pl.descriptor_window_encoder(ft.Z3_HELLBERG, window=2)
    lab = t.labelled(spark, sf)
    e = pl.pool_compare_input(lab, "sequence", enc, out="features")
    # encoded once; a sequence's rows share a part, as splits go by key
    d = cut_lineage(sp.train_test(e.select("seq_id", "pool", "features", "label"), "seq_id", 0.2, 42))
    rows = []
    for pool in ("mean", "max", "sum"):
        part = d.where(F.col("pool") == pool)
        sc, m = se.fit_scaled(se.MODELS["linr"], {"alpha": 0.01}, sp.filter_split(part, "train"))
        rows.append((pool, float(scorer("spearman").evaluate(se.predict_scaled(sc, m, sp.filter_split(part, "test"))))))
    return literal_table(spark, rows, ["pool", "spearman"])


@query("random_search_trials", ("H2", "H4"))
def random_search_trials(spark, sf):
    trials, best, _ = se.random_search(se.MODELS["linr"], {"alpha": ALPHA_SPACE}, _featurised(spark, sf), "seq_id",
                                       n_iter=6, k=3, refit=False)
    return trials.select("trial", "params", F.round("value", R).alias("value"))


@query("model_persistence_roundtrip", ("S7", "S8", "S9", "M8", "J8"))
def model_persistence_roundtrip(spark, sf):
    """Scaler + Lasso pipeline fitted on train, saved to and loaded from the
    shared folder, predictions on test written sorted, the score appended
    to a run table; returns the written predictions."""
    import uuid

    from pyspark.ml import Pipeline

    from seqframe.ml.models import lasso
    from seqframe.ml.scaler import ArrayToVector, PopulationScaler
    from seqframe.session import scratch_path
    from seqframe.sources import files as fs
    from seqframe.sources import runs

    tr, te = _train_test(spark, sf)
    pipe = Pipeline(stages=[PopulationScaler(inputCol="features", outputCol="scaled"),
                            ArrayToVector(inputCol="scaled", outputCol="features_vec"), lasso(0.01)])
    base = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    runs.save_model(pipe.fit(tr), f"{base}/model")
    pred = runs.load_model(f"{base}/model").transform(te).select("seq_id", "label", "prediction")
    fs.write_predictions(pred, f"{base}/predictions", "prediction", fmt="parquet")
    back = spark.read.parquet(f"{base}/predictions")
    runs.append_run_log(spark, f"{base}/runs", "lasso_0.01", {"spearman": scorer("spearman").evaluate(back)})
    return back.select("seq_id", "label", F.round("prediction", R).alias("prediction"))
