"""Metrics as aggregations (A5-A16, A18-A22, W1 inside Spearman).

All metrics take a DataFrame with truth ``y`` and prediction ``p`` columns
and an optional grouping ``by`` (folds, candidates, pools); each returns one
row per group. They are plain aggregates with map-side partial aggregation,
so the cost is one pass and a shuffle of one buffer per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions.numeric import argmax_index, bce_with_logits, cross_entropy
from seqframe.operators.ranking import attach_values, rank_moments, value_ranks


def _nan():
    return F.lit(float("nan"))


def _agg(df: DataFrame, by, *cols: Column) -> DataFrame:
    by = list(by or [])
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def pearson_expr(y: str, p: str) -> Column:
    """A6 as an aggregate expression: NaN when either side is constant.

    (Spark's ``corr`` raises under ANSI mode on constant input.)
    """
    sy, sp = F.stddev_pop(y), F.stddev_pop(p)
    r = F.try_divide(F.covar_pop(y, p), sy * sp)
    return F.when((sy == 0) | (sp == 0) | sy.isNull() | sp.isNull(), _nan()).otherwise(r)


def pearson(df: DataFrame, y: str, p: str, by=None, out: str = "pearson") -> DataFrame:
    return _agg(df, by, pearson_expr(y, p).alias(out))


def spearman(df: DataFrame, y: str, p: str, by=None, out: str = "spearman") -> DataFrame:
    """Pearson correlation of average ranks (ties share ranks); NaN on
    constant input.

    Plan: the distinct y are ranked and the ranks attached to the rows (by a
    broadcast while they are few), so that each distinct p has its rows and
    their sum of y ranks; ranks of p are then counted up in range partitions
    whose sums are put together (``rank_moments``). Average ranks have mean (n + 1) / 2, which centres
    the moments without another pass. ``df`` is read twice: predictions
    that are costly to compute should be persisted or written first.
    """
    by = list(by or [])
    ok = (F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(y).cast("double"))
          & ~F.isnan(F.col(p).cast("double")))
    d = df.where(ok).select(*by, F.col(y).alias("_y"), F.col(p).alias("_p"))
    ry, n_values = value_ranks(d, "_y", by, "_ry")
    d = attach_values(d, ry, by, ["_y"], n_values)
    sums = d.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"), F.sum("_ry").alias("_x"),
                                    F.sum(F.col("_ry") * F.col("_ry")).alias("_xx"))
    m = (F.col("n") + 1.0) / 2.0
    cov, vy, vp = [F.try_divide(F.col(c), F.col("n")) - m * m for c in ("xr", "xx", "rr")]
    tiny = F.lit(1e-12) * m * m
    rho = F.when((vy <= tiny) | (vp <= tiny), _nan()).otherwise(F.try_divide(cov, F.sqrt(vy * vp)))
    res = rank_moments(sums, "_p", by).select(*by, rho.alias(out))
    if not by:  # empty input -> NaN
        return res.agg(F.coalesce(F.max(out), _nan()).alias(out))
    return res


def rmse(df: DataFrame, y: str, p: str, by=None, out: str = "rmse") -> DataFrame:
    """sqrt(mean((y - p)^2))."""
    return _agg(df, by, F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias(out))


def r2_expr(y: str, p: str) -> Column:
    """1 - SSres/SStot; constant truth gives 1.0 for an exact fit else 0.0."""
    ss_res = F.sum(F.pow(F.col(y) - F.col(p), 2))
    ss_tot = F.count(F.lit(1)) * F.var_pop(y)
    return F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.try_divide(ss_res, ss_tot))


def r2(df: DataFrame, y: str, p: str, by=None, out: str = "r2") -> DataFrame:
    return _agg(df, by, r2_expr(y, p).alias(out))


def accuracy(df: DataFrame, y: str, p: str, by=None, out: str = "accuracy") -> DataFrame:
    """A10: share of equal labels."""
    return _agg(df, by, F.avg((F.col(y) == F.col(p)).cast("double")).alias(out))


def masked_accuracy(df: DataFrame, label: str, pred: str, ignore=-100, by=None,
                    out: str = "accuracy") -> DataFrame:
    """A11 + P10: accuracy over rows whose label is not ``ignore`` (or null)."""
    kept = df.where(F.col(label).isNotNull() & (F.col(label) != F.lit(ignore)))
    return accuracy(kept, label, pred, by, out)


def weighted_loss(df: DataFrame, loss: str, n: str, by=None, out: str = "loss") -> DataFrame:
    """Epoch loss = sum(batch loss x batch size) / sum(batch size)."""
    return _agg(df, by, F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias(out))


def mse(df: DataFrame, y: str, p: str, by=None, out: str = "mse") -> DataFrame:
    return _agg(df, by, F.avg(F.pow(F.col(y) - F.col(p), 2)).alias(out))


def mean_cross_entropy(df: DataFrame, logits: str, label: str, by=None, out: str = "cross_entropy") -> DataFrame:
    """Mean single-label cross-entropy from logits arrays."""
    return _agg(df, by, F.avg(cross_entropy(logits, label)).alias(out))


def mean_bce(df: DataFrame, logits: str, targets: str, by=None, out: str = "bce") -> DataFrame:
    """Mean multi-label binary cross-entropy with logits."""
    return _agg(df, by, F.avg(bce_with_logits(logits, targets)).alias(out))


def perplexity(df: DataFrame, log_prob: str, by=None, out: str = "perplexity") -> DataFrame:
    """exp(mean negative log-likelihood); overflow gives +inf."""
    return _agg(df, by, F.exp(F.avg(-F.col(log_prob))).alias(out))


def sum_log_prob(df: DataFrame, log_prob: str, by, out: str = "score") -> DataFrame:
    """Sum of per-position log-probabilities per group (mutant)."""
    return _agg(df, by, F.sum(log_prob).alias(out))


def cv_mean(scores: DataFrame, score: str = "score", by=("candidate",), fold: str = "fold") -> DataFrame:
    """Mean fold score with the per-fold listing (ordered by fold)."""
    return _agg(scores, by,
                F.avg(score).alias("mean_score"),
                F.transform(F.array_sort(F.collect_list(F.struct(fold, score))), lambda s: s[score]).alias("fold_scores"))


def best_trial(trials: DataFrame, by=None, trial: str = "trial", value: str = "value",
               maximize: bool = True) -> DataFrame:
    """Best value and its trial; ties go to the lowest trial number.

    A NaN or null value is worse than any number, whichever way is better."""
    v = F.col(value).cast("double")
    real = v.isNotNull() & ~F.isnan(v)
    v = F.when(real, v if maximize else -v)
    key = F.struct(real.alias("r"), v.alias("v"), (-F.col(trial)).alias("t"))
    cols = [c for c in trials.columns if c not in (list(by or []))]
    best = F.max_by(F.struct(*cols), key)
    return _agg(trials, by, best.alias("_b")).select(*(list(by or [])), "_b.*")


def argmax_class(df: DataFrame, scores: str, out: str = "predicted") -> DataFrame:
    """Predicted class = index of the maximum score."""
    return df.withColumn(out, argmax_index(scores))


def max_length(df: DataFrame, seq: str, specials: int = 2, out: str = "max_length") -> DataFrame:
    """Longest sequence plus begin/end tokens (sizes padding)."""
    return df.agg((F.max(F.length(seq)) + F.lit(specials)).cast("int").alias(out))


def has_missing(df: DataFrame, features: str, by=None, out: str = "has_missing") -> DataFrame:
    """Any null or NaN in the feature arrays."""
    bad = F.exists(F.col(features), lambda x: x.isNull() | F.isnan(x))
    return _agg(df, by, F.max(F.coalesce(bad, F.lit(True))).alias(out))


def custom_metric(df: DataFrame, metric, y: str, p: str, by=None, out: str = "score") -> DataFrame:
    """D3: a metric of the user's own, given as a function of the truth and prediction columns that returns an aggregate.

    It is an expression, so it is aggregated partially in every task like the built-in ones; no group is collected.
    """
    return _agg(df, by, metric(F.col(y), F.col(p)).alias(out))


SCORERS = {
    "r2": ("r2", True), "rmse": ("rmse", False), "mse": ("rmse", False),
    "pearson": ("pearson", True), "per": ("pearson", True),
    "spearman": ("spearman", True), "spr": ("spearman", True), "acc": ("accuracy", True),
    "accuracy": ("accuracy", True),
}


def score(df: DataFrame, name: str, y: str, p: str, by=None, out: str = "score") -> DataFrame:
    """H7 table form: the named metric per group. Unknown name raises."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; expected one of {sorted(SCORERS)}")
    fn = {"r2": r2, "rmse": rmse, "pearson": pearson, "spearman": spearman, "accuracy": accuracy}[SCORERS[name][0]]
    return fn(df, y, p, by, out)
