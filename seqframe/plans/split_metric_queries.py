"""Registered queries: splits, folds, sampling, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.functions.hashing import stable_hash_sql
from seqframe.functions import numeric as nu
from seqframe.functions.numeric import sigmoid_score
from seqframe.functions.sequences import squeeze, unwrap_label
from seqframe.ml.scaler import PopulationScaler
from seqframe.operators import metrics as mt
from seqframe.operators import relational as rel
from seqframe.operators import split as sp
from seqframe.operators.ranking import average_rank, row_number_by
from seqframe.plans import sqlparts as q
from seqframe.plans.registry import query
from seqframe.sources import tables as t

R = 6

H_SEQ = stable_hash_sql(42, "seq_id")

KFOLD_SQL = q.with_ctes(q.SEQS, body=f"""
SELECT CAST(seq_id AS BIGINT) AS seq_id,
       CAST(ntile(5) OVER (ORDER BY {H_SEQ}, seq_id) - 1 AS INTEGER) AS fold
FROM seqs""")


@query("kfold_assignment", ("W2",), KFOLD_SQL)
def kfold_assignment(spark, sf):
    f = sp.kfold(t.seqs(spark, sf), "seq_id", k=5, seed=42)
    return f.select(F.col("seq_id").cast("bigint"), "fold")


@query("kfold_contiguous", ("W2",), q.with_ctes(q.SEQS, body="""
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(ntile(5) OVER (ORDER BY seq_id) - 1 AS INTEGER) AS fold FROM seqs"""))
def kfold_contiguous(spark, sf):
    f = sp.kfold(t.seqs(spark, sf), "seq_id", k=5, shuffle=False)
    return f.select(F.col("seq_id").cast("bigint"), "fold")


TVT_CTE = q.TVT


@query("train_valid_test_split", ("W3", "P12"),
       q.with_ctes(q.SEQS, TVT_CTE, body="SELECT CAST(seq_id AS BIGINT) AS seq_id, split FROM tvt"))
def train_valid_test_split(spark, sf):
    s = sp.ensure_split(t.seqs(spark, sf), "seq_id", 0.2, 42)
    return s.select(F.col("seq_id").cast("bigint"), "split")


@query("split_counts", ("A20", "P3", "P8", "U1"),
       q.with_ctes(q.SEQS, TVT_CTE, body="SELECT split, count(*) AS n_rows FROM tvt GROUP BY split"))
def split_counts(spark, sf):
    s = sp.train_valid_test(t.seqs(spark, sf), "seq_id")
    parts = [sp.tag_split(sp.filter_split(s, n), n) for n in ("train", "valid", "test")]
    return sp.split_counts(sp.union_splits(*parts))


@query("train_test_split", ("W4",), f"""
SELECT CAST(vec_id AS BIGINT) AS vec_id,
  CASE WHEN row_number() OVER (ORDER BY {stable_hash_sql(7, 'vec_id')}, vec_id) <= ceil(0.2 * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split
FROM embeddings""")
def train_test_split(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id")
    return sp.train_test(e, "vec_id", 0.2, seed=7).select(F.col("vec_id").cast("bigint"), "split")


@query("truncate_per_split", ("W5",), q.with_ctes(q.SEQS, TVT_CTE, body=f"""
, tr AS (SELECT seq_id, split, row_number() OVER (PARTITION BY split ORDER BY {stable_hash_sql(3, 'seq_id')}, seq_id) AS rn,
           count(*) OVER (PARTITION BY split) AS n FROM tvt)
SELECT CAST(seq_id AS BIGINT) AS seq_id, split FROM tr WHERE rn <= ceil(0.5 * n)"""))
def truncate_per_split(spark, sf):
    s = sp.train_valid_test(t.seqs(spark, sf), "seq_id")
    tr = sp.truncate(s, "seq_id", 0.5, seed=3, by=["split"])
    return tr.select(F.col("seq_id").cast("bigint"), "split")


@query("average_ranks", ("W1",), """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag,
  CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS DOUBLE)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS qty_rank
FROM lineitem""")
def average_ranks(spark, sf):
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    r = average_rank(li, "l_quantity", ["l_returnflag"], out="qty_rank")
    return r.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"), "l_returnflag", "qty_rank")


def _pearson_sql(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN 'nan'::DOUBLE "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


RANKCORR_SQL = f"""
WITH x AS (SELECT l_returnflag, l_linestatus, l_quantity AS y, l_extendedprice / l_quantity AS p FROM lineitem),
r AS (SELECT *,
  rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, p) - 1) / 2.0 AS rp
  FROM x)
SELECT l_returnflag, l_linestatus, round({_pearson_sql('ry', 'rp')}, 6) AS spearman,
       round({_pearson_sql('y', 'p')}, 6) AS pearson, count(*) AS n
FROM r GROUP BY l_returnflag, l_linestatus"""


@query("rank_correlation", ("A6", "A7", "W1"), RANKCORR_SQL)
def rank_correlation(spark, sf):
    """Spearman and Pearson of quantity vs unit price per (flag, status)."""
    li = t.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    by = ["l_returnflag", "l_linestatus"]
    s = mt.spearman(li, "y", "p", by)
    pc = li.groupBy(*by).agg(mt.pearson_expr("y", "p").alias("pearson"), F.count(F.lit(1)).alias("n"))
    return s.join(pc, by).select(*by, F.round("spearman", R).alias("spearman"),
                                 F.round("pearson", R).alias("pearson"), "n")


RANKCORR_ALL_SQL = f"""
WITH x AS (SELECT o_totalprice AS y, CAST(o_custkey % 97 AS DOUBLE) AS p FROM orders),
r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
             rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM x)
SELECT round({_pearson_sql('ry', 'rp')}, 6) AS spearman, count(*) AS n FROM r"""


@query("rank_correlation_table", ("A7",), RANKCORR_ALL_SQL)
def rank_correlation_table(spark, sf):
    """Whole-table Spearman (no grouping: bucketed ranks, no global window)."""
    o = t.table(spark, sf, "orders").select(F.col("o_totalprice").alias("y"),
                                             (F.col("o_custkey") % 97).cast("double").alias("p"))
    s = mt.spearman(o, "y", "p")
    n = o.agg(F.count(F.lit(1)).alias("n"))
    return rel.attach_row(s, n).select(F.round("spearman", R).alias("spearman"), "n")


REG_SQL = """
WITH x AS (SELECT l.l_returnflag, l.l_extendedprice / 1000.0 AS y, l.l_quantity * p.p_retailprice / 1000.0 AS p
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT l_returnflag,
  round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(avg((y - p) * (y - p)), 6) AS mse,
  round(CASE WHEN var_pop(y) = 0 THEN (CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END)
        ELSE 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) END, 6) AS r2
FROM x GROUP BY l_returnflag"""


@query("regression_metrics", ("A8", "A9", "A12"), REG_SQL)
def regression_metrics(spark, sf):
    li = t.table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice", "l_quantity")
    pt = t.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    x = li.join(pt, "l_partkey").select(
        "l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("p"))
    by = ["l_returnflag"]
    a = mt.rmse(x, "y", "p", by).join(mt.mse(x, "y", "p", by), by).join(mt.r2(x, "y", "p", by), by)
    return a.select("l_returnflag", *[F.round(c, R).alias(c) for c in ("rmse", "mse", "r2")])


EPOCH_LOSS_SQL = """
WITH b AS (SELECT event_type, user_id, avg(value) AS loss, count(*) AS n FROM events GROUP BY event_type, user_id)
SELECT event_type, round(sum(loss * n) / sum(n), 6) AS loss FROM b GROUP BY event_type"""


@query("epoch_loss", ("A12",), EPOCH_LOSS_SQL)
def epoch_loss(spark, sf):
    """Batch losses (one batch per user and event type) folded into a
    size-weighted epoch loss per event type."""
    ev = t.table(spark, sf, "events")
    b = ev.groupBy("event_type", "user_id").agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n"))
    return mt.weighted_loss(b, "loss", "n", ["event_type"]).select("event_type", F.round("loss", R).alias("loss"))


CLS_SQL = """
WITH e AS (SELECT vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
f AS (SELECT vec_id, label, z, list_max(z) AS m,
        list_transform(range(len(embedding)), lambda i: CASE WHEN i = label THEN 1.0 ELSE 0.0 END) AS y
      FROM e),
g AS (SELECT label, z, y,
        m + ln(list_sum(list_transform(z, lambda v: exp(v - m)))) - z[label + 1] AS ce,
        list_avg(list_transform(list_zip(z, y), lambda p: greatest(p[1], 0.0) - p[1] * p[2] + ln(1 + exp(-abs(p[1]))))) AS bce,
        list_position(z, list_max(z)) - 1 AS pred
      FROM f)
SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(ce), 6) AS cross_entropy, round(avg(bce), 6) AS bce, count(*) AS n
FROM g"""


@query("classification_metrics", ("A10", "A13", "A14", "A22", "P11"), CLS_SQL)
def classification_metrics(spark, sf):
    e = t.table(spark, sf, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("z"))
    e = e.withColumn("y", F.transform(F.sequence(F.lit(0), F.size("z") - 1),
                                      lambda i: F.when(i == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0))))
    e = mt.argmax_class(e, "z", "pred")
    # the four metrics as one aggregation over one scan
    m = e.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
              F.avg(nu.cross_entropy("z", "label")).alias("cross_entropy"),
              F.avg(nu.bce_with_logits("z", "y")).alias("bce"),
              F.count(F.lit(1)).alias("n"))
    return m.select(
        F.round("accuracy", R).alias("accuracy"), F.round("cross_entropy", R).alias("cross_entropy"),
        F.round("bce", R).alias("bce"), "n")


SQUEEZE_SQL = """
SELECT CAST(vec_id AS BIGINT) AS vec_id,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
  round(CAST(embedding[1:1][1] AS DOUBLE), 6) AS squeezed_one,
  CAST(NULL AS DOUBLE) AS squeezed_two
FROM embeddings"""


@query("squeeze_labels", ("P1", "P11"), SQUEEZE_SQL)
def squeeze_labels(spark, sf):
    e = t.table(spark, sf, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").cast("bigint"),
                    F.round(unwrap_label(emb), R).alias("first_value"),
                    F.round(squeeze(F.slice(emb, 1, 1)), R).alias("squeezed_one"),
                    squeeze(F.slice(emb, 1, 2)).cast("double").alias("squeezed_two"))


SCALE_SQL = f"""
WITH s AS (SELECT vec_id, embedding,
    CASE WHEN row_number() OVER (ORDER BY {stable_hash_sql(7, 'vec_id')}, vec_id) <= ceil(0.2 * count(*) OVER ())
         THEN 'test' ELSE 'train' END AS split FROM embeddings),
l AS (SELECT vec_id, split, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS dim,
             CAST(unnest(embedding) AS DOUBLE) AS x FROM s),
st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM l WHERE split = 'train' GROUP BY dim)
SELECT CAST(vec_id AS BIGINT) AS vec_id, dim,
       round((x - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS z
FROM l JOIN st USING (dim)"""


@query("feature_scaling", ("A5", "W4"), SCALE_SQL)
def feature_scaling(spark, sf):
    """z-score every embedding with mean / population std fitted on train."""
    e = sp.train_test(t.table(spark, sf, "embeddings"), "vec_id", 0.2, seed=7)
    model = PopulationScaler(inputCol="embedding", outputCol="z").fit(sp.filter_split(e, "train"))
    z = model.transform(e)
    return z.select(F.col("vec_id").cast("bigint"), F.posexplode("z").alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("bigint"), F.round("z", R).alias("z"))


CV_SQL = f"""
WITH f AS (SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY {stable_hash_sql(42, 'o_orderkey')}, o_orderkey) - 1 AS INTEGER) AS fold FROM orders),
x AS (SELECT l.l_returnflag AS candidate, f.fold, l.l_quantity AS y, l.l_extendedprice AS p
      FROM lineitem l JOIN f ON l.l_orderkey = f.o_orderkey),
r AS (SELECT *,
  rank() OVER (PARTITION BY candidate, fold ORDER BY y) + (count(*) OVER (PARTITION BY candidate, fold, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY candidate, fold ORDER BY p) + (count(*) OVER (PARTITION BY candidate, fold, p) - 1) / 2.0 AS rp
  FROM x),
s AS (SELECT candidate, fold, {_pearson_sql('ry', 'rp')} AS score FROM r GROUP BY candidate, fold)
SELECT candidate, fold, round(score, 6) AS score, round(avg(score) OVER (PARTITION BY candidate), 6) AS mean_score FROM s"""


@query("cv_fold_scores", ("A18", "H7", "W2"), CV_SQL)
def cv_fold_scores(spark, sf):
    """Per-fold Spearman of each candidate and the candidate's mean."""
    folds = sp.kfold(t.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, 42)
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    x = li.join(folds.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(
        F.col("l_returnflag").alias("candidate"), "fold", F.col("l_quantity").alias("y"),
        F.col("l_extendedprice").alias("p"))
    s = mt.score(x, "spearman", "y", "p", ["candidate", "fold"])
    m = mt.cv_mean(s, "score", ["candidate"])
    return s.join(m.select("candidate", "mean_score"), "candidate").select(
        "candidate", "fold", F.round("score", R).alias("score"), F.round("mean_score", R).alias("mean_score"))


BEST_SQL = """
WITH tr AS (SELECT event_type AS study, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS trial,
                   value, props AS params FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS k FROM tr)
SELECT study, CAST(trial AS BIGINT) AS trial, value, params FROM b WHERE k = 1"""


@query("best_trial", ("A19",), BEST_SQL)
def best_trial(spark, sf):
    ev = t.table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    tr = row_number_by(ev, ["event_id"], by=["event_type"], out="rn")
    tr = tr.select(F.col("event_type").alias("study"), (F.col("rn") - 1).alias("trial"), "value",
                   F.col("props").alias("params"))
    b = mt.best_trial(tr, by=["study"])
    return b.select("study", F.col("trial").cast("bigint"), "value", "params")


@query("sigmoid_scores", ("P7", "X13"), """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((1.0 / (1.0 + exp(-(l_quantity / 10.0 - 1.0)))) * (1.0 / (1.0 + exp(-(l_tax * 25.0 - 1.0)))) - 1.0, 6) AS score
FROM lineitem""")
def sigmoid_scores(spark, sf):
    li = t.table(spark, sf, "lineitem")
    s = sigmoid_score(F.col("l_quantity") / 10.0, F.col("l_tax") * 25.0, 1.0)
    return li.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"),
                     F.round(s, R).alias("score"))


@query("custom_metrics", ("D3",), """
SELECT l_returnflag, round(avg(abs(l_extendedprice / 1000.0 - l_quantity)), 6) AS mean_error,
  round(max(abs(l_extendedprice / 1000.0 - l_quantity)), 6) AS worst_error FROM lineitem GROUP BY l_returnflag""")
def custom_metrics(spark, sf):
    """Two metrics given by the caller: mean and worst absolute error."""
    x = t.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_quantity").alias("p"))
    by = ["l_returnflag"]
    mean = mt.custom_metric(x, lambda y, p: F.avg(F.abs(y - p)), "y", "p", by, "mean_error")
    worst = mt.custom_metric(x, lambda y, p: F.max(F.abs(y - p)), "y", "p", by, "worst_error")
    return mean.join(worst, by).select("l_returnflag", F.round("mean_error", R).alias("mean_error"), F.round("worst_error", R).alias("worst_error"))


@query("masked_label_accuracy", ("P10", "A11"), """
WITH e AS (SELECT CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings)
SELECT round(avg(CASE WHEN label = pred % 10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM e WHERE label <> -100""")
def masked_label_accuracy(spark, sf):
    """Accuracy over the rows whose label is not the ignored one."""
    e = mt.argmax_class(t.table(spark, sf, "embeddings"), "embedding", "pred").select(
        F.when(F.col("vec_id") % 7 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"), (F.col("pred") % 10).alias("pred"))
    n = e.where("label <> -100").agg(F.count(F.lit(1)).alias("n"))
    return rel.attach_row(mt.masked_accuracy(e, "label", "pred"), n).select(F.round("accuracy", R).alias("accuracy"), "n")
