"""Splits, folds, exact ranks (W1-W5, A7) and their scale-safe plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import metrics as mt
from seqframe.operators import split as sp
from seqframe.operators.ranking import average_rank, row_number_by


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "key")


def test_train_valid_test_sizes(spark):
    s = sp.train_valid_test(ids(spark, 731), "key")
    counts = {r["split"]: r["n_rows"] for r in sp.split_counts(s).collect()}
    assert counts == {"train": 467, "valid": 117, "test": 147}


def test_kfold_sizes_and_disjoint(spark):
    f = sp.kfold(ids(spark, 7), "key", k=5)
    sizes = sorted([r["c"] for r in f.groupBy("fold").agg(F.count("*").alias("c")).collect()], reverse=True)
    assert sizes == [2, 2, 1, 1, 1]
    f2 = sp.kfold(ids(spark, 1003), "key", k=5)
    by_fold = dict(f2.groupBy("fold").count().collect())
    assert by_fold == {0: 201, 1: 201, 2: 201, 3: 200, 4: 200}
    assert f2.select("key").distinct().count() == 1003


def test_split_stable_under_repartition(spark):
    a = {r["key"]: r["split"] for r in sp.train_valid_test(ids(spark, 500), "key").collect()}
    b = {r["key"]: r["split"] for r in sp.train_valid_test(ids(spark, 500).repartition(7), "key").collect()}
    assert a == b


def test_train_test_and_truncate(spark):
    s = sp.train_test(ids(spark, 10), "key", 0.2)
    assert dict(sp.split_counts(s).collect()) == {"test": 2, "train": 8}
    t = sp.truncate(ids(spark, 10), "key", 0.35)
    assert t.count() == 4
    assert sp.truncate(ids(spark, 10), "key", 1.0).count() == 10
    with pytest.warns(UserWarning):
        assert sp.truncate(ids(spark, 10), "key", 1.5).count() == 10


def test_ensure_split_keeps_existing(spark):
    df = ids(spark, 5).withColumn("split", F.lit("train"))
    assert sp.ensure_split(df, "key") is df
    assert "split" in sp.ensure_split(ids(spark, 5), "key").columns


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 3.0), (2, 2.0, 1.0)], "k int, y double, p double")
    r = {row["k"]: row["r"] for row in average_rank(df, "y", out="r").collect()}
    assert r == {0: 1.5, 1: 1.5, 2: 3.0}
    rho = mt.spearman(df, "y", "p").first()["spearman"]
    assert rho == pytest.approx(-0.866025, abs=1e-6)


def test_spearman_constant_is_nan(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(5)], "y double, p double")
    assert math.isnan(mt.spearman(df, "y", "p").first()["spearman"])
    assert math.isnan(mt.pearson(df, "y", "p").first()["pearson"])


def test_spearman_invariant_under_monotone_map(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    s1 = mt.spearman(df, "y", "p").first()[0]
    s2 = mt.spearman(df.withColumn("p", F.exp("p") * 3), "y", "p").first()[0]
    ry, rp = np.argsort(np.argsort(y)), np.argsort(np.argsort(p))
    assert s1 == pytest.approx(s2) and s1 == pytest.approx(np.corrcoef(ry, rp)[0, 1])


def test_row_number_skewed_group_matches_window(spark):
    # one group holds most rows; bucketed numbering must equal the plain window
    rows = [(0 if i % 10 else i % 3 + 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v long")
    got = {(r["g"], r["v"]): r["rn"] for r in row_number_by(df, ["v"], by=["g"], out="rn", buckets=16).collect()}
    from pyspark.sql import Window
    exp = {(r["g"], r["v"]): r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy("v"))).collect()}
    assert got == exp


def test_average_rank_grouped_with_hot_value(spark):
    rows = [("a", 5.0)] * 500 + [("a", float(i)) for i in range(50)] + [("b", float(i % 7)) for i in range(70)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = average_rank(df, "v", ["g"], out="r").groupBy("g", "v").agg(F.first("r").alias("r")).collect()
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    exp = pdf.drop_duplicates(["g", "v"]).set_index(["g", "v"])["r"].to_dict()
    assert {(r["g"], r["v"]): r["r"] for r in got} == exp
