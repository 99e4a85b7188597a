"""Splits by distributed selection and ranks by range partitions, against plain sorting."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqframe.operators import metrics as mt
from seqframe.operators import ranking
from seqframe.operators import selection as sel
from seqframe.operators import split as sp


def h32(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("bits", [16, 3])
def test_hash_parts_equal_sorting(spark, monkeypatch, bits):
    monkeypatch.setattr(sel, "BITS", bits)
    keys = list(range(1003))
    df = spark.createDataFrame([(k, "payload") for k in keys], "key long, t0 string").repartition(6)
    order = sorted(keys, key=lambda k: (h32(42, k), k))
    fold = {r.key: r.fold for r in sp.kfold(df, "key", 7).collect()}
    sizes = [1003 // 7 + (i < 1003 % 7) for i in range(7)]
    want = [i for i, n in enumerate(sizes) for _ in range(n)]
    assert [fold[k] for k in order] == want
    s = {r.key: r.split for r in sp.train_valid_test(df, "key").collect()}
    n_test = math.ceil(0.2 * 1003)
    n_valid = math.ceil(0.2 * (1003 - n_test))
    assert [s[k] for k in order] == ["test"] * n_test + ["valid"] * n_valid + ["train"] * (1003 - n_test - n_valid)
    flat = {r.key: r.fold for r in sp.kfold(df, "key", 7, shuffle=False).collect()}
    assert [flat[k] for k in keys] == want


def test_more_folds_than_rows_and_no_rows(spark):
    df = spark.range(3).withColumnRenamed("id", "key")
    assert sorted(r.fold for r in sp.kfold(df, "key", 5).collect()) == [0, 1, 2]
    assert sp.kfold(df.limit(0), "key", 5).count() == 0 and sp.train_test(df.limit(0), "key").count() == 0
    assert [r.split for r in sp.train_valid_test(df.where("key = 1"), "key").collect()] == ["test"]


def test_repeated_and_null_keys_share_a_part(spark):
    keys = [None] * 40 + ["hot"] * 300 + [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    got = defaultdict(set)
    rows = sp.kfold(df, "key", 4).collect()
    for r in rows:
        got[r.key].add(r.fold)
    assert len(rows) == len(keys) and all(len(f) == 1 for f in got.values())
    places = Counter(r.fold for r in rows)
    assert all(abs(n - 210) <= 300 for n in places.values())


def test_truncate_by_group_with_null_group(spark):
    rows = [(i, g) for i, g in enumerate(["a"] * 101 + ["b"] * 3 + [None] * 10 + ["c"])]
    df = spark.createDataFrame(rows, "key long, g string").repartition(4)
    got = defaultdict(set)
    for r in sp.truncate(df, "key", 0.5, seed=3, by=["g"]).collect():
        got[r.g].add(r.key)
    for g in ("a", "b", None, "c"):
        own = sorted((k for k, x in rows if x == g), key=lambda k: (h32(3, k), k))
        assert got[g] == set(own[:math.ceil(0.5 * len(own))])


def test_split_does_not_shuffle_the_rows(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("key"), F.lit("text").alias("payload")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = sp.train_valid_test(df, "key")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("payload" in line for line in scans) == 1
    for line in plan.splitlines():  # what is exchanged holds keys, hashes and counts alone
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            assert "payload" not in line
    top = plan[:plan.index("FileScan")]
    assert "Exchange hashpartitioning" not in top.split("BroadcastExchange")[0] and "Sort " not in top.split("BroadcastExchange")[0]


def ranks(values):
    order = sorted(values)
    first, count = {}, Counter(values)
    for i, v in enumerate(order):
        first.setdefault(v, i)
    return [first[v] + (count[v] + 1) / 2 for v in values]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_average_rank_in_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0.0] * 5 + [rng.randint(0, 400) / 4, float("nan"), None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, v double").repartition(5)
    got = {r.k: r.r for r in ranking.average_rank(df, "v", ["g"], "r").collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = [(k, v) for k, x, v in rows if x == g and v is not None and v == v]
        for (k, _), r in zip(own, ranks([v for _, v in own])):
            assert got[k] == r
    assert all(got[k] is None for k, _, v in rows if v is None or v != v)


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(va * vb) if va and vb else float("nan")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_spearman_with_ties_groups_and_hot_values(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        y = rng.choice([0, 0, rng.randint(0, 9)])
        p = rng.choice([0.5, y + rng.random(), float("nan")]) if i % 50 else None
        rows.append((rng.choice(["a", "b", None]), y, p))
    rows += [("flat", 1, float(i)) for i in range(5)] + [("one", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(6)
    got = {r.g: r.spearman for r in mt.spearman(df, "y", "p", ["g"]).collect()}
    for g in ("a", "b", None):
        own = [(y, p) for x, y, p in rows if x == g and p is not None and p == p]
        assert got[g] == pytest.approx(pearson(ranks([y for y, _ in own]), ranks([p for _, p in own])), abs=1e-9)
    assert math.isnan(got["flat"]) and math.isnan(got["one"])
    own = [(y, p) for _, y, p in rows if p is not None and p == p]
    whole = mt.spearman(df, "y", "p").first()["spearman"]
    assert whole == pytest.approx(pearson(ranks([y for y, _ in own]), ranks([p for _, p in own])), abs=1e-9)
    assert math.isnan(mt.spearman(df.limit(0), "y", "p").first()["spearman"])
