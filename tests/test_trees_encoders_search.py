"""Random trees, batched encoders, descriptor pairs, staged search and model loading."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seqframe.ml import search as se
from seqframe.ml import trees as tr
from seqframe.ml.models import FeedForward
from seqframe.operators import features as ft
from seqframe.operators import pooling as pl
from seqframe.sources import runs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 5)), 1)
    x[:, 4] = 1.0  # constant
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=150)
    return x, y, spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(150)], "features array<double>, label double").repartition(7)


@pytest.mark.parametrize("sums", [1 << 24, 2000])
def test_trees_equal_a_plain_loop_with_the_same_cuts(data, monkeypatch, sums):
    monkeypatch.setattr(tr, "MAX_SUMS", sums)
    x, y, df = data
    m = tr.RandomTrees(numTrees=3, maxDepth=4, maxBins=16, minRows=2, seed=9).fit(df)
    b = tr.to_bins(x, np.array(m._state()["edges"]))
    splits = 0
    for k, tree in enumerate(m.trees()):
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, own, depth = todo.pop()
            assert tree["n"][node] == len(own) and tree["value"][node] == pytest.approx(y[own].mean())
            table = np.zeros((5, 16, 3))
            for j in range(5):
                for i in own:
                    table[j, b[i, j]] += (1, y[i], y[i] ** 2)
            cuts = tr.random_cuts(table, 9, k, node)
            ss = lambda rows: ((y[rows] - y[rows].mean()) ** 2).sum() if len(rows) else 0.0
            gains = {j: ss(own) - ss(own[b[own, j] < c]) - ss(own[b[own, j] >= c]) for j, c in enumerate(cuts) if c >= 0}
            if tree["feature"][node] < 0:
                assert depth == 4 or len(own) < 4 or not gains or max(gains.values()) < 1e-9
                continue
            splits += 1
            j, c = int(tree["feature"][node]), int(tree["cut"][node])
            assert c == cuts[j] and gains[j] == pytest.approx(max(gains.values())) and tree["gain"][node] == pytest.approx(gains[j])
            left = own[b[own, j] < c]
            assert 0 < len(left) < len(own)
            todo += [(int(tree["child"][node]), left, depth + 1), (int(tree["child"][node]) + 1, own[b[own, j] >= c], depth + 1)]
    assert splits > 10
    got = {tuple(r.features): r.prediction for r in m.transform(df).collect()}
    want = np.mean([t["value"][tr.place_rows(b, t)] for t in m.trees()], axis=0)
    assert all(got[tuple(x[i])] == pytest.approx(want[i]) for i in range(150))


def test_trees_learn(data, spark):
    x, y, df = data
    m = tr.RandomTrees(numTrees=20, maxDepth=6, maxBins=32).fit(df)
    p = np.array([r.prediction for r in m.transform(df).collect()])
    t = np.array([r.label for r in m.transform(df).collect()])
    assert ((p - t) ** 2).mean() < 0.2 * t.var()
    flat = spark.createDataFrame([([1.0], 2.0)] * 5, "features array<double>, label double")
    assert {r.prediction for r in tr.RandomTrees(numTrees=2).fit(flat).transform(flat).collect()} == {2.0}


def test_batched_pools_equal_one_at_a_time(spark):
    class Counting(pl.WindowEncoder):
        def encode(self, tokens, lengths):
            assert tokens.size <= 60 or len(tokens) == 1
            assert (tokens[np.arange(tokens.shape[1])[None, :] >= lengths[:, None]] == 0).all()
            return pl.WindowEncoder.encode(self, tokens, lengths)

    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYX"), rng.integers(1, 40))) for _ in range(50)] + [None, "", "A" * 200]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(seqs)], "id long, s string, pools int").repartition(3)
    enc = Counting(ft.Z3_HELLBERG, window=2)
    got = {r.id: r.p for r in pl.embed_pools(df, "s", enc, ("mean", "max", "sum", "global"), "p", max_tokens=60).collect()}
    plain = pl.descriptor_window_encoder(ft.Z3_HELLBERG, window=2)
    for i, s in enumerate(seqs):
        if not s:
            assert got[i].mean is None and got[i].sum is None
            continue
        v = plain(s)
        near = [np.mean([ft.Z3_HELLBERG.get(a, [0, 0, 0]) for a in s[max(0, p - 2):p + 3]], axis=0) for p in range(len(s))]
        assert v[:, 3:] == pytest.approx(np.array(near))
        assert got[i].mean == pytest.approx(v.mean(0)) and got[i].max == pytest.approx(v.max(0)) and got[i].sum == pytest.approx(v.sum(0))
        assert got[i]["global"] == pytest.approx(np.concatenate([v.mean(0), v.max(0)]))
    rows = pl.pool_compare_input(df, "s", plain, out="f")
    assert rows.count() == 3 * len(seqs) and rows.columns == ["id", "s", "pools", "pool", "f"]
    with pytest.raises(ValueError):
        pl.embed(df, "s", plain, "median")
    at = pl.batches_of(np.array([5, 1, 30, 2, 2]), 10)
    assert sorted(i for b in at for i in b) == [0, 1, 2, 3, 4] and [len(b) for b in at] == [3, 1, 1]


def test_descriptor_pairs(spark, tmp_path):
    tables = {f"d{i}": {a: [float(i), ord(a) / 10.0][:1 + i % 2] for a in "ACD"} for i in range(8)}
    desc = ft.descriptor_table(spark, list(tables), tables)
    df = spark.createDataFrame([(1, "ACDA"), (2, "D"), (3, "AX"), (4, None)], "id long, s string")
    ft.write_descriptor_pairs(ft.descriptor_pairs(df, "id", "s", desc), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("pair=*"))) == 28
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert len(rows) == 28 * 4
    code = lambda s, n: [v for a in s for v in tables[n][a]]
    for r in rows:
        a, b = r.pair.split("+")
        want = None if r.id in (3, 4) else code({1: "ACDA", 2: "D"}[r.id], a) + code({1: "ACDA", 2: "D"}[r.id], b)
        assert a < b and r.features == want


def test_staged_search_resumes_and_keeps_failed_trials(spark, tmp_path):
    calls = []

    def evaluate(p):
        calls.append(p)
        if p.get("lr", 1.0) < 1e-3:
            raise ValueError("diverged")
        return -abs(p["n"] - 40) - abs(math.log10(p.get("lr", 1e-1)) + 1)

    stages = [{"n": [1, 100]}, {"lr": [1e-5, 1.0]}]
    whole, best, count = se.staged_search(spark, evaluate, stages, str(tmp_path / "whole"), 6)
    rows = whole.orderBy("stage", "trial").collect()
    assert count == 12 == len(rows) == len(calls) and sum(r.kept for r in rows) == 1
    failed = [r for r in rows if r.error]
    assert all(math.isnan(r.value) and "diverged" in r.error and not r.kept for r in failed)
    first = max((r for r in rows if r.stage == 1), key=lambda r: r.value)
    assert all(json.loads(r.params)["n"] == json.loads(first.params)["n"] for r in rows if r.stage == 2)
    top = max((r for r in rows if not r.error), key=lambda r: r.value)
    assert json.loads(top.params) == best
    # a run that stops after some trials goes on to the same trials
    part = str(tmp_path / "part")
    left = iter([None] * 8)

    def stops(p):
        if next(left, 0) == 0:
            raise KeyboardInterrupt
        return evaluate(p)

    with pytest.raises(KeyboardInterrupt):
        se.staged_search(spark, stops, stages, part, 6)
    again, best_again, evaluated = se.staged_search(spark, evaluate, stages, part, 6)
    assert evaluated == 4 and best_again == best
    assert [(r.stage, r.trial, r.params, r.error) for r in again.orderBy("stage", "trial").collect()] == [(r.stage, r.trial, r.params, r.error) for r in rows]
    assert se.staged_search(spark, evaluate, stages, part, 6)[2] == 0
    none = se.staged_search(spark, lambda p: 1 / 0, stages[:1], str(tmp_path / "none"), 2)
    assert none[1] is None and none[0].where("error <> ''").count() == 2


def test_bare_models_load(spark, data, tmp_path):
    _, _, df = data
    vec = df.withColumn("v", F.col("features"))
    from seqframe.ml.models import as_vector
    lr = LinearRegression(featuresCol="features_vec").fit(as_vector(vec))
    for name, model, inp in (("lr", lr, as_vector(vec)), ("trees", tr.RandomTrees(numTrees=2, maxDepth=2).fit(df), df),
                             ("net", FeedForward(hidden=[4], epochs=2).fit(df), df)):
        runs.save_model(model, str(tmp_path / name))
        back = runs.load_model(str(tmp_path / name))
        a, b = [sorted(r.prediction for r in m.transform(inp).collect()) for m in (model, back)]
        assert a == b
