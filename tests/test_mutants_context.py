"""Mutation scanning, profiles and the context model (Z*, A17, A23, K3-K6)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions.sequences import ALPHABET
from seqframe.operators import context as ctx
from seqframe.operators import features as ft
from seqframe.operators import mutants as mz
from seqframe.sources.tables import residues_of


def wt_table(spark, seq):
    return spark.createDataFrame([(seq,)], "wt_sequence string")


def rand_seq(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) for _ in range(n))


def test_single_mutation_counts(spark):
    assert mz.single_mutations(wt_table(spark, rand_seq(263, 1)), offset=24).count() == 5260
    assert mz.single_residue_mutants(wt_table(spark, rand_seq(237, 2))).count() == 4503
    first = mz.single_mutations(wt_table(spark, "MKT"), offset=24).orderBy("pos", "mt").first()
    assert first["mutant"] == "M24A"


def family(spark, n=40, L=12, seed=3):
    r = random.Random(seed)
    base = rand_seq(L, seed)
    rows = []
    for i in range(n):
        s = "".join(c if r.random() > 0.3 else r.choice(ALPHABET) for c in base)
        rows.append((i, s))
    return spark.createDataFrame(rows, "seq_id long, sequence string")


def test_profile_normalised_and_wt_scores_zero(spark):
    fam = family(spark)
    prof = ctx.site_profile(residues_of(fam))
    sums = prof.groupBy("pos").agg(F.sum(F.exp("log_prob")).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)
    wt = fam.agg(F.min_by("sequence", "seq_id").alias("wt_sequence"))
    scored = mz.score_mutations(mz.single_mutations(wt), prof)
    assert all(abs(r["score"]) < 1e-12 for r in scored.where("wt = mt").collect())


def test_log_softmax(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "C", 2.0), (2, "A", 0.0)], "pos int, aa string, s double")
    out = {(r["pos"], r["aa"]): r["log_prob"] for r in ctx.log_softmax(df, ["pos"], "s").collect()}
    assert out[(1, "C")] == pytest.approx(2.0 - math.log(math.e + math.e ** 2))
    assert out[(2, "A")] == pytest.approx(0.0)


def test_context_model_distribution(spark):
    m = ctx.context_model_fit(family(spark))
    assert m.count() == 21 * 21 * 20
    sums = m.groupBy("prev_aa", "next_aa").agg(F.sum(F.exp("log_prob")).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)


@pytest.mark.parametrize("cells", [1 << 24, 1])
def test_residues_counted_within_tasks(spark, monkeypatch, cells):
    monkeypatch.setattr(ctx, "_CELLS", cells)
    r = random.Random(8)
    odd = ["", None, "A", "MK-T.K*", "é^M$K", "a\U0001f9ecC", "X" * 3, rand_seq(512, 1), rand_seq(513, 2), rand_seq(2000, 3)]
    rows = [(p, i, s) for p in ("p", "q", None) for i, s in enumerate(odd + [rand_seq(r.randint(1, 60), i) for i in range(30)])]
    df = spark.createDataFrame(rows, "protein string, seq_id long, sequence string").repartition(3)
    one = residues_of(df.withColumn("_id", F.struct("protein")), "_id").select("_id.protein", "pos", "aa")
    for key in (["protein"], []):
        plain = one.select(*key, "pos", "aa")
        got, want = ctx.residue_counts(ctx.counted_residues(df, key), key), ctx.residue_counts(plain, key)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        got, want = ([{(x.protein if key else 0, x.pos, x.aa): x.log_prob for x in ctx.site_profile(y, key=key).collect()}
                      for y in (ctx.counted_residues(df, key), plain)])
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # far fewer rows leave a task than there are residues
    many = spark.createDataFrame([(rand_seq(40, i % 3),) for i in range(500)], "sequence string").coalesce(1)
    assert cells == 1 or ctx.counted_residues(many).count() <= 3 * 40


def test_contexts_counted_within_tasks(spark, monkeypatch):
    odd = ["", None, "A", "MK-T.K*", "é^M$K", "a\U0001f9ecCA", "MXK", "M^K$A"]
    df = spark.createDataFrame([(s,) for s in odd + [rand_seq(n, n) for n in range(1, 80)]], "sequence string").repartition(2)
    sites = ctx.neighbour_sites(df, []).where(F.col("aa").isin(list(ALPHABET)))
    known = lambda x, end: F.when(F.col(x).isin(list(ALPHABET + end)), F.col(x))
    want = sites.groupBy(known("prev_aa", "^").alias("prev_aa"), known("next_aa", "$").alias("next_aa"), "aa").count().collect()
    got = ctx.counted_contexts(df).groupBy("prev_aa", "next_aa", "aa").agg(F.sum("n")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert len(ctx.counted_contexts(df.limit(0)).collect()) == 0


def test_pseudo_ppl_delta_equals_brute_force(spark):
    fam = family(spark)
    model = ctx.context_model_fit(fam)
    lp = {(r["prev_aa"], r["aa"], r["next_aa"]): r["log_prob"] for r in model.collect()}
    wt_seq = fam.orderBy("seq_id").first()["sequence"]
    wt = wt_table(spark, wt_seq)
    got = {r["mutant"]: r["score"] for r in mz.pseudo_ppl(mz.single_mutations(wt), wt, model).collect()}

    def total(s):
        return sum(lp[("^" if i == 0 else s[i - 1], s[i], "$" if i == len(s) - 1 else s[i + 1])] for i in range(len(s)))

    for m in ["%s1A" % wt_seq[0], "%s%dW" % (wt_seq[5], 6), "%s%dC" % (wt_seq[-1], len(wt_seq))]:
        pos, mt = int(m[1:-1]), m[-1]
        s = wt_seq[:pos - 1] + mt + wt_seq[pos:]
        assert got[m] == pytest.approx(total(s))


def test_masked_marginals_and_dispatch(spark):
    fam = family(spark)
    model = ctx.context_model_fit(fam)
    wt = fam.agg(F.min_by("sequence", "seq_id").alias("wt_sequence"))
    muts = mz.single_mutations(wt)
    s = mz.zero_shot(muts, wt, "masked-marginals", context_model=model)
    assert s.count() == 12 * 20
    with pytest.raises(ValueError):
        mz.zero_shot(muts, wt, "bogus")


def test_check_wild_type_modes(spark):
    wt = wt_table(spark, "MKT")
    muts = mz.parse_mutations(spark.createDataFrame([("M24A",), ("Q25A",)], "mutant string"), offset=24)
    flags = {r["mutant"]: r["wt_ok"] for r in mz.check_wild_type(muts, wt).collect()}
    assert flags == {"M24A": True, "Q25A": False}
    assert mz.check_wild_type(muts, wt, on_mismatch="drop").count() == 1
    with pytest.raises(ValueError):
        mz.check_wild_type(muts, wt, on_mismatch="error")


def test_heatmap_grid_nan_and_window(spark):
    wt = wt_table(spark, "MKTW")
    scores = spark.createDataFrame([("K2A", 1.5), ("K2A", 0.5), ("T3C", -1.0)], "mutant string, score double")
    g = mz.heatmap_grid(scores, wt, start=2, end=3)
    rows = {(r["aa"], r["number"]): r["score"] for r in g.collect()}
    assert len(rows) == 40 and rows[("A", 2)] == 0.5 and rows[("C", 3)] == -1.0
    assert math.isnan(rows[("D", 2)])


def test_named_zero_shot_strategies(spark):
    fam = family(spark)
    res = residues_of(fam)
    wt = fam.agg(F.min_by("sequence", "seq_id").alias("wt_sequence"))
    muts = mz.single_mutations(wt)
    prof = ctx.site_profile(res)
    a = {r["mutant"]: r["score"] for r in mz.wt_marginals(muts, prof).collect()}
    b = {r["mutant"]: r["score"] for r in mz.zero_shot(muts, wt, "wt-marginals", profile=prof).collect()}
    assert a == b and len(a) == 20 * 12
    model = ctx.context_model_fit(fam)
    c = {r["mutant"]: r["score"] for r in mz.masked_marginals(muts, wt, model).collect()}
    assert len(c) == 240 and all(abs(v) < 1e-12 for k, v in c.items() if k[0] == k[-1])
    q = res.where(F.col("seq_id") == 0)
    m = {r["mutant"]: r["score"] for r in mz.msa_marginals(muts, res, q).collect()}
    assert len(m) == 240 and all(abs(v) < 1e-12 for k, v in m.items() if k[0] == k[-1])


def test_heatmap_wide_given_window(spark):
    wt = wt_table(spark, "MKTW")
    scores = spark.createDataFrame([("K2A", 1.5), ("T3C", -1.0)], "mutant string, score double")
    w = mz.heatmap_wide(mz.heatmap_grid(scores, wt, start=2, end=3), numbers=range(2, 4))
    assert w.columns == ["aa", "2", "3"] and w.count() == 20
    r = {x["aa"]: x for x in w.collect()}
    assert r["A"]["2"] == 1.5 and r["C"]["3"] == -1.0 and math.isnan(r["D"]["2"])


def test_masked_sites_match_window_form(spark):
    fam = spark.createDataFrame([(i, rand_seq(50, i)) for i in range(30)], "seq_id long, sequence string")
    narrow = ctx.masked_sites_of(fam).select("seq_id", "pos", "input", "label", "prev_aa", "next_aa")
    windowed = ctx.masked_sites(ctx.mlm_mask(fam)).select("seq_id", "pos", "input", "label", "prev_aa", "next_aa")
    a, b = sorted(map(tuple, narrow.collect())), sorted(map(tuple, windowed.collect()))
    assert len(a) > 100 and a == b


def test_attach_row(spark):
    from seqframe.operators.relational import attach_row
    df = spark.range(5).withColumnRenamed("id", "x")
    one = df.agg(F.max("x").alias("mx"))
    assert sorted((r["x"], r["mx"]) for r in attach_row(df, one).collect()) == [(i, 4) for i in range(5)]


def test_mlm_mask_rule(spark):
    fam = spark.createDataFrame([(i, rand_seq(200, i)) for i in range(20)], "seq_id long, sequence string")
    m = ctx.mlm_mask(fam)
    stats = m.agg(F.avg(F.col("label").isNotNull().cast("double")).alias("chosen"),
                  F.avg(F.when(F.col("label").isNotNull(), (F.col("input") == "#").cast("double"))).alias("masked")).first()
    assert 0.13 < stats["chosen"] < 0.17 and 0.75 < stats["masked"] < 0.85
    assert m.count() == 4000


def test_mask_each_position(spark):
    df = spark.createDataFrame([(1, "MKT")], "seq_id long, sequence string")
    assert sorted(r["masked"] for r in ctx.mask_each_position(df).collect()) == ["#KT", "M#T", "MK#"]


def test_context_model_eval_rows(spark):
    fam = family(spark, n=60)
    ev = {r["model"]: r for r in ctx.context_model_eval(fam, ctx.context_model_fit(fam)).collect()}
    assert set(ev) == {"context", "background"}
    assert ev["background"]["perplexity"] > 1.0


def test_descriptor_pairs_and_features(spark):
    names = spark.createDataFrame([(n,) for n in ft.REFERENCE_DESCRIPTORS], "descriptor string")
    assert ft.combinations(names).count() == 28
    df = spark.createDataFrame([(1, "ACD")], "id long, sequence string")
    f = ft.aa_features(df, "sequence", ft.Z3_HELLBERG).first()["features"]
    assert f == ft.Z3_HELLBERG["A"] + ft.Z3_HELLBERG["C"] + ft.Z3_HELLBERG["D"]
    wide = ft.aa_features_multi(df, "sequence", ft.BUNDLED)
    pairs = ft.all_descriptor_pairs(wide, "id", list(ft.BUNDLED)).collect()
    assert len(pairs) == 3 and all(len(p["features"]) in (6, 12) for p in pairs)
    with pytest.raises(ValueError):
        ft.descriptor_table(spark, ["ms_whim_scores"])


def test_descriptors_are_looked_up_in_one_pass(spark):
    from seqframe.plans.feature_queries import _checksum
    seqs = ["", None, "A", "AXC", "aC", "é", "ACé", "ACDEFGHIKLMNPQRSTVWY" * 40, rand_seq(70_000, 4)] + [rand_seq(n, n) for n in range(1, 40)]
    df = spark.createDataFrame([(i % 7 or None, s, i) for i, s in enumerate(seqs)], "id long, sequence string, row int").repartition(2)
    wide = ft.aa_features_multi(df, "sequence", ft.BUNDLED)
    assert wide.columns == [*df.columns, *(f"features_{n}" for n in ft.BUNDLED)]
    assert wide._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1

    def vector(s, table):
        return [v for a in s for v in table[a]] if s and all(a in table for a in s) else None

    for r in wide.collect():
        assert (r.id, r.sequence) == (r.row % 7 or None, seqs[r.row])
        for n, table in ft.BUNDLED.items():
            assert r[f"features_{n}"] == vector(r.sequence, table)
    one = ft.aa_features(df, "sequence", ft.Z3_HELLBERG).select("row", F.size("features").alias("n"), _checksum().alias("c"))
    for r in one.collect():
        want = vector(seqs[r.row], ft.Z3_HELLBERG)
        assert (r.c is None) == (want is None)
        assert want is None or r.n == len(want) and r.c == pytest.approx(sum(v * (i % 97 + 1) for i, v in enumerate(want)), abs=1e-3)
    replaced = ft.aa_features(df.withColumn("features", F.lit(1)), "sequence", ft.KYTE_DOOLITTLE)
    assert replaced.columns == [*df.columns, "features"]


def test_pseudo_ppl_keeps_repeated_and_unknown_codes(spark):
    fam = spark.createDataFrame([(i, s) for i, s in enumerate(["MKTAYIAK", "MKTAYLAK", "MRTAYIAR"])], "seq_id long, sequence string")
    model = ctx.context_model_fit(fam)
    wt = spark.createDataFrame([("MKTAYIAK",)], "wt_sequence string")
    codes = spark.createDataFrame([(c,) for c in ["K2A", "K2A", "T3G", "K2X", "K99A"]], "mutant string")
    rows = mz.pseudo_ppl(mz.parse_mutations(codes), wt, model).collect()
    assert len(rows) == 5
    score = {}
    for r in rows:
        score.setdefault(r["mutant"], set()).add(r["score"])
    assert all(len(x) == 1 for x in score.values())
    assert score["K99A"] == {None} and None not in score["K2A"]
