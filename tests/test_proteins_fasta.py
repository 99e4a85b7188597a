"""Scoring many proteins at once against one at a time, unknown neighbours, and record numbers over files and blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions.sequences import ALPHABET
from seqframe.operators import context as ctx
from seqframe.operators import mutants as mz
from seqframe.operators import ranking
from seqframe.sources import files as fs
from seqframe.sources import tables as t


def letters(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.fixture(scope="module")
def proteins(spark):
    rng = random.Random(1)
    rows = [("big", letters(rng, 120)), ("small", letters(rng, 7)), ("one", "M"), (None, letters(rng, 11)), ("odd", "MKXAXXKQ")]
    fam = [(p, i, letters(rng, 130 if p == "big" else 9)) for p, _ in rows for i in range(6 if p == "big" else 2)]
    return (spark.createDataFrame(rows, "protein string, wt_sequence string"),
            spark.createDataFrame(fam, "protein string, seq_id long, sequence string"))


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("strategy", ["wt-marginals", "msa", "masked-marginals", "pseudo-ppl"])
def test_many_proteins_equal_one_at_a_time(spark, monkeypatch, proteins, strategy, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    wt, fam = proteins
    wt, fam = wt.where("protein IS NOT NULL"), fam.where("protein IS NOT NULL")
    model = ctx.context_model_fit(fam)
    res = fam.select("protein", F.posexplode(F.split("sequence", "")).alias("p", "aa")).select("protein", (F.col("p") + 1).cast("int").alias("pos"), "aa")
    first = fam.where("seq_id = 0").select("protein", F.posexplode(F.split("sequence", "")).alias("p", "aa")).select("protein", (F.col("p") + 1).cast("int").alias("pos"), "aa")

    def run(w, r, f, key):
        prof = None
        if strategy == "wt-marginals":
            prof = ctx.site_profile(r, key=key)
        elif strategy == "msa":
            prof = mz.msa_log_probs(r, f, key=key)
        return mz.zero_shot(mz.single_mutations(w, key), w, strategy, profile=prof, context_model=model, key=key)

    together = {(r.protein, r.mutant): r.score for r in run(wt, res, first, ["protein"]).collect()}
    assert len(together) == 20 * (120 + 7 + 1 + 8)
    for name in ("big", "small", "one", "odd") if limit else ("odd",):
        own = fam.where(F.col("protein") == name)
        r1 = t.residues_of(own).drop("seq_id")
        f1 = t.residues_of(own.where("seq_id = 0")).drop("seq_id")
        for row in run(wt.where(F.col("protein") == name).drop("protein"), r1, f1, []).collect():
            got = together[name, row.mutant]
            assert (got is None) == (row.score is None) and (got is None or got == pytest.approx(row.score, abs=1e-9)), (name, row.mutant)


def test_sites_beside_an_unknown_letter_use_the_background(spark, proteins):
    _, fam = proteins
    model = ctx.context_model_fit(fam)
    lp = {(r.prev_aa, r.aa, r.next_aa): r.log_prob for r in model.collect()}
    bg = {a: lp["^", a, "$"] for a in ALPHABET}
    s = "MKXAQ"
    wt = spark.createDataFrame([(s,)], "wt_sequence string")

    def p(a, left, right):
        return lp.get((left, a, right), bg.get(a))

    masked = {(r.pos, r.aa): r.log_prob for r in mz.masked_log_probs(wt, model).collect()}
    assert len(masked) == 5 * 20
    for i in range(5):
        left, right = s[i - 1] if i else "^", s[i + 1] if i < 4 else "$"
        for a in ALPHABET:
            assert masked[i + 1, a] == pytest.approx(p(a, left, right))

    def total(x):
        return sum(p(a, x[i - 1] if i else "^", x[i + 1] if i < len(x) - 1 else "$") or 0.0 for i, a in enumerate(x))

    for r in mz.pseudo_ppl(mz.single_mutations(wt), wt, model).collect():
        assert r.score == pytest.approx(total(s[:r.pos - 1] + r.mt + s[r.pos:]), abs=1e-9)
    out = mz.pseudo_ppl(mz.parse_mutations(spark.createDataFrame([("M1X",), ("M9A",)], "mutant string")), wt, model).collect()
    assert [r.score for r in out] == [None, None]


def test_masked_evaluation_in_one_pass(spark, proteins):
    _, fam = proteins
    model = ctx.context_model_fit(fam)
    sites = ctx.masked_sites_of(fam).collect()
    lp = {(r.prev_aa, r.aa, r.next_aa): r.log_prob for r in model.collect()}
    bg = {a: lp["^", a, "$"] for a in ALPHABET}
    got = {r.model: r for r in ctx.context_model_eval(fam, model).collect()}
    want = [lp.get((r.prev_aa, r.label, r.next_aa), bg[r.label]) for r in sites]
    assert got["context"].n_sites == got["background"].n_sites == len(sites) > 0
    assert got["context"].perplexity == pytest.approx(math.exp(-sum(want) / len(want)))
    assert got["background"].perplexity == pytest.approx(math.exp(-sum(bg[r.label] for r in sites) / len(sites)))
    assert got["background"].accuracy == pytest.approx(sum(r.label == max(sorted(ALPHABET), key=lambda a: bg[a]) for r in sites) / len(sites))


@pytest.mark.parametrize("split", ["128m", "700"])
def test_record_numbers_over_files_and_blocks(spark, tmp_path, split):
    rng = random.Random(4)
    names, n = [], 0
    for f, head in enumerate(["#237 1\n; note\n", "", "! only a comment\n"]):
        text = head
        for _ in range(0 if f == 2 else 60):
            seq = letters(rng, rng.randint(0, 90))
            wrapped = "\n".join(seq[i:i + 20] for i in range(0, len(seq), 20))
            name = rng.choice(["r", "#r", ">r"]) + str(n)
            text += f">{name} some > text\n{wrapped}\n"
            names.append((name, seq))
            n += 1
        (tmp_path / f"f{f}.fasta").write_text(text)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = fs.read_fasta(spark, str(tmp_path)).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, len(names) + 1))
        assert [r.sequence for r in got] == [s for _, s in names]
        assert [r.id.lstrip(">") for r in got] == [x.lstrip(">") for x, _ in names]
        assert [r.sequence for r in fs.read_msa(spark, str(tmp_path), 61).orderBy("rank").collect()] == [s for _, s in names[:61]]
        assert fs.read_wild_type(spark, str(tmp_path)).first().wt_sequence == names[0][1]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
