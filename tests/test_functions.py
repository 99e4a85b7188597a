"""Scalar column functions against the known answers of the fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.functions import numeric as nu
from seqframe.functions import sequences as sq
from seqframe.functions import tokens as tk
from seqframe.functions.hashing import stable_hash


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {type_of(v)}" for k, v in cols.items()))
    return df.select(expr.alias("r")).first()["r"]


def type_of(v):
    return {str: "string", int: "bigint", float: "double"}[type(v)]


def test_remove_insertions(spark):
    assert one(spark, sq.remove_insertions("s"), s="MKaT.v*G-") == "MKTG-"


def test_parse_mutation_with_offset(spark):
    r = one(spark, sq.parse_mutation("c", 24), c="H24C")
    assert (r["wt"], r["pos"], r["idx"], r["mt"]) == ("H", 1, 0, "C")
    r = one(spark, sq.parse_mutation("c", 1), c="A123W")
    assert (r["wt"], r["pos"], r["mt"]) == ("A", 123, "W")


def test_prepare_sequence_families(spark):
    assert one(spark, sq.prepare_sequence("s", "spaced"), s="MUKZ") == "M X K X"
    assert one(spark, sq.prepare_sequence("s", "fold"), s="MUKZ") == "<AA2fold> M X K X"
    assert one(spark, sq.prepare_sequence("s", "plain"), s="MUKZ") == "MUKZ"
    assert one(spark, sq.space_residues("s"), s="MKT") == "M K T"
    pair = one(spark, sq.prepare_sequence("s", "pair"), s="MK")
    assert (pair["first"], pair["second"]) == ("MK", "MK")
    with pytest.raises(ValueError):
        sq.prepare_sequence("s", "nope")


def test_residues_and_mutation_helpers(spark):
    assert one(spark, sq.to_residues("s"), s="MKT") == ["M", "K", "T"]
    assert one(spark, sq.apply_mutation("s", F.lit(2), F.lit("A")), s="MKT") == "MAT"
    assert one(spark, sq.format_mutation(F.lit("M"), F.lit(1), F.lit("A")), s="x") == "M1A"
    assert one(spark, sq.residue_at("s", 3), s="MKT") == "T"
    assert one(spark, sq.base_name("s"), s="org/model_t6") == "model_t6"
    assert one(spark, sq.clean_residues("s"), s="m-kß tXBz!") == "MKT"


def test_unwrap_and_squeeze(spark):
    df = spark.createDataFrame([([2.5, 3.0],), ([4.0],)], "a array<double>")
    rows = df.select(sq.unwrap_label("a").alias("u"), sq.squeeze("a").alias("s")).collect()
    assert [r["u"] for r in rows] == [2.5, 4.0]
    assert [r["s"] for r in rows] == [None, 4.0]


def test_sigmoid_score_golden(spark):
    df = spark.createDataFrame([(1.0, 1.0), (10.3613195286157, 7.46360906944558)], "a double, b double")
    got = [r["s"] for r in df.select(nu.sigmoid_score("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(-0.75, abs=1e-12)
    assert got[1] == pytest.approx(-0.00164257656472999, rel=1e-9)


def test_stable_hash_value(spark):
    assert one(spark, stable_hash(42, "k"), k=7) == 1409445407


def test_tokenize_pad_mask(spark):
    ids = one(spark, tk.tokenize("s"), s="LAX")
    assert ids == [tk.BOS_ID, 4, 5, 24, tk.EOS_ID]
    trunc = one(spark, tk.tokenize("s", max_length=4), s="LAGV")
    assert trunc == [0, 4, 5, 2]
    df = spark.createDataFrame([([0, 4, 2],)], "ids array<int>")
    r = df.select(tk.pad("ids", 5).alias("p")).select("p", tk.attention_mask("p").alias("m")).first()
    assert r["p"] == [0, 4, 2, 1, 1] and r["m"] == [1, 1, 1, 0, 0]


def test_losses_match_numpy(spark):
    import numpy as np
    z = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(z, 2, [0.0, 1.0, 1.0])], "z array<double>, y int, t array<double>")
    r = df.select(nu.cross_entropy("z", "y").alias("ce"), nu.bce_with_logits("z", "t").alias("bce"),
                  nu.argmax_index("z").alias("am")).first()
    zz = np.array(z)
    ce = -(zz[2] - math.log(np.exp(zz).sum()))
    bce = np.mean(np.maximum(zz, 0) - zz * np.array([0, 1, 1]) + np.log1p(np.exp(-np.abs(zz))))
    assert r["ce"] == pytest.approx(ce) and r["bce"] == pytest.approx(bce) and r["am"] == 2


def test_place_runs_and_their_order(spark):
    """Neighbouring places become one row; repeated keys, null keys, gaps and a run cut by a batch keep the order by (place, letters)."""
    from seqframe.operators import relational as rel
    rows = [(k, p + 1, c, c == "C") for k, s in ((1, "ACDA"), (1, "GCDE"), (None, "CAC"), (2, "W")) for p, c in enumerate(s)] + [(3, 5, "D", False), (3, 2, "C", True)]
    d = spark.createDataFrame(rows, "k long, pos int, x string, marked boolean")
    r = rel.place_runs(d.coalesce(1), "k", 1)
    assert r.count() == 6
    g = r.groupBy("k").agg(F.sum("n").alias("n"), F.sum("n_marked").alias("m"), F.array_sort(F.collect_list(F.struct("pos", "x", "n"))).alias("r"))
    got = {(x["k"]): (x["n"], x["m"], x["s"]) for x in g.select("k", "n", "m", rel.joined_runs("r", 1).alias("s")).collect()}
    assert got == {1: (8, 2, "AGCCDDAE"), None: (3, 2, "CAC"), 2: (1, 0, "W"), 3: (2, 1, "CD")}


def test_courses_in_bounded_memory():
    """A long sequence and many short ones give plain means and take no more than some 40 MB."""
    import tracemalloc

    from seqframe.operators import features as ft
    rng = np.random.default_rng(3)
    lookup = np.zeros((256, 3))
    for a, v in ft.Z3_HELLBERG.items():
        lookup[ord(a)] = v
    letters = np.frombuffer(b"ACDEFGHIKLMNPQRSTVWY", np.uint8)
    seqs = [rng.choice(letters, n).tobytes().decode() for n in [2_000_000, *[1000] * 2000]] + [None, "", "A"]
    tracemalloc.start()
    got = ft.courses(seqs, lookup, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 1, 1500, 2003):
        z, n = lookup[np.frombuffer(seqs[i].encode(), np.uint8)], len(seqs[i])
        want = [(z[:, d] * np.cos(np.pi * k * (np.arange(n) + 0.5) / n)).mean() for d in range(3) for k in range(6)]
        assert np.allclose(got[i], want, atol=1e-9)
    assert not got[2001].any() and not got[2002].any()
    assert peak < 40 << 20
