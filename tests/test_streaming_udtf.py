"""Streaming scoring of arriving mutation lists; the SQL UDTF generator."""

import os

from pyspark.sql import functions as F

from seqframe.functions.udtf import register
from seqframe.operators import context as ctx
from seqframe.sources.tables import residues_of
from seqframe.streaming.scoring import start_scoring


def test_stream_scores_new_files(spark, tmp_dir):
    fam = spark.createDataFrame([(1, "MKTW"), (2, "MKSW"), (3, "AKTW")], "seq_id long, sequence string")
    prof = ctx.site_profile(residues_of(fam))
    wt = spark.createDataFrame([("MKTW",)], "wt_sequence string")
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("mutant\nM1A\nT3S\nQ2A\n")
    out = os.path.join(tmp_dir, "out")
    q = start_scoring(spark, src, out, wt, prof, offset=1, name="t1")
    q.awaitTermination(120)
    rows = {r["mutant"]: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"M1A", "T3S", "Q2A"}
    assert rows["M1A"]["wt_ok"] and not rows["Q2A"]["wt_ok"]
    assert rows["T3S"]["score"] < 0  # S is rarer than T at position 3


def test_single_mutants_udtf(spark):
    register(spark)
    rows = spark.sql("SELECT * FROM single_mutants('MK', 24)").collect()
    assert len(rows) == 40 and rows[0]["mutant"] == "M24A" and rows[0]["pos"] == 1
    n = spark.sql("SELECT count(*) AS n FROM VALUES ('MKT'), ('GG') AS t(s), LATERAL single_mutants(s, 1)").first()["n"]
    assert n == 100
