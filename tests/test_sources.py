"""File sources and sinks (S1-S10) with temporary-folder round trips."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from seqframe.ml.scaler import PopulationScaler
from seqframe.sources import files as fs
from seqframe.sources import runs


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


FASTA = "#237 1\n>sp|P1|GFP first record\nMKT\nAAG\n>second x>y\nGG-X\n>third\nWWW\n"
A3M = ">query\nMKTAA\n>hom1\nMKaT.AA*\n>hom2\nM-TAAc\n"


def test_read_fasta(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.fasta"), FASTA)
    rows = fs.read_fasta(spark, p).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["sp|P1|GFP", "second", "third"]
    assert [r["sequence"] for r in rows] == ["MKTAAG", "GG-X", "WWW"]
    assert rows[1]["description"] == "second x>y"
    assert [r["rank"] for r in rows] == [1, 2, 3]


def test_read_wild_type_and_msa(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "b.fasta"), FASTA)
    wt = fs.read_wild_type(spark, p).first()
    assert (wt["wt_id"], wt["wt_sequence"]) == ("sp|P1|GFP", "MKTAAG")
    m = write(os.path.join(tmp_dir, "c.a3m"), A3M)
    msa = fs.read_msa(spark, m, nseq=2).orderBy("rank").collect()
    assert [r["aligned"] for r in msa] == ["MKTAA", "MKTAA"]
    assert all(len(r["aligned"]) == 5 for r in fs.read_msa(spark, m).collect())


def test_fasta_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "MKT"), (2, "GGA")], "id long, sequence string")
    out = os.path.join(tmp_dir, "out_fasta")
    fs.write_fasta(df.coalesce(1), out)
    back = {r["id"]: r["sequence"] for r in fs.read_fasta(spark, out).collect()}
    assert back == {"1": "MKT", "2": "GGA"}


def test_feature_csv_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("MK", [1.0, 2.0], 0.5, "train")], "sequence string, features array<double>, label double, split string")
    out = os.path.join(tmp_dir, "feat_csv")
    fs.write_feature_csv(df, out, "sequence", "features", n_features=2)
    back = fs.read_csv_table(spark, out, "sequence string, `0` double, `1` double, label double, split string").first()
    assert back.asDict() == {"sequence": "MK", "0": 1.0, "1": 2.0, "label": 0.5, "split": "train"}


def test_write_predictions_sorted(spark, tmp_dir):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "mutant string, score double")
    out = os.path.join(tmp_dir, "pred")
    fs.write_predictions(df, out, "score", fmt="parquet")
    assert sorted(r["score"] for r in spark.read.parquet(out).collect()) == [0.1, 0.5, 0.9]


def test_split_json(spark, tmp_dir):
    for name, label in (("train", "[1.5]"), ("valid", "2.5"), ("test", "[3.5]")):
        write(os.path.join(tmp_dir, f"{name}.json"),
              '[{"primary": "MKT", "protein_length": 3, "log_fluorescence": %s, "num_mutations": 1, "id": 1}]' % label)
    df = fs.read_split_json(spark, tmp_dir, schema="primary string, protein_length int, log_fluorescence string, num_mutations int, id long")
    from seqframe.functions.sequences import unwrap_label
    lab = F.coalesce(unwrap_label(F.from_json("log_fluorescence", "array<double>")), F.col("log_fluorescence").cast("double"))
    got = {r["split"]: r["label"] for r in df.select("split", lab.alias("label")).collect()}
    assert got == {"train": 1.5, "valid": 2.5, "test": 3.5}


def test_training_history(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "run.log"), "CUDA available: False\n"
              "{'loss': 0.9, 'grad_norm': 1.5, 'learning_rate': 1.16e-06, 'epoch': 1.0}\n"
              "{'eval_loss': 0.92, 'eval_spearmanr': 0.3, 'eval_runtime': 1.2, 'epoch': 1.0}\n")
    rows = fs.read_training_history(spark, p).collect()
    assert len(rows) == 2 and rows[0]["loss"] == 0.9 and rows[1]["eval_spearmanr"] == 0.3


def test_run_log_and_model_persistence(spark, tmp_dir):
    path = os.path.join(tmp_dir, "runs")
    runs.append_run_log(spark, path, "r1", {"score": 0.5, "params": {"alpha": 0.1}})
    runs.append_run_log(spark, path, "r2", {"score": 0.6})
    assert runs.read_run_log(spark, path).count() == 3
    df = spark.createDataFrame([([1.0],), ([3.0],)], "x array<double>")
    model = Pipeline(stages=[PopulationScaler(inputCol="x", outputCol="z")]).fit(df)
    mp = os.path.join(tmp_dir, "model")
    runs.save_model(model, mp)
    back = runs.load_model(mp)
    assert [r["z"] for r in back.transform(df).collect()] == [[-1.0], [1.0]]


def test_read_fasta_many_files_and_hash_headers(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    write(os.path.join(d, "a.fasta"), "# note\n>one\nAC\n>#two\nDE\n")
    write(os.path.join(d, "b.fasta"), ">three\n" + "\n".join(["ACDEFGHIKL"] * 50) + "\n>four\nMK\n")
    rows = fs.read_fasta(spark, d).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in rows] == [(1, "one"), (2, "#two"), (3, "three"), (4, "four")]
    assert fs.read_wild_type(spark, d).first()["wt_id"] == "one"
    assert [r["id"] for r in fs.read_msa(spark, d, nseq=3).orderBy("rank").collect()] == ["one", "#two", "three"]


def test_feature_csv_refuses_a_width_that_drops_features(spark, tmp_dir):
    df = spark.createDataFrame([("AC", [1.0, 2.0, 3.0])], "sequence string, features array<double>")
    with pytest.raises(Exception, match="more than 2 features"):
        fs.write_feature_csv(df, os.path.join(tmp_dir, "w"), "sequence", n_features=2)
