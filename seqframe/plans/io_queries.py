"""Registered queries: sources and sinks as round trips through files that
Spark writes from the given tables into the shared checkpoint folder, plus
column-layout and numeric helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqframe.functions import numeric as nu
from seqframe.functions import sequences as sq
from seqframe.functions.sequences import ALPHABET
from seqframe.operators import features as ft
from seqframe.operators import relational as rel
from seqframe.operators import split as sp
from seqframe.plans import sqlparts as q
from seqframe.plans.registry import query
from seqframe.session import scratch_path
from seqframe.sources import files as fs
from seqframe.sources import tables as t

R = 6


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("fasta_roundtrip", ("S3", "S5", "X12"),
       q.with_ctes(q.SEQS, body="SELECT CAST(seq_id AS VARCHAR) AS id, sequence FROM seqs"))
def fasta_roundtrip(spark, sf):
    """The aligned family written as FASTA and read back (records split at
    '\\n>' by the text source, so the read is parallel)."""
    path = _scratch(spark, "fasta")
    fs.write_fasta(t.seqs(spark, sf).withColumnRenamed("seq_id", "id"), path)
    back = fs.read_msa(spark, path)
    return back.select("id", F.col("aligned").alias("sequence"))


NSEQ = 300
FASTA_DEPTH_SQL = q.with_ctes(q.SEQS, body=f"""
, n AS (SELECT seq_id, sequence, row_number() OVER (ORDER BY seq_id) AS rank FROM seqs)
SELECT CAST(rank AS BIGINT) AS rank, CAST(seq_id AS VARCHAR) AS id, sequence AS aligned, rank = 1 AS wild_type
FROM n WHERE rank <= {NSEQ}""")


@query("fasta_depth", ("S3", "S4", "S5", "T3", "X12"), FASTA_DEPTH_SQL)
def fasta_depth(spark, sf):
    """The family written as FASTA over several files in key order and read back: record numbers over all files and
    their blocks, the first ``NSEQ`` records (the alignment depth) and the first record as wild type."""
    path = _scratch(spark, "fasta_depth")
    s = t.seqs(spark, sf).withColumnRenamed("seq_id", "id")
    fs.write_fasta(s.repartitionByRange(5, "id").sortWithinPartitions("id"), path)
    msa = rel.first_n(fs.read_msa(spark, path, NSEQ), "rank", NSEQ)
    wt = fs.read_wild_type(spark, path).select(F.lit(1).cast("bigint").alias("rank"), F.lit(True).alias("_wt"),
                                               F.col("wt_id").alias("id"), F.col("wt_sequence").alias("sequence"))
    back = msa.join(wt, ["rank", "id", "sequence"], "left")
    return back.select("rank", "id", "aligned", F.coalesce("_wt", F.lit(False)).alias("wild_type"))


@query("training_history_lines", ("S10",), """
SELECT CAST(event_id AS DOUBLE) AS epoch, value AS loss, CASE WHEN event_id % 2 = 0 THEN value / 2 END AS eval_loss FROM events""")
def training_history_lines(spark, sf):
    """Training logs written as lines of dictionaries among other lines, and read back as a table."""
    path = _scratch(spark, "history")
    ev = t.table(spark, sf, "events").select("event_id", "value")
    extra = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(", 'eval_loss': "), (F.col("value") / 2).cast("string"))).otherwise("")
    line = F.concat(F.lit("{'loss': "), F.col("value").cast("string"), extra, F.lit(", 'epoch': "), F.col("event_id").cast("double").cast("string"), F.lit("}"))
    ev.select(F.explode(F.array(line, F.lit("Some weights were not used"))).alias("value")).write.text(path)
    return fs.read_training_history(spark, path).select("epoch", "loss", "eval_loss")


FEATURE_CSV_SQL = q.with_ctes(q.RESIDUES, [
    "lab AS (SELECT doc_id AS seq_id, CAST(quality AS DOUBLE) AS label FROM labels)",
], body=f"""
SELECT CAST(r.seq_id AS BIGINT) AS seq_id, CAST({len(ALPHABET)} AS BIGINT) AS n_features,
       round(avg(strpos('{ALPHABET}', r.aa)), 4) AS checksum, max(l.label) AS label
FROM residues r JOIN lab l USING (seq_id)
GROUP BY r.seq_id""")


@query("feature_csv_roundtrip", ("S1", "S6", "P4", "P5", "P6", "J1"), FEATURE_CSV_SQL)
def feature_csv_roundtrip(spark, sf):
    """Wide feature CSV (sequence, "0".."19", label) written and read back
    with an explicit schema; the block between sequence and label becomes
    one array again (positional slice)."""
    lab = t.labelled(spark, sf)
    f = rel.sequence_first(ft.composition(lab, "sequence"), "sequence")
    path = _scratch(spark, "feature_csv")
    fs.write_feature_csv(f.select("sequence", "features", "label", "seq_id"), path, "sequence", "features",
                         n_features=len(ALPHABET))
    cols = ", ".join(f"`{i}` double" for i in range(len(ALPHABET)))
    back = fs.read_csv_table(spark, path, f"sequence string, {cols}, label double, seq_id bigint")
    block = rel.feature_block(back, "sequence", "label")
    block = rel.select_rename(block, {"seq_id": "seq_id", "features": "features", "label": "label"})
    chk = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return block.select("seq_id", F.size("features").cast("bigint").alias("n_features"),
                        F.round(chk, 4).alias("checksum"), "label")


SPLIT_JSON_SQL = q.with_ctes(q.SEQS, q.TVT, [
    "lab AS (SELECT doc_id AS seq_id, CAST(quality AS DOUBLE) AS label FROM labels)"], body="""
SELECT CAST(s.seq_id AS BIGINT) AS id, s.split, l.label AS label
FROM tvt s JOIN lab l USING (seq_id)""")


@query("split_json_roundtrip", ("S2", "P1", "P3", "U1"), SPLIT_JSON_SQL)
def split_json_roundtrip(spark, sf):
    """Labelled splits written as JSON files (train labels as one-element
    lists, others scalar), read back, tagged by file and unwrapped."""
    s = sp.train_valid_test(t.seqs(spark, sf), "seq_id")
    lab = t.table(spark, sf, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").cast("double").alias("q"))
    s = s.join(lab, "seq_id")
    base = _scratch(spark, "splits")
    for name in fs.SPLITS:
        part = s.where(F.col("split") == name)
        lf = F.array("q") if name == "train" else F.col("q")
        part.select(F.col("sequence").alias("primary"), F.length("sequence").alias("protein_length"),
                    lf.alias("log_fluorescence"), F.lit(0).alias("num_mutations"), F.col("seq_id").alias("id")) \
            .write.mode("overwrite").json(f"{base}/{name}.json")
    schema = "primary string, protein_length int, log_fluorescence string, num_mutations int, id bigint"
    back = fs.read_split_json(spark, base, schema=schema, multi_line=False)
    lf = F.col("log_fluorescence")
    label = F.coalesce(sq.unwrap_label(F.from_json(lf, "array<double>")), lf.try_cast("double"))
    return back.select("id", "split", label.alias("label"))


@query("numeric_functions", ("X13", "X14", "X15", "X16"), """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(1.0 / (1.0 + exp(-(l_quantity - 25.0) / 10.0)), 6) AS sig,
  round(greatest(l_quantity - 25.0, 0.0), 6) AS relu,
  round(tanh(l_discount * 10.0), 6) AS tanh,
  round(ln(l_extendedprice) + sqrt(l_quantity), 6) AS logsqrt
FROM lineitem""")
def numeric_functions(spark, sf):
    li = t.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"),
                     F.round(nu.sigmoid((F.col("l_quantity") - 25.0) / 10.0), R).alias("sig"),
                     F.round(nu.relu(F.col("l_quantity") - 25.0), R).alias("relu"),
                     F.round(nu.tanh(F.col("l_discount") * 10.0), R).alias("tanh"),
                     F.round(F.log(F.col("l_extendedprice")) + F.sqrt("l_quantity"), R).alias("logsqrt"))


@query("pair_inputs", ("X7", "X6"), q.with_ctes(q.SEQS, body="""
SELECT CAST(seq_id AS BIGINT) AS seq_id, sequence AS first, sequence AS second FROM seqs"""))
def pair_inputs(spark, sf):
    s = t.seqs(spark, sf).select("seq_id", sq.prepare_sequence("sequence", "pair").alias("p"))
    return s.select(F.col("seq_id").cast("bigint"), "p.first", "p.second")
