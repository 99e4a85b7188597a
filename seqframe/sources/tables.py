"""Driver tables and the derived views the operators work on.

``seqs(seq_id, sequence)``: all residues of each ``documents.text`` (ASCII
letters in the 20-letter alphabet, upper-cased), rows with at least one. This is
the family; a position beyond a sequence's end has nothing from it.
``references(seq_id, sequence)``: the same from ``benchmark``; the lowest
``seq_id`` is the wild type.
``labelled(seq_id, sequence, label)``: seqs joined with ``labels.quality``.
``residues(seq_id, pos, aa)``: seqs exploded, ``pos`` from 1.
``vectors(seq_id, pos, embedding)``: ``embeddings`` with ``label`` as seq_id
and ``vec_id`` as pos (per-residue vectors to pool).
``history(run, epoch, val_loss)``: ``events`` with ``user_id`` as run, row
number by ``event_id`` as epoch, ``value`` as loss.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.sequences import ALPHABET, clean_residues
from seqframe.operators.ranking import row_number_by

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _sequences(texts: DataFrame, id_col: str) -> DataFrame:
    # the filter stops at the first residue, so readers of keys alone clean no text
    return (texts.where(F.col("text").rlike(f"[{ALPHABET}{ALPHABET.lower()}]"))
            .select(F.col(id_col).alias("seq_id"), clean_residues("text", ALPHABET).alias("sequence")))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(table(spark, sf_dir, "documents"), "doc_id")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(table(spark, sf_dir, "benchmark"), "item_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"),
                                                F.col("quality").cast("double").alias("label"))
    return seqs(spark, sf_dir).join(lab, "seq_id")


def residues_of(df: DataFrame, key: str = "seq_id", seq: str = "sequence") -> DataFrame:
    """Long table (key, pos, aa), pos 1-based. Narrow: no shuffle."""
    return (df.select(key, F.posexplode(F.split(seq, "")).alias("p", "aa"))
            .select(key, (F.col("p") + 1).cast("int").alias("pos"), "aa"))


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues_of(seqs(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("seq_id"), F.col("vec_id").alias("pos"),
                    F.col("embedding"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    h = row_number_by(ev, ["event_id"], by=["user_id"], out="epoch")
    return h.select(F.col("user_id").alias("run"), "epoch", F.col("value").alias("val_loss"))


def wild_type(seq_df: DataFrame, key: str = "seq_id", seq: str = "sequence") -> DataFrame:
    """One-row table with the sequence of the lowest key (global min_by)."""
    return seq_df.agg(F.min_by(seq, key).alias("wt_sequence"), F.min(key).alias("wt_id"))
