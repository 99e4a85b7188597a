"""The corpus pipeline: quality rules, near copies, benchmark passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import common, decontam, jaccard, packing, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality.judge_quality(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each text: what is decided of a text holds for all its rows, whatever their ids."""
    return docs.select(*COLUMNS).withColumn("__key", F.xxhash64(F.col("text").cast("string")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; rows without an id come last. Rows without a word all stay.

    Texts go through one shuffle at most: the join by id and key, whose order the removal of repeated rows shares.
    """
    rows = _keyed(docs)
    similar = jaccard.similar_documents(rows, id_col="__key")
    found = similar.groupBy(F.col("doc_id").alias("__key")).agg(
        F.first("n_shingles").alias("n"), F.first("component_id").alias("component"))
    found = common.written(found.where("n > 0"), "components")
    common.discard(*similar.tables)
    ids = rows.groupBy("__key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first"))
    stay = found.join(ids, "__key").groupBy("component").agg(F.min(F.struct("first", "__key")).alias("x"))
    stay = common.written(stay.select(F.col("x.first.id").alias("doc_id"), F.col("x.__key").alias("__key")), "stay")
    common.discard(found)
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(worded).join(stay.where("doc_id is not null"), ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    no_id = rows.where(worded & F.col("doc_id").isNull()).join(stay.where("doc_id is null"), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select(*COLUMNS).unionAll(no_id.select(*COLUMNS)).unionAll(rows.where(~worded).select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    rows = _keyed(docs)
    leaks = decontam.find_leaks(rows, common.table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(leaks, "__key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts."""
    rows = pii.find_personal_data(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), pii.sanitised(F.col("text"), F.col("pii")))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of 2048."""
    return packing.pack_documents(docs, "byte_bpe_50k.json", capacity=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Edit distance over all windows and tokenizer ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
