"""One registered query per operator, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import common
from seqframe.llm import (decontam, jaccard, langid, licenses, packing, passages, pii, quality, ranked_search, token_cache, token_files,
                          url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Host and path rules with their verdicts (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of pages whose id is labelled as low quality or toxic; other pages of a listed URL are caught by it."""
    pages = common.table(spark, sf_dir, "pages")
    bad = common.table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("page_id"))
    return url_filter.filter_urls(pages, pages.select("page_id", "url").join(bad, "page_id", "left_semi"), URL_RULES)


ORACLE["op1_url_filter"] = url_filter.oracle_sql(
    "pages", "SELECT url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)", URL_RULES)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = langid.language_profiles(docs.where(fold != 2))
    found = langid.identify_languages(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's place follows the input folder: a second run over the same folder encodes nothing anew."""
    place = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    cache = f"{common.shared_dir(spark)}/token_counts/{place}"
    return token_cache.count_tokens(common.table(spark, sf_dir, "documents"), cache, TOKENIZER, limit=512)


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.find_personal_data(docs, keep_text=False)
    counts = [F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    base = pii.span_text(F.filter("pii", lambda x: x["kind"] < 4))
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, keep_text=False).select("doc_id", *[f"quality.{x}" for x in QUALITY_COLUMNS])


QUALITY_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
ORACLE["op6_quality_rules"] = quality.oracle_sql(f"SELECT doc_id, {', '.join(QUALITY_COLUMNS)} FROM judged")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(common.table(spark, sf_dir, "documents"), length=5, percent=80)


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), percent=80)


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(common.table(spark, sf_dir, "documents"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_token_path(spark)
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=0)
    return token_files.token_checksums(spark, path)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, fit = whitening.whiten(common.table(spark, sf_dir, "embeddings"), k=8)
    return whitening.component_rows(out.withColumn("deviation", F.col("deviation").cast("long")), fit)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=20)


ORACLE["op12_ranked_search"] = ranked_search.ORACLE_SQL


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(licenses.scan_licenses(common.table(spark, sf_dir, "documents")))
