"""Token counts through a digest cache.

Each text's digest, joined with the tokenizer's version digest, is looked up in
a stored table. Only distinct misses are encoded, and their counts are appended
to the table, so copies and later runs cost a hash and a join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm.common import text_or_empty, written
from seqframe.llm.tokenize import encoded, tokenizer_digest

#: A text with more than this share of all rows is joined by broadcast: fewer than so many digests of 32 bytes.
OFTEN = 1000
CACHE = "digest binary, n_tokens long, tokenizer string"
#: Ways to normalise a text before its digest. ``exact`` fits every tokenizer;
#: ``lower`` only one that lower-cases and drops white space itself.
NORMAL = {"exact": lambda c: c, "lower": lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))}


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored (digest, n_tokens) of this tokenizer version; a repeated append counts once."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer_digest(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", normal: str = "exact",
               text_col: str = "text") -> None:
    """Encode the distinct texts whose digest the cache lacks and append their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = NORMAL[normal](text_or_empty(text_col))
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, path, tokenizer).select("digest"), "digest", "left_anti")

    def run(batches):
        for batch, ids in encoded(batches, 1, tokenizer):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([version] * len(ids))],
                names=["digest", "n_tokens", "tokenizer"])

    misses.mapInArrow(run, CACHE).write.mode("append").parquet(path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 512,
                 normal: str = "exact", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty (0 bytes, 0 tokens). Ids may be null or
    repeated; each row gives one row. Other columns are ignored. The join back
    is on the digest. A text that more than one row in ``OFTEN`` holds is
    joined by broadcast, where its rows lie: fewer than ``OFTEN`` texts can.
    """
    fill_cache(docs, cache_path, tokenizer, normal, text_col)
    own = text_or_empty(text_col)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(own).cast("long").alias("n_bytes"),
                               F.unhex(F.sha2(NORMAL[normal](own), 256)).alias("digest")), "digests")
    counts = read_cache(docs.sparkSession, cache_path, tokenizer)
    often = rows.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") * OFTEN > rows.count()).select("digest")
    often = written(counts.join(F.broadcast(often), "digest"), "often")
    seldom = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti")
    found = rows.join(F.broadcast(often), "digest").unionByName(seldom.join(counts, "digest"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
