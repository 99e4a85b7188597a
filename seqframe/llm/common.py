"""Shared helpers: tables, the shared scratch folder and bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.session import checkpoint_dir

#: Spark's own setting: shuffle files go when the execution that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (set in local tests only when unset)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or checkpoint_dir(spark)).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    The table survives lost executors and cuts the lineage, so nothing above
    it is computed twice. What the write shuffled is removed when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` once every job that reads them has ended in another written result."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batch: pa.RecordBatch, text: int, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``n_bytes`` of text each; ``text`` is the place of that column."""
    lo, size = 0, 0
    for hi, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        size += n or 0
        if size >= n_bytes:
            yield batch.slice(lo, hi + 1 - lo)
            lo, size = hi + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A spread-out 64-bit key of a row, also where the id is null."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), text_or_empty(text_col))).otherwise(
        F.xxhash64(F.lit("id"), F.col(id_col)))
