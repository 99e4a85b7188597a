"""Token ids as Parquet files: a list column with dictionary pages, bounded row groups and page indexes.

Rows are in ascending id order, so a read of some documents, or of the counts
alone, touches only the row groups, pages and columns that it needs.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.llm.common import shared_dir, text_or_empty
from seqframe.llm.tokenize import encoded

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
                    ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
                      encoding: str = "dictionary", compression: str = "zstd",
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each row's text, append ``end_id`` and write the ids in ascending id order.

    Texts are range-partitioned before they are encoded (fewer bytes than ids);
    the text's hash splits an id that very many rows share. ``encoding``:
    ``dictionary``, or ``delta`` for DELTA_BINARY_PACKED. Null texts count as
    empty; null ids come first; rows of one id follow each other in no set
    order. Row groups hold about ``row_group_bytes``; pages at most
    ``page_rows`` rows, each with its bounds in the page index.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is {encoding!r}, not dictionary or delta")
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(batches, 1, tokenizer):
            lo = 0
            while lo < len(ids):  # about 2 million ids at a time
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size < 8_000_000):
                    size += len(ids[hi])
                    hi += 1
                own = [x + tail for x in ids[lo:hi]]
                n = np.array([len(x) // 4 for x in own], np.int64)
                ends = np.cumsum(n)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(own))])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.full(hi - lo, part, np.int32)),
                     pa.array(at + ends - n), pa.array(n), pa.ListArray.from_arrays(offsets, values)], schema=_ARROW)
                at += int(ends[-1])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    (rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)
     .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", encoding == "dictionary").option("compression", compression).parquet(path))


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """The files' rows; ``columns`` and ``where`` (on doc_id, say) reach the Parquet scan."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the metadata columns alone: no token is read."""
    rows = read_token_files(spark, path, ["doc_id", "part", "start_in_part", "n_tokens"])
    return rows.join(F.broadcast(_part_starts(rows)), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens")


def _part_starts(rows: DataFrame) -> DataFrame:
    """Ids before each written partition; one row per partition, which bounds the window and the broadcast."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids, all as read from the files."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                              pa.array((ends[1:] - ends[:-1]) // 4), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path)
    crcs = rows.select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return crcs.join(F.broadcast(_part_starts(rows)), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def new_token_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
