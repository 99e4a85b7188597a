"""Incremental scoring of mutation-list files as they arrive.

The reference has no streaming code; this module only shows that the
stateless mutation operators run unchanged on a Structured Streaming source:
each new CSV file of codes is parsed (X8), checked against the wild type
(P13) and scored against a static model table (J5) through a stream-static
join whose static side (one map per position) is bounded by the protein
length. No state is kept between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqframe.operators import mutants as mz
from seqframe.session import checkpoint_dir


def mutation_stream(spark: SparkSession, source_dir: str, schema: str = "mutant string",
                    max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of mutation codes from CSV files with a header."""
    return (spark.readStream.schema(schema).option("header", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))


def score_stream(codes: DataFrame, wt: DataFrame, log_probs: DataFrame, offset: int = 1) -> DataFrame:
    """Parse, check and score a (streaming or static) table of codes."""
    parsed = mz.parse_mutations(codes, "mutant", offset)
    checked = mz.check_wild_type(parsed, wt, on_mismatch="flag")
    return mz.score_mutations(checked, log_probs, bound_rows=100_000)


def start_scoring(spark: SparkSession, source_dir: str, out_dir: str, wt: DataFrame, log_probs: DataFrame,
                  offset: int = 1, name: str = "mutation_scores", available_now: bool = True):
    """Append scored rows to Parquet; progress is kept under the shared
    checkpoint folder so a restarted query resumes where it stopped."""
    scored = score_stream(mutation_stream(spark, source_dir), wt, log_probs, offset)
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/streams/{name}").option("path", out_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
