"""File sources and sinks.

FASTA/A3M are read with Spark's text source using '\\n>' as the record
separator: records split at any line boundary followed by '>', so a large
file is read in parallel splits and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqframe.functions.sequences import remove_insertions

SPLITS = ("train", "valid", "test")


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV. Pass a schema in production (inference reads twice)."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_split_json(spark: SparkSession, directory: str, names=SPLITS, stem: str = "{name}.json",
                    schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """One JSON input per split, tagged with its split name and stacked.

    ``multi_line`` reads one JSON document (array of records) per file;
    False reads JSON Lines (splittable). Label columns that are arrays in
    some files are unwrapped with P1 by the caller (``unwrap_label``)."""
    parts = []
    for n in names:
        r = spark.read.option("multiLine", multi_line)
        if schema is not None:
            r = r.schema(schema)
        parts.append(r.json(f"{directory}/{stem.format(name=n)}").withColumn("split", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """S3: (rank, id, description, sequence).

    Comment lines before the first record ('#', '!', ';') are skipped; wrapped
    sequence lines are joined; id is the first word of the header. ``rank`` is
    the record order (file, then byte offset), so first-n stays well defined:
    a record's place in its block of the file, which one task reads, plus the
    records of all earlier blocks. No window holds more than a block, but
    for the one over the blocks' counts.
    """
    block = ["_file", "_block"]
    raw = (spark.read.option("lineSep", "\n>").text(path)
           .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_order")))
    order = Window.partitionBy(*block).orderBy("_order")
    raw = raw.withColumn("_n", F.row_number().over(order))
    # only a file's first chunk can be a comment: a later one followed a ">" and is a record, whatever it begins with
    lead = (F.col("_block") == 0) & (F.col("_n") == 1) & F.col("value").rlike(r"^[#!;]")
    v = F.when(lead, F.regexp_replace("value", r"^(?:[#!;][^\n]*(?:\n|$))+", "")).otherwise(F.col("value"))
    x = raw.select(*block, "_order", F.regexp_replace(v, "^>", "").alias("rec"))
    kept = (F.length(F.trim("rec")) > 0).cast("int")
    x = x.withColumn("_kept", kept).withColumn("_place", F.sum("_kept").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = x.groupBy(*block).agg(F.sum("_kept").alias("_c"))  # one row a block of a file
    before = F.sum("_c").over(Window.orderBy(*block)) - F.col("_c")
    x = x.where("_kept = 1").join(counts.select(*block, before.alias("_before")), block)
    parts = F.split(F.col("rec"), "\n", 2)
    header = F.trim(F.element_at(parts, 1))
    body = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return x.select((F.col("_before") + F.col("_place")).cast("bigint").alias("rank"), F.element_at(F.split(header, r"\s+"), 1).alias("id"),
                    header.alias("description"), F.regexp_replace(body, r"\s+", "").alias("sequence"))


def read_wild_type(spark: SparkSession, path: str) -> DataFrame:
    """First FASTA record as a one-row table (wt_id, wt_sequence)."""
    return (read_fasta(spark, path).where(F.col("rank") == 1)
            .select(F.col("id").alias("wt_id"), F.col("sequence").alias("wt_sequence")))


def read_msa(spark: SparkSession, path: str, nseq: int | None = None) -> DataFrame:
    """First ``nseq`` A3M records with insertions removed."""
    x = read_fasta(spark, path)
    if nseq is not None:
        x = x.where(F.col("rank") <= nseq)
    return x.withColumn("aligned", remove_insertions("sequence"))


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "sequence") -> None:
    """FASTA sink (one record per row, one part file per task)."""
    txt = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col))
    df.select(txt.alias("value")).write.mode("overwrite").text(path)


def write_feature_csv(df: DataFrame, path: str, seqcol: str, features: str = "features",
                      n_features: int | None = None, others=None) -> None:
    """Sequence, one column per feature ("0".."k-1"), other columns.
    ``n_features`` avoids a pass to find the width."""
    if n_features is None:
        n_features = df.agg(F.max(F.size(features))).first()[0] or 0
    others = [c for c in (others or df.columns) if c not in (seqcol, features)]
    cols = [F.when(F.size(features) <= n_features, F.col(seqcol)).otherwise(
        F.raise_error(F.lit(f"a row has more than {n_features} features"))).alias(seqcol)] + [F.col(features)[i].alias(str(i)) for i in range(n_features)] + [F.col(c) for c in others]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, by: str, fmt: str = "csv") -> None:
    """Predictions sorted by ``by`` descending (range-partitioned sort;
    part files are in order)."""
    w = df.orderBy(F.col(by).desc()).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_training_history(spark: SparkSession, path: str) -> DataFrame:
    """Log lines holding dict reprs -> rows (loss, grad_norm,
    learning_rate, epoch, eval_* ...). Lines that are not dicts are ignored."""
    schema = ("loss double, grad_norm double, learning_rate double, epoch double, eval_loss double, "
              "eval_spearmanr double, eval_accuracy double, eval_runtime double")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{.*\}\s*$"))
    js = F.from_json(F.translate("value", "'", '"'), schema)
    return lines.select(js.alias("h")).select("h.*").where(F.col("epoch").isNotNull())
