"""Training-history tables: merge (J9), early stopping (W6), report
and the warm-up/cosine learning-rate schedule (W8).

History rows are (run, epoch, ...) with dense epochs 1..n per run. Running
statistics use fixed epoch chunks: windows run inside (run, chunk) - at most
``CHUNK`` rows each - and the carry from earlier chunks comes from a small
per-chunk table, so even a run holding a large share of all rows is spread
over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 4096


def merge_history(rows: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """One row per (run, epoch) from separate train and eval rows
    (``kind`` in train/eval, ``value``): loss and eval_loss side by side."""
    return rows.groupBy(run, epoch).agg(
        F.max(F.when(F.col("kind") == "train", F.col("value"))).alias("loss"),
        F.max(F.when(F.col("kind") == "eval", F.col("value"))).alias("eval_loss"))


def _prefix_over_chunks(tbl: DataFrame, run: str, value: str, how: str, out: str) -> DataFrame:
    w = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    f = F.min if how == "min" else F.max
    return tbl.withColumn(out, f(value).over(w))


def early_stopping(hist: DataFrame, patience: int = 5, run: str = "run", epoch: str = "epoch",
                   loss: str = "val_loss") -> DataFrame:
    """Per run, the first epoch at which ``patience`` epochs have passed
    since the last strict improvement of the validation loss (null if never),
    and the best epoch at that point (or at the end when it never stops).
    Columns: run, stop_epoch, best_epoch, best_loss."""
    x = hist.select(run, epoch, loss).withColumn("_chunk", F.floor((F.col(epoch) - 1) / CHUNK))
    # 1) strict improvement: loss < min of all earlier epochs
    cmin = x.groupBy(run, "_chunk").agg(F.min(loss).alias("_cmin"))
    cmin = _prefix_over_chunks(cmin, run, "_cmin", "min", "_carry_min").drop("_cmin")
    w_in = Window.partitionBy(run, "_chunk").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(cmin, [run, "_chunk"])
    prev = F.least(F.min(loss).over(w_in), F.col("_carry_min"))
    prev = F.when(F.min(loss).over(w_in).isNull(), F.col("_carry_min")).otherwise(prev)
    x = x.withColumn("_improved", prev.isNull() | (F.col(loss) < prev)).drop("_carry_min")
    # 2) last improved epoch up to each row
    imp_ep = F.when(F.col("_improved"), F.col(epoch))
    cmax = x.groupBy(run, "_chunk").agg(F.max(imp_ep).alias("_cmax"))
    cmax = _prefix_over_chunks(cmax, run, "_cmax", "max", "_carry_imp").drop("_cmax")
    w_inc = Window.partitionBy(run, "_chunk").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(cmax, [run, "_chunk"])
    last_imp = F.greatest(F.max(imp_ep).over(w_inc), F.col("_carry_imp"))
    x = x.withColumn("_last", last_imp)
    x = x.withColumn("_since", F.col(epoch) - F.col("_last"))
    stops = x.where(F.col("_since") >= patience).groupBy(run).agg(
        F.min_by(F.struct(F.col(epoch).alias("stop_epoch"), F.col("_last").alias("best_epoch")), epoch).alias("_s"))
    best_all = x.where("_improved").groupBy(run).agg(F.max(epoch).alias("_best_end"))
    res = best_all.join(stops, run, "left").select(
        run, F.col("_s.stop_epoch").alias("stop_epoch"),
        F.coalesce(F.col("_s.best_epoch"), F.col("_best_end")).alias("best_epoch"))
    return res.join(hist.select(F.col(run), F.col(epoch).alias("best_epoch"), F.col(loss).alias("best_loss")),
                    [run, "best_epoch"])


def history_report(merged: DataFrame, run: str = "run", epoch: str = "epoch", every: int = 10) -> DataFrame:
    """Per-epoch rows without each run's final row, keeping the first
    epoch and every ``every``-th."""
    last = merged.groupBy(run).agg(F.max(epoch).alias("_last"))
    x = merged.join(last, run).where(F.col(epoch) < F.col("_last")).drop("_last")
    return x.where((F.col(epoch) == 1) | (F.col(epoch) % every == 0))


def lr_expr(step, lr: float, warmup: int, total: int):
    """W8 learning rate at ``step``: linear warm-up, then half-cosine decay."""
    s = F.col(step) if isinstance(step, str) else step
    w = F.lit(float(max(1, warmup)))
    prog = (s - F.lit(warmup)) / F.lit(float(max(1, total - warmup)))
    cos = F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * prog)))
    return F.when(s < F.lit(warmup), F.lit(lr) * s / w).otherwise(F.lit(lr) * cos)


def lr_schedule(spark: SparkSession, steps: int, lr: float, warmup: int = 500) -> DataFrame:
    """W8 as a table (step, lr) over ``spark.range`` (partitioned, no driver list)."""
    return spark.range(steps).select(F.col("id").alias("step"), lr_expr("id", lr, warmup, steps).alias("lr"))
