"""Exact ranks and row numbers without funnelling a group through one task.

``Window.partitionBy(g).orderBy(v)`` puts a whole group into one task, and a
global window (no partitionBy) puts the whole table there. Both fail when one
group holds a large share of the rows.

Ranks of values (``prefix_counts``, ``average_rank``, Spearman) work on the
distinct values with their counts: they are range-partitioned by (group,
value), counted up inside each partition, and the counts of a group's earlier
partitions are added. Equal values lie in one row, so a value held by a third
of the rows is no hot key, and average ranks stay exact.

``row_number_by`` cuts the ordering column into range buckets (top bits of a
uniform hash, or approximate quantiles), numbers rows inside each ``(group,
bucket)`` and adds the counts of the earlier buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.session import cut_lineage

DEFAULT_BUCKETS = 1024
#: Rows of a table of values that is broadcast at most; it is counted first.
BROADCAST_ROWS = 500_000


def _quantile_bucket(df: DataFrame, col: str, out: str, buckets: int) -> DataFrame:
    """Add ``out`` = global approximate-quantile bucket of numeric ``col``.

    The split points (``buckets`` numbers) are the only thing fetched to the
    driver; the binary search runs in the JVM (Bucketizer).
    """
    probs = [i / buckets for i in range(1, buckets)]
    src = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    row = src.agg(F.percentile_approx("_v", probs, 10 * buckets).alias("q")).first()
    qs = sorted(set(v for v in (row["q"] or []) if v is not None))
    splits = [float("-inf")] + qs + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0).cast("int"))
    tmp = f"__{out}_v"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out + "_d", handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return res.withColumn(out, F.col(out + "_d").cast("int")).drop(tmp, out + "_d")


def _bucket_offsets(counts: DataFrame, by: list[str], bkt: str, c: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint"))


def row_number_by(df: DataFrame, order: list[str], by: list[str] | tuple = (), out: str = "rn",
                  hash_col: str | None = None, buckets: int = DEFAULT_BUCKETS,
                  with_total: str | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)``, skew-safe.

    ``order`` must be unique within a group (append a key to break ties).
    If ``hash_col`` is given it must be the first order column and hold a
    uniform BIGINT in [0, 2^32) (see ``stable_hash``); its top bits are the
    bucket and no quantile pass is needed. Otherwise the first order column is
    bucketed by global approximate quantiles.
    ``with_total`` adds the group size under that name.
    """
    by = list(by)
    if hash_col is not None:
        bits = max(1, (buckets - 1).bit_length())
        x = df.withColumn("_bkt", F.shiftright(F.col(hash_col), 32 - bits).cast("int"))
    else:
        x = _quantile_bucket(df, order[0], "_bkt", buckets)
    w = Window.partitionBy(*by, "_bkt").orderBy(*order)
    x = x.withColumn("_rn_in", F.row_number().over(w))
    counts = x.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    offs = _bucket_offsets(counts, by, "_bkt", "_c")
    if with_total:
        offs = offs.withColumn(with_total, F.sum("_c").over(Window.partitionBy(*by)).cast("bigint"))
    offs = offs.drop("_c")
    if not by:
        offs = F.broadcast(offs)  # at most `buckets` rows
    res = x.join(offs, [*by, "_bkt"]).withColumn(out, (F.col("_off") + F.col("_rn_in")).cast("bigint"))
    return res.drop("_bkt", "_rn_in", "_off")


def attach_values(df: DataFrame, small: DataFrame, by: list[str], cols: list[str], rows: int, how: str = "inner") -> DataFrame:
    """``df`` joined with a table of ``rows`` rows on ``by`` (null equals null) and ``cols``.

    Up to ``BROADCAST_ROWS`` rows the table is broadcast, so ``df`` is not
    shuffled on what may be few values; a longer one has as many values to
    spread ``df`` by, and a frequent one is split by the adaptive skew join.
    """
    small = small.withColumnsRenamed({c: f"__{c}" for c in [*by, *cols]})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    for c in cols:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    side = F.broadcast(small) if rows <= BROADCAST_ROWS else small
    return df.join(side, cond, how).drop(*[f"__{c}" for c in [*by, *cols]])


def _by_range(values: DataFrame, by: list[str], col: str) -> DataFrame:
    """Partitioned by ranges of (by, col) and sorted in each; ``_g`` names the group.

    The number of partitions is given, so that no later step merges them and
    a partition's number stays its place in the order.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    return values.repartitionByRange(n, *by, col).sortWithinPartitions(*by, col).withColumn("_g", group)


def _runs(g: pa.Array) -> np.ndarray:
    """Where a new group begins in sorted group names."""
    change = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def prefix_counts(values: DataFrame, col: str, by: list[str] | tuple = (), count_col: str = "_c", out: str = "_before") -> tuple[DataFrame, int]:
    """(by..., col, count_col, out) and its number of rows: how many rows of the group hold a smaller value.

    ``values`` has each distinct value of a group once, with its count. It is
    range-partitioned, counted up in a stream inside the partitions and
    written to the shared folder (both later reads must see the same ranges);
    the counts of earlier partitions come from one row a partition and group.
    """
    by = list(by)
    x = _by_range(values.select(*by, col, F.col(count_col).cast("bigint").alias(count_col)), by, col)

    def run(batches):
        pid, last, cum = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, c = b.column(len(by) + 2), b.column(len(by) + 1).to_numpy(zero_copy_only=False)
            before = np.cumsum(c) - c
            starts = _runs(g)
            base = before[starts].copy()
            if g[0].as_py() == last:
                base[0] -= cum
            before -= np.repeat(base, np.diff(np.append(starts, len(c))))
            last, cum = g[-1].as_py(), int(before[-1] + c[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(len(c), pid, np.int32)), pa.array(before)],
                                             names=[*b.schema.names[:-1], "_pid", out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    x = cut_lineage(x.mapInArrow(run, f"{fields}, _pid int, `{out}` long"))
    n = x.count()
    ends = x.groupBy(*by, "_pid").agg(F.sum(count_col).alias("_n"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rows = n if n <= BROADCAST_ROWS else ends.count()
    x = attach_values(x, ends, by, ["_pid"], rows)
    return x.select(*by, col, count_col, (F.col(out) + F.col("_off")).cast("bigint").alias(out)), n


def value_ranks(df: DataFrame, col: str, by: list[str] | tuple = (), out: str = "rank") -> tuple[DataFrame, int]:
    """(by..., col, out) and its number of rows: the average rank of each distinct value, without nulls and NaN.

    A value held by c rows after o rows with smaller values has rank o + (c + 1) / 2."""
    by = list(by)
    valid = F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
    counts = df.where(valid).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    x, n = prefix_counts(counts, col, by)
    return x.select(*by, col, (F.col("_before").cast("double") + (F.col("_c") + 1) / 2.0).alias(out)), n


def average_rank(df: DataFrame, col: str, by: list[str] | tuple = (), out: str = "rank") -> DataFrame:
    """1-based average rank of ``col`` within ``by`` (ties share the mean).

    Nulls and NaN get a null rank and do not count.
    """
    ranks, n = value_ranks(df, col, by, out)
    return attach_values(df, ranks, list(by), [col], n, "left")


def rank_moments(sums: DataFrame, col: str, by: list[str] | tuple = ()) -> DataFrame:
    """(by..., n, x, xx, xr, rr, r): sums over a group of x, x*x, x*rank, rank*rank and rank, with n the rows.

    ``sums`` has each distinct value of ``col`` in a group once, with ``_c``,
    its rows, and ``_x`` and ``_xx``, their sums of x and x*x. Ranks are counted up inside range
    partitions; a partition's sums with its own ranks become those with ranks in
    the whole group by adding multiples of the rows before it. So no rank
    is joined back, and one row a partition and group leaves the tasks.
    """
    by = list(by)
    x = _by_range(sums.select(*by, col, *[F.col(c).cast("double").alias(c) for c in ("_c", "_x", "_xx")]), by, col)
    names = ["_n", "_s", "_ss", "_sl", "_ll", "_l"]

    def run(batches):
        pid, last, held, total = TaskContext.get().partitionId(), None, None, np.zeros(6)

        def row():
            arrays = [*held, pa.array([pid], pa.int32()), *[pa.array([float(v)]) for v in total]]
            return pa.RecordBatch.from_arrays(arrays, names=[*by, "_pid", *names])

        for b in batches:
            if not b.num_rows:
                continue
            g, (c, s, ss) = b.column(len(by) + 4), [b.column(len(by) + i).to_numpy() for i in (1, 2, 3)]
            starts = _runs(g)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(c)]):
                name = g[lo].as_py()
                if name != last:
                    if held is not None:
                        yield row()
                    last, held, total = name, [b.column(i).slice(lo, 1) for i in range(len(by))], np.zeros(6)
                own, x_sums = c[lo:hi], s[lo:hi]
                rank = total[0] + np.cumsum(own) - own + (own + 1) / 2
                total += [own.sum(), x_sums.sum(), ss[lo:hi].sum(), x_sums @ rank, own @ (rank * rank), own @ rank]
        if held is not None:
            yield row()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in x.schema.fields[:len(by)])
    parts = x.mapInArrow(run, f"{fields}_pid int, " + ", ".join(f"{c} double" for c in names))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0.0)))
    off = F.col("_off")
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_s").alias("x"), F.sum("_ss").alias("xx"), F.sum(F.col("_sl") + off * F.col("_s")).alias("xr"),
                                  F.sum(F.col("_ll") + 2 * off * F.col("_l") + off * off * F.col("_n")).alias("rr"),
                                  F.sum(F.col("_l") + off * F.col("_n")).alias("r"))
