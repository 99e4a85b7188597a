"""The keys at given places of an order, found without ordering the rows.

A split by exact counts needs only the few keys at which one part ends and the
next begins; every row then finds its part by comparing its own key with them.
``hash_cuts`` counts the rows per leading hash bits, takes the one bucket of
each cut, and orders the keys of those buckets alone: of n rows about n / 65536
a cut. ``value_cuts`` finds places in the order of the values themselves, from
the distinct values. Both read only keys; the rows' other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.hashing import stable_hash
from seqframe.operators.ranking import attach_values, prefix_counts
from seqframe.session import cut_lineage

#: Leading bits of the 32-bit hash that are counted.
BITS = 16
#: Number of rows -> the places at which a part ends (the last row of each part but the last).
Places = Callable[[Column], list[Column]]


def _hash(key: str, seed: int) -> Column:
    """Null keys come first, as one key."""
    return F.coalesce(stable_hash(seed, key), F.lit(-1).cast("bigint"))


def _running(cols: list[str], *order) -> Window:
    return Window.partitionBy(*cols, F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def hash_cuts(df: DataFrame, key: str, seed: int, places: Places, by: list[str] | tuple = ()) -> DataFrame:
    """(by..., t0, t1, ...): the (hash, key) at each place in the order of ``stable_hash(seed, key)``, then key.

    Null where a place is 0. Rows of one key stand together: a place inside
    them counts as their end. Without ``by`` there is one row, null on no rows.
    """
    by = list(by)
    keys = df.select(*by, F.col(key).alias("_k"), _hash(key, seed).alias("_h"))
    bucket = F.shiftright("_h", 32 - BITS).cast("int")
    counts = keys.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_to", F.sum("_c").over(_running(by, "_b"))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by, F.lit(0))))
    at = places(F.col("_all"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (p - (F.col("_to") - F.col("_c"))).cast("bigint").alias("place")) for i, p in enumerate(at)])
    inside = F.filter(wanted, lambda x: (x["place"] > 0) & (x["place"] <= F.col("_c")))
    cuts = counts.withColumn("_in", inside).where(F.size("_in") > 0).select(*by, "_b", "_in")
    if by:
        cuts = cut_lineage(cuts)
        rows = cuts.count()
    else:
        rows = len(at)
    near = attach_values(keys.withColumn("_b", bucket), cuts, by, ["_b"], rows)
    near = near.groupBy(*by, "_b", "_h", "_k").agg(F.count(F.lit(1)).alias("_c"), F.first("_in").alias("_in"))
    near = near.withColumn("_to", F.sum("_c").over(_running([*by, "_b"], "_h", "_k")))
    here = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"))

    def reached(i):
        return F.exists("_in", lambda x: (x["i"] == i) & (x["place"] <= F.col("_to")))

    found = [F.min(F.when(reached(i), here)).alias(f"t{i}") for i in range(len(at))]
    return near.groupBy(*by).agg(*found) if by else near.agg(*found)


def value_cuts(df: DataFrame, col: str, places: Places) -> DataFrame:
    """One row (t0, t1, ...): the values of ``col`` at each place in their order; rows of one value stand together.

    Nulls have no place: they count in no part and stand behind the last cut.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    ordered, _ = prefix_counts(counts, "_k")
    to, n = F.col("_before") + F.col("_c"), ordered.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_all"))
    at = n.select(F.array(*[p.cast("bigint") for p in places(F.col("_all"))]).alias("_at"))
    k = len(places(F.lit(0)))
    row = ordered.join(F.broadcast(at))
    return row.agg(*[F.min(F.when((F.col("_at")[i] > 0) & (to >= F.col("_at")[i]), F.col("_k"))).alias(f"t{i}") for i in range(k)])


def part_by_hash(df: DataFrame, key: str, seed: int, places: Places, out: str, by: list[str] | tuple = ()) -> DataFrame:
    """``df`` with ``out``, the number of cuts that lie before the row: 0 up to the first cut, and so on.

    The rows are neither shuffled nor sorted; the cuts, one row a group, are
    broadcast, beyond ``BROADCAST_ROWS`` groups joined by group.
    """
    by, k = list(by), len(places(F.lit(0)))
    cuts = hash_cuts(df, key, seed, places, by).select(*by, F.struct(*[f"t{i}" for i in range(k)]).alias("_cuts"))
    here = F.struct(_hash(key, seed).alias("h"), F.col(key).alias("k"))
    if by:
        cuts = cut_lineage(cuts)
        x = attach_values(df, cuts, by, [], cuts.count())
    else:
        x = df.join(F.broadcast(cuts))
    return _counted(x, here, k, out)


def part_by_value(df: DataFrame, col: str, places: Places, out: str) -> DataFrame:
    """``part_by_hash`` in the order of ``col`` itself."""
    k = len(places(F.lit(0)))
    cuts = value_cuts(df, col, places).select(F.struct(*[f"t{i}" for i in range(k)]).alias("_cuts"))
    return _counted(df.join(F.broadcast(cuts)), F.col(col), k, out)


def _counted(x: DataFrame, here: Column, k: int, out: str) -> DataFrame:
    past = [F.coalesce((here > F.col(f"_cuts.t{i}")), F.lit(True)).cast("int") for i in range(k)]
    return x.withColumn(out, sum(past[1:], past[0]) if past else F.lit(0)).drop("_cuts")
