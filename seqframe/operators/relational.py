"""Projections, keyed attachment, ordering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType


def filter_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep sequences of exactly n residues (pushed into the scan's
    Filter; length is computed once per row)."""
    return df.where(F.length(col) == n)


def select_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Project and rename in one select."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def sequence_first(df: DataFrame, seqcol: str, features: str = "features") -> DataFrame:
    """P5: sequence column, the feature block, then every other column in order."""
    rest = [c for c in df.columns if c not in (seqcol, features)]
    return df.select(seqcol, features, *rest)


def feature_block(df: DataFrame, seqcol: str, ycol: str, out: str = "features") -> DataFrame:
    """The columns strictly between ``seqcol`` and ``ycol`` (by position)
    as one ARRAY<DOUBLE> column; other columns kept."""
    cols = df.columns
    i, j = cols.index(seqcol), cols.index(ycol)
    block = cols[i + 1:j]
    keep = [c for c in cols if c not in block]
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in block]).alias(out))


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """A unique id when the data has no key (not consecutive; stable
    only for a fixed input and partitioning - prefer a real key)."""
    return df.withColumn(out, F.monotonically_increasing_id())


def attach_features(df: DataFrame, feats: DataFrame, key: str) -> DataFrame:
    """Put a feature table next to the original columns by key."""
    return df.join(feats, key)


def range_filter(df: DataFrame, col: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Start <= col <= end (either side optional, end inclusive)."""
    if start is not None:
        df = df.where(F.col(col) >= start)
    if end is not None:
        df = df.where(F.col(col) <= end)
    return df


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n records in file/record order (``order`` carries it)."""
    return df.orderBy(order).limit(n)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (an aggregate without grouping, or
    a single wild type) on every row of ``df``. The row is broadcast; Spark plans
    a nested loop over that one row, and ``df`` is not shuffled."""
    return df.join(F.broadcast(one_row))


def place_runs(places: DataFrame, key: str, width: int) -> DataFrame:
    """(key, pos, n, n_marked, x): rows (key, pos, x, marked) that follow each other in a batch, with the same key and
    places one after the other, as one row with the first place, the number of places and their letters joined.

    Narrow: what is grouped by key afterwards is as large as the letters, not as the places' rows. Only places of
    exactly ``width`` characters are joined; a null ``x`` counts as empty.
    """
    schema = StructType([places.schema[key]]).add("pos", IntegerType()).add("n", LongType()).add("n_marked", LongType()).add("x", StringType())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k, x = b.column(0), pc.fill_null(b.column(2).cast(pa.string()), "")
            pos, marked = b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            a, z = k.slice(0, len(k) - 1), k.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z))).to_numpy(zero_copy_only=False)
            fits = pc.equal(pc.utf8_length(x), width).to_numpy(zero_copy_only=False)
            follows = same & (pos[1:] == pos[:-1] + 1) & fits[1:] & fits[:-1]
            starts = np.flatnonzero(np.concatenate([[True], ~follows]))
            ends = np.append(starts[1:], len(pos))
            offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
            data = memoryview(x.buffers()[2] or b"")
            letters = [bytes(data[i:j]) for i, j in zip(offsets[starts].tolist(), offsets[ends].tolist())]
            yield pa.RecordBatch.from_arrays(
                [k.take(pa.array(starts)), pa.array(pos[starts], pa.int32()), pa.array(ends - starts, pa.int64()),
                 pa.array(np.add.reduceat(marked, starts), pa.int64()), pa.array(letters, pa.binary()).cast(pa.string())], names=schema.names)

    return places.select(key, F.col("pos").cast("int").alias("pos"), "x", "marked").mapInArrow(run, schema)


def joined_runs(runs: str, width: int) -> Column:
    """The letters of a sorted array of runs (pos, x, n) in the order of (place, letters); runs of repeated keys may overlap."""
    def places(r):
        letters = F.transform(F.sequence(F.lit(0), r["n"].cast("int") - 1), lambda i: F.struct(
            (r["pos"] + i).alias("pos"), F.when(r["n"] == 1, r["x"]).otherwise(F.substring(r["x"], i * width + 1, F.lit(width))).alias("x")))
        return letters

    r = F.col(runs)
    overlap = F.exists(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.get(r, i - 1)["pos"] + F.get(r, i - 1)["n"] > F.get(r, i)["pos"])
    sorted_places = F.array_sort(F.flatten(F.transform(r, places)))
    return F.array_join(F.when((F.size(r) > 1) & overlap, F.transform(sorted_places, lambda p: p["x"]))
                        .otherwise(F.transform(r, lambda p: p["x"])), "")
