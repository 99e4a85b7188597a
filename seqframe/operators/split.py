"""Reproducible splitting, folding and sampling.

Rows are ordered by ``stable_hash(seed, key)`` (ties by key). Exact sizes
(⌈frac·n⌉ rows, first n mod k folds one larger) come from the keys at which
one part ends and the next begins (``selection``): those are found from counts
and a few keys, and each row is decided by itself, with no shuffle of its other
columns. Membership depends only on (seed, key): it is stable under
repartitioning and executor loss. Rows that share a key share a part.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.operators.selection import part_by_hash, part_by_value


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, shuffle: bool = True,
          out: str = "fold", by: list[str] | tuple = ()) -> DataFrame:
    """Fold 0..k-1; the first n mod k folds get one extra row (ntile rule), per group ``by``.

    ``shuffle=False`` folds contiguous runs of ``key`` order (unshuffled k-fold).
    """
    def ends(n):
        q, r = F.floor(n / F.lit(k)).cast("bigint"), (n % F.lit(k)).cast("bigint")
        return [F.lit(i) * q + F.least(F.lit(i), r) for i in range(1, k)]

    if shuffle:
        return part_by_hash(df, key, seed, ends, out, by)
    if by:
        raise ValueError("contiguous folds have no groups")
    return part_by_value(df, key, ends, out)


def _ceil_frac(frac: float, n):
    return F.ceil(F.lit(float(frac)) * n).cast("bigint")


def train_valid_test(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """test = ⌈frac·n⌉, valid = ⌈frac·(n - test)⌉, the rest train."""
    def ends(n):
        n_test = _ceil_frac(frac, n)
        return [n_test, n_test + _ceil_frac(frac, n - n_test)]

    names = F.array(F.lit("test"), F.lit("valid"), F.lit("train"))
    return part_by_hash(df, key, seed, ends, "_part").withColumn(out, F.get(names, F.col("_part"))).drop("_part")


def train_test(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """test = ⌈frac·n⌉ rows, the rest train (a true two-way split)."""
    x = part_by_hash(df, key, seed, lambda n: [_ceil_frac(frac, n)], "_part")
    return x.withColumn(out, F.when(F.col("_part") == 0, F.lit("test")).otherwise(F.lit("train"))).drop("_part")


def truncate(df: DataFrame, key: str, frac: float, seed: int = 42, by: list[str] | tuple = ()) -> DataFrame:
    """Keep ⌈frac·n⌉ rows (per group ``by``) in hash order.

    frac == 1 returns the input; frac > 1 warns and returns the input.
    """
    if frac == 1.0:
        return df
    if frac > 1.0:
        warnings.warn("truncate fraction must be <= 1.0; returning all rows", stacklevel=2)
        return df
    return part_by_hash(df, key, seed, lambda n: [_ceil_frac(frac, n)], "_part", by).where("_part = 0").drop("_part")


def tag_split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    """Literal split column."""
    return df.withColumn(col, F.lit(name))


def filter_split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    """Rows of one split, split column dropped."""
    return df.where(F.col(col) == name).drop(col)


def ensure_split(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42, col: str = "split") -> DataFrame:
    """Keep an existing split column, else create train/valid/test.

    The test is on the schema only - no data is read to decide.
    """
    if col in df.columns:
        return df
    return train_valid_test(df, key, frac, seed, out=col)


def split_counts(df: DataFrame, col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def union_splits(*dfs: DataFrame) -> DataFrame:
    """Stack split tables by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
