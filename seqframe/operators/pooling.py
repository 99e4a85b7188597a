"""Pooling of per-residue vectors (A1-A4), pluggable embedding (F3) and
pool comparison input (F4).

Pooling by group uses ``Summarizer`` on ML vectors: the aggregation buffer is
one d-sized vector per group and task (map-side partial aggregation), so a
group holding a third of all rows still costs one buffer per task and no
row explode before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

POOLS = ("mean", "sum", "max", "global")


def pool(df: DataFrame, key: str | list[str], vec: str, how: str = "mean", out: str = "pooled") -> DataFrame:
    """A1 mean / A2 sum / A3 max / A4 global (concat of mean and max).

    ``vec`` is ARRAY<FLOAT|DOUBLE>; returns (key..., out ARRAY<DOUBLE>).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if how not in POOLS:
        raise ValueError(f"unknown pooling {how!r}; expected one of {POOLS}")
    v = array_to_vector(F.col(vec).cast("array<double>"))
    x = df.select(*keys, v.alias("_v"))
    if how == "global":
        s = Summarizer.metrics("mean", "max")
        r = x.groupBy(*keys).agg(s.summary(F.col("_v")).alias("_s"))
        return r.select(*keys, F.concat(vector_to_array("_s.mean"), vector_to_array("_s.max")).alias(out))
    s = Summarizer.metrics(how)
    r = x.groupBy(*keys).agg(s.summary(F.col("_v")).alias("_s"))
    return r.select(*keys, vector_to_array(f"_s.{how}").alias(out))


def pool_all(df: DataFrame, key: str | list[str], vec: str) -> DataFrame:
    """mean, sum and max in one aggregation pass."""
    keys = [key] if isinstance(key, str) else list(key)
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = Summarizer.metrics("mean", "sum", "max")
    r = df.select(*keys, v.alias("_v")).groupBy(*keys).agg(s.summary(F.col("_v")).alias("_s"))
    return r.select(*keys, vector_to_array("_s.mean").alias("mean"), vector_to_array("_s.sum").alias("sum"),
                    vector_to_array("_s.max").alias("max"))


# --- F3: pluggable per-residue encoder -------------------------------------

#: Letters (with padding) of one call of an encoder at most; a longer sequence is a call of its own.
MAX_TOKENS = 1 << 18


class BatchEncoder:
    """A per-residue encoder for padded batches. ``load`` runs once in each task, before its first batch."""

    def load(self) -> None:
        pass

    def encode(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Letter codes (sequences x longest, 0 beyond a sequence's end) and lengths -> vectors (sequences x longest x width)."""
        raise NotImplementedError


class WindowEncoder(BatchEncoder):
    """Each residue's descriptor vector next to the mean descriptor vector of its +-window neighbourhood (width 2d).

    Letters without a descriptor are zero vectors."""

    def __init__(self, table: dict[str, list[float]], window: int = 1):
        self.window, d = window, len(next(iter(table.values())))
        self.lut = np.zeros((256, d))
        for aa, vals in table.items():
            self.lut[ord(aa)] = vals

    def encode(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = self.lut[tokens]
        c = np.concatenate([np.zeros((len(x), 1, x.shape[2])), np.cumsum(x, axis=1)], axis=1)
        at = np.arange(tokens.shape[1])[None, :]
        lo, hi = np.maximum(at - self.window, 0), np.minimum(at + self.window + 1, lengths[:, None])
        hi = np.maximum(hi, lo + 1)  # places beyond a sequence's end are not pooled
        rows = np.arange(len(x))[:, None]
        return np.concatenate([x, (c[rows, hi] - c[rows, np.broadcast_to(lo, hi.shape)]) / (hi - lo)[:, :, None]], axis=2)

    def __call__(self, seq: str) -> np.ndarray:
        own = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)[None, :]
        return self.encode(own, np.array([own.shape[1]]))[0]


def descriptor_window_encoder(table: dict[str, list[float]], window: int = 1) -> WindowEncoder:
    """The built-in encoder."""
    return WindowEncoder(table, window)


def batches_of(lengths: np.ndarray, max_tokens: int) -> list[np.ndarray]:
    """Places of the sequences that are encoded together: sorted by length, with at most ``max_tokens`` letters after padding."""
    order, out, lo = np.argsort(lengths, kind="stable"), [], 0
    for hi in range(1, len(order) + 1):
        if hi == len(order) or lengths[order[hi]] * (hi - lo + 1) > max_tokens:
            out.append(order[lo:hi])
            lo = hi
    return out


def _pooled(v: np.ndarray, lengths: np.ndarray, how: str) -> np.ndarray:
    real = (np.arange(v.shape[1])[None, :] < lengths[:, None])[:, :, None]
    if how == "mean":
        return np.where(real, v, 0).sum(1) / lengths[:, None]
    if how == "sum":
        return np.where(real, v, 0).sum(1)
    if how == "max":
        return np.where(real, v, -np.inf).max(1)
    return np.concatenate([_pooled(v, lengths, "mean"), _pooled(v, lengths, "max")], axis=1)


def embed_pools(df: DataFrame, seqcol: str, encoder: BatchEncoder, pools=("mean", "max", "sum"), out: str = "pools",
                max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``df`` with a struct ``out`` of one pooled vector per pooling, all from one run of the encoder.

    Sequences of an Arrow batch are put in order of their lengths, padded and encoded in
    calls of at most ``max_tokens`` letters; pooling masks the padding. Null and empty
    sequences have null vectors; letters beyond Latin-1 count as unknown.
    """
    for how in pools:
        if how not in POOLS:
            raise ValueError(f"unknown pooling {how!r}; expected one of {POOLS}")
    kind = StructType([StructField(p, ArrayType(DoubleType())) for p in pools])

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder.load()
        for seqs in parts:
            texts = [b"" if s is None else s.encode("latin-1", "replace") for s in seqs]
            n = np.array([len(x) for x in texts], np.int64)
            res = {p: [None] * len(texts) for p in pools}
            full = np.flatnonzero(n)
            for own in batches_of(n[full], max_tokens) if len(full) else []:
                at = full[own]
                tokens = np.zeros((len(at), n[at].max()), np.uint8)
                tokens[np.arange(tokens.shape[1])[None, :] < n[at, None]] = np.frombuffer(b"".join(texts[i] for i in at), np.uint8)
                v = encoder.encode(tokens, n[at])
                for p in pools:
                    for i, vec in zip(at, _pooled(v, n[at], p).tolist()):
                        res[p][i] = vec
            yield pd.DataFrame({p: pd.Series(res[p], dtype=object) for p in pools})

    return df.withColumn(out, run(F.col(seqcol)))


def embed(df: DataFrame, seqcol: str, encoder: BatchEncoder, how: str = "mean", out: str = "embedding") -> DataFrame:
    """sequence -> one pooled vector; see ``embed_pools``."""
    return embed_pools(df, seqcol, encoder, (how,), "_pools").withColumn(out, F.col(f"_pools.{how}")).drop("_pools")


def pool_compare_input(df: DataFrame, seqcol: str, encoder: BatchEncoder, pools=("mean", "max", "sum"),
                       out: str = "embedding") -> DataFrame:
    """one table with a ``pool`` column for each pooling, ready for a
    per-pool fit and score; the encoder runs once for all of them."""
    x = embed_pools(df, seqcol, encoder, pools, "_pools")
    rows = F.array(*[F.struct(F.lit(p).alias("pool"), F.col(f"_pools.{p}").alias(out)) for p in pools])
    return x.withColumn("_row", F.explode(rows)).select(*df.columns, "_row.pool", f"_row.{out}")
