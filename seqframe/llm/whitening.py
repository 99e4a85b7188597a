"""Whitening of vectors by distributed block matrices.

The rows are indexed into row blocks, written once. Their centred blocks form
a ``BlockMatrix``; its transpose times itself is the scatter, which is small
enough for a local eigendecomposition, and the blocks times the whitening
matrix are the projected rows.

``BlockMatrix.multiply`` deals the blocks of the product out to tasks, as a
grid. A tall matrix of one block column would give a product of one block, so
one task. Here block r stands in a square grid instead: for the scatter the
left factor holds it at (r, r mod g) and the right one at (r, r div g mod g),
so block (i, j) of the product is the sum over the r dealt to (i, j), and for
the projection it stands at (r div g, r mod g) against g whitening matrices on
the diagonal.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.llm.common import written

#: A vector's dimensions at most: the scatter matrix (128 MB) and its decomposition are local.
MAX_DIMENSIONS = 4096
#: Row blocks at most, unless a block would pass MAX_BLOCK_BYTES: their numbers pass through the driver in a multiplication.
MAX_BLOCKS = 100_000
BLOCK_BYTES, MAX_BLOCK_BYTES = 1 << 21, 1 << 26
#: An entry of this size or more counts as not finite: 1024 times it is no longer a whole number in a double.
LIMIT = float(1 << 42)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(id, v), their number and dimension: without null vectors or ones with an entry that is null or not finite.

    The dimension is the most frequent length, the larger one of equals;
    vectors of another length, and empty ones, are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)))
    top = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return rows.limit(0), 0, 0
    return rows.where(F.size("v") == top["d"]), top["count"], top["d"]


def row_blocks(rows: DataFrame, n: int, d: int) -> DataFrame:
    """(r, ids, x, sums): ``rows`` (id, x) in numbered blocks, written to the shared folder.

    ``x`` holds a block's longs as bytes, row after row; ``sums`` their sum in
    each dimension. A task's last block is shorter. Numbers follow the written
    tasks, so they stay as they are when an executor is lost.
    """
    size = min(max(BLOCK_BYTES, math.ceil(n / MAX_BLOCKS) * 8 * d), MAX_BLOCK_BYTES) // (8 * d)

    def run(batches):
        part, ids, xs, held, seq = TaskContext.get().partitionId(), [], [], 0, 0

        def block(take):
            nonlocal ids, xs, held, seq
            own_ids, x = pa.concat_arrays(ids), np.concatenate(xs)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([own_ids[:take].to_pylist()], pa.list_(pa.int64())),
                 pa.array([x[:take].tobytes()], pa.binary()), pa.array([x[:take].sum(0).tolist()], pa.list_(pa.int64()))],
                names=["part", "seq", "ids", "x", "sums"])
            ids, xs, held, seq = [own_ids[take:]], [x[take:]], held - take, seq + 1
            return out

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0))
                xs.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, d))
                held += batch.num_rows
                while held >= size:
                    yield block(size)
        if held:
            yield block(held)

    blocks = written(rows.mapInArrow(run, "part int, seq int, ids array<long>, x binary, sums array<long>"), "row-blocks")
    parts = blocks.groupBy("part").agg(F.count("*").alias("c"))  # one row a task
    parts = parts.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before"))
    return blocks.join(F.broadcast(parts), "part").select((F.col("before") + F.col("seq")).cast("int").alias("r"), "ids", "x", "sums")


def _centred(x: bytes, n: int, sums: list[int], d: int) -> np.ndarray:
    """Rows less the mean: the whole numbers n*x - S, each rounded once, over n."""
    return _deviations(x, n, sums, d).astype(np.float64) / n


def _deviations(x: bytes, n: int, sums: list[int], d: int) -> np.ndarray:
    """n*x - S as whole numbers, Python's where 64 bits could overflow."""
    a = np.frombuffer(x, "<i8").reshape(-1, d)
    far = n * int(np.abs(a).max(initial=0)) + max(map(abs, sums), default=0)
    if far < 1 << 62:
        return n * a - np.array(sums, np.int64)
    return n * a.astype(object) - np.array(sums, object)


def _matrix(a: np.ndarray) -> DenseMatrix:
    return DenseMatrix(a.shape[0], a.shape[1], a.ravel(order="F"))


def scatter(blocks: DataFrame, n: int, sums: list[int], d: int) -> np.ndarray:
    """The sum of all rows' outer products after centring, by one distributed transpose-multiplication."""
    rdd = blocks.select("r", "x").rdd
    count = blocks.count()
    g = math.ceil(math.sqrt(max(1, min(count, rdd.getNumPartitions()))))
    rows = max(1, -(-n // max(1, count)))

    def factor(column):
        own = rdd.map(lambda row: ((row.r, column(row.r)), _matrix(_centred(row.x, n, sums, d))))
        return BlockMatrix(own, rows, d, rows * count, g * d)

    product = factor(lambda r: r % g).transpose().multiply(factor(lambda r: r // g % g))
    return product.blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def components_of(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``k`` largest eigenvalues and their unit eigenvectors; those that rounding can't tell from zero are left out."""
    e, u = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(e)[::-1][:k]
    order = order[e[order] > max(e.max(), 0) * len(e) * np.finfo(float).eps * 8]
    return e[order], u[:, order]


def project(blocks: DataFrame, n: int, sums: list[int], d: int, matrix: np.ndarray) -> DataFrame:
    """(r, p): each block's centred rows times ``matrix`` (d x k), row after row."""
    rdd, sc, k = blocks.select("r", "x").rdd, blocks.sparkSession.sparkContext, matrix.shape[1]
    count = blocks.count()
    g = math.ceil(math.sqrt(max(1, count)))
    rows = max(1, -(-n // max(1, count)))
    left = rdd.map(lambda row: ((row.r // g, row.r % g), _matrix(_centred(row.x, n, sums, d))))
    right = sc.parallelize(range(g), min(g, 16)).map(lambda c: ((c, c), _matrix(matrix)))
    product = BlockMatrix(left, rows, d, g * rows, g * d).multiply(BlockMatrix(right, d, k, g * d, g * k))
    own = product.blocks.filter(lambda b: b[0][0] * g + b[0][1] < count).map(
        lambda b: (b[0][0] * g + b[0][1], b[1].toArray().ravel().tolist()))
    return own.toDF("r int, p array<double>")


class Whitening:
    """What ``whiten`` fits: n, the sums of x, eigenvalues, components (one a column), explained shares and the identity error."""

    def __init__(self, n, sums, eigenvalues, components, trace):
        self.n, self.sums, self.eigenvalues, self.components = n, sums, eigenvalues, components
        self.explained = [float(e) / trace for e in eigenvalues]
        self.identity_error = float("nan")


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000,
           id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of every usable vector, and the fit.

    Entries become whole numbers, floor(scale * c) + shift. Deviation is the
    exact sum of (n*x - S)^2; whitened holds the centred row on each of the
    ``k`` first components over the root of its eigenvalue. Fewer components
    come back where the rows span fewer dimensions: none for a single row or
    equal rows. Null or repeated ids stay as they are, each row for itself; see
    ``usable_vectors`` for rows left out. No row, no result and no component.
    A vector may have ``MAX_DIMENSIONS`` entries. Other columns are ignored.
    """
    rows, n, d = usable_vectors(vectors, id_col, vector_col)
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MAX_DIMENSIONS} can be decomposed on one machine")
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema), Whitening(0, [], [], np.zeros((0, 0)), 1.0)
    x = F.transform("v", lambda c: F.floor(c * float(scale)) + F.lit(shift))
    blocks = row_blocks(rows.select("id", x.alias("x")), n, d)
    per_dim = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(row["s"]) for row in sorted(per_dim.collect(), key=lambda row: row["i"])]
    covariance = scatter(blocks, n, sums, d) / n
    e, u = components_of(covariance, k)
    fit = Whitening(n, sums, e, u, float(np.trace(covariance)) or 1.0)
    found = blocks.select("r", "ids", "x")
    if len(e):
        found = found.join(project(blocks, n, sums, d, u / np.sqrt(e)), "r")
    else:
        found = found.withColumn("p", F.array().cast("array<double>"))

    def run(batches):
        for batch in batches:
            for ids, x, p in zip(batch.column(0), batch.column(1), batch.column(2)):
                far = _deviations(x.as_py(), n, sums, d)
                if far.dtype != object and int(np.abs(far).max(initial=0)) ** 2 * d < 1 << 63:
                    total = pa.array((far * far).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    far = far.astype(object)
                    total = pa.array([Decimal(int(t)) for t in (far * far).sum(1)], pa.decimal128(38, 0))
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(e))
                yield pa.RecordBatch.from_arrays([ids.values, total, pa.ListArray.from_arrays(ends, p.values)],
                                                 names=["vec_id", "deviation", "whitened"])

    out = written(found.select("ids", "x", "p").mapInArrow(run, schema), "whitened")
    if len(e):
        w = [F.element_at("whitened", i + 1) for i in range(len(e))]
        pairs = [(i, j) for i in range(len(e)) for j in range(i + 1)]
        got = out.agg(*[F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
        fit.identity_error = max(got)
    return out, fit


def component_rows(out: DataFrame, fit: Whitening) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: one row a vector and component."""
    shares = F.array(*[F.lit(x) for x in fit.explained]) if fit.explained else F.array().cast("array<double>")
    rows = out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("i")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
