"""Session helpers: session defaults, checkpoint folder and guarded broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library relies on. AQE coalesces tiny shuffles locally and
# splits skewed join partitions on a cluster; the rest keeps oracle
# comparisons stable (UTC) and Arrow batches bounded.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "seqframe", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults.

    On a cluster the session normally exists already (spark-submit); then only
    SQL confs that are unset are filled in, nothing is overridden.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in DEFAULT_CONF.items():
            if k.startswith("spark.sql.") and active.conf.get(k, None) is None:
                active.conf.set(k, v)
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is only created here when the
    setting is unset (local tests), in a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder (HDFS/S3/ABFS) "
                               "so checkpoints survive executor loss")
        conf_dir = tempfile.mkdtemp(prefix="seqframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table whose row count is bounded by construction.

    ``max_rows`` documents the proven bound (e.g. 20 residues x L positions).
    Callers only use this for tables built from fixed alphabets or
    parameter-sized grids; data-sized tables are never broadcast by hint and
    are left to AQE, which switches to a broadcast only from runtime sizes.
    """
    if max_rows > 5_000_000:
        return df
    return F.broadcast(df)


def checked_broadcast(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``max_rows`` rows (they are counted), else as it is.

    For tables that are small by their nature but come from the caller, such as models."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table built from literals in the JVM (``inline`` of
    an array of structs). Unlike ``createDataFrame(list)`` it needs no Python
    worker and no RDD scan, and Catalyst folds it into a local relation."""
    def lit(v):
        if isinstance(v, (list, tuple)):
            return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")
        return F.lit(v)
    structs = [F.struct(*[lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
