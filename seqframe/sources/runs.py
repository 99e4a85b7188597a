"""Model persistence (S8) and the run table."""

from __future__ import annotations

import importlib
import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model, path: str) -> None:
    """Persist a fitted model together with its scaler (a PipelineModel
    or any MLWritable)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load what ``save_model`` wrote: a pipeline, a bare ``pyspark.ml`` model or one of this library's."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])
    name = meta["class"]
    if name.startswith("org.apache.spark.ml."):
        name = name.replace("org.apache.spark.ml.", "pyspark.ml.")
        if name == "pyspark.ml.PipelineModel":
            return PipelineModel.load(path)
    module, cls = name.rsplit(".", 1)
    if not module.startswith(("pyspark.ml.", "seqframe.")):
        raise ValueError(f"{path} holds a {name}, which is no model of Spark or of this library")
    return getattr(importlib.import_module(module), cls).load(path)


def append_run_log(spark: SparkSession, path: str, run: str, values: dict) -> DataFrame:
    """Append (run, key, value, ts) rows - scores, best params, trials,
    elapsed time - to a Parquet run table."""
    ts = time.time()
    rows = [(run, str(k), json.dumps(v, default=str), ts) for k, v in values.items()]
    df = spark.createDataFrame(rows, "run string, key string, value string, ts double")
    df.write.mode("append").parquet(path)
    return df


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("ts", "run", "key")

