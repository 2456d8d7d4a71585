"""Tables in the cluster's shared folder: they cut lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder of our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="spark-skyloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skyloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; it survives lost executors."""
    path = shared_path(df.sparkSession, name) + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
