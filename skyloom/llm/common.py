"""Shared helpers: tables in the cluster's shared folder, hashing, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (what ``bytes.split()`` splits on).
SPACE = r"[\x20\x09-\x0D]+"

U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="spark-skyloom-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skyloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skyloom_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table made by :func:`table` that nothing reads any more."""
    path = getattr(df, "_skyloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that executors delete their files."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def local_union_find(batches):
    """Links of one partition -> a spanning star forest of them (node, smallest node)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that can be reached.

    Union-find inside each partition leaves a forest; hooking and shortcutting over joins merge the forests
    of all partitions in a logarithmic number of rounds. Only a count of changes reaches the driver.
    """
    forest = edges.select("a", "b").mapInArrow(local_union_find, "a long, b long")
    both = table(forest.select("a", "b").union(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        seen = labels.join(near, "node")
        hook = seen.groupBy(F.col("component").alias("root")).agg(F.min("m").alias("h"))
        hooked = seen.join(hook, F.col("component") == F.col("root")).select("node", F.col("component").alias("was"), F.least("component", "m", "h").alias("c"))
        step = table(hooked, f"{name}-hook")
        up = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        after = table(step.join(up, "c", "left").select("node", "was", F.least("c", F.coalesce("cc", "c")).alias("component")), f"{name}-labels")
        changed = after.where("component <> was").limit(1).count()
        drop_table(step)
        drop_table(labels)
        labels = after
        if not changed:
            drop_table(both)
            out = labels.select("node", "component")
            out._skyloom_path = labels._skyloom_path
            return out


def merge_components(labels: DataFrame, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Labels (node, component) of all nodes, after the new links (a, b) between them."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    linked = table(edges.join(la, "a").join(lb, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"{name}-links")
    if linked.limit(1).count() == 0:
        drop_table(linked)
        return labels
    comps = connected_components(linked, name)
    new = comps.select(F.col("node").alias("component"), F.col("component").alias("to"))
    out = table(labels.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{name}-merged")
    for x in (linked, comps, labels):
        drop_table(x)
    return out
