"""Session preparation, the shared scratch folder and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts vary from a few bytes to many megabytes, so batches stay short.
BATCH_ROWS = 512
#: Bytes in one Arrow batch, so that a run of long texts doesn't make a large one; a longer text is one by itself.
BATCH_BYTES = 1 << 23
#: Tasks that the rows of one key are dealt to where a key may hold many.
SALTS = 16
#: Rows of a table of some whole numbers that every task may hold.
SMALL_ROWS = 100_000
#: Edges, about, that one task joins at once.
BUCKET_EDGES = 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        env["PYTHONPATH"] = ":".join([here, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster's session names no folder that driver and executors share."""


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, if unset, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if root is None and current.isDefined():
        root = current.get()
    if root is None:
        if not sc.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkolyte-")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, how: str = "inner", ready: bool = False) -> DataFrame:
    """rows joined with groups (a row per key, how inner or left), whatever share of the rows one key holds.

    groups is worked out, unless it is ready, and counted first. Up to SMALL_ROWS of it are broadcast, so rows stay
    where they are; of more, the rows of one key are dealt to SALTS tasks by a hash of the column by.
    """
    groups = groups if ready else materialize(groups, "groups")
    if groups.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("_salt", salts).hint("merge"), [*keys, "_salt"], how).drop("_salt")


def _forest(found: pa.Table) -> pa.Table:
    """Of the edges of one bucket those that span what they join: every node with the least one it reaches."""
    u, v = (found.column(c).to_numpy() for c in ("u", "v"))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(ids)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    half = len(u)
    for a, b in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(ids))], np.int64)
    moved = root != np.arange(len(ids))
    return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(ids[root[moved]], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long) as (u, root), root the smallest id reachable.

    Buckets of edges are first reduced to spanning forests, in memory bounded by BUCKET_EDGES. Then large-star and
    small-star rounds alternate (Kiveris et al. 2014) until the edges are stars, so work per round is linear in the
    edges and no node's neighbours are gathered in one row. A hub's edges lie in several buckets and tasks. Self loops
    and null ends are ignored.
    """
    kept = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kept = materialize(kept, "edges")
    buckets = kept.count() // BUCKET_EDGES + 1
    dealt = kept.withColumn("_bucket", F.pmod(F.xxhash64("u"), F.lit(buckets)))
    e = materialize(dealt.groupBy("_bucket").applyInArrow(_forest, "u long, v long"), "forests")
    discard(kept)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below = F.col("v") < F.col("u")
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(below).alias("down"), F.count_if(~below).alias("up"))
        nodes = materialize(nodes, "nodes")
        # Stars: every node has one edge down and none up, or edges up alone.
        if nodes.where("down > 1 or down > 0 and up > 0").isEmpty():
            discard(nodes)
            return e.select("u", F.col("v").alias("root"))
        large = spread(both.where("v > u"), nodes.where("m < u").select("u", "m"), ["u"], "v", "left", ready=True)
        large = materialize(large.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")), "large_star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")), "low")
        small = spread(large, low.where("m < top").select("u", "m"), ["u"], "v", ready=True)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (last, large, low, nodes):
            discard(done)
