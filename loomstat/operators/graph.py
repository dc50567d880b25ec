"""Graphs as edge DataFrames: connected components and bounded expansion."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a folder of this machine, but only if Spark runs in this process alone (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/spark-{os.getpid()}-tables"
    return where


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable. vertices: (id); edges: (a, b), undirected.

    Each round every vertex takes the smallest label among itself, its neighbours and its label's own label (pointer
    jumping), so a chain of n needs about log n rounds; a checkpoint ends each round's lineage.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(vertices.select("id", F.col("id").alias("c")).distinct())
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        new = labels.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = new.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(new.join(jump, "c", "left").select("id", "old", F.least("c", "cc").alias("c")))
        done = new.where("old <> c").limit(1).count() == 0
        labels = new.select("id", "c")
        if done:
            return labels.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def expand(seeds: DataFrame, edges: DataFrame, depth: int, min_weight: float) -> DataFrame:
    """(node, hops): nodes reached from the seeds over edges (a, b, weight) of enough weight, in at most `depth` hops. The edges are computed once."""
    strong = cut(edges.where(F.col("weight") >= min_weight).select("a", "b"))
    both = strong.select("a", "b").unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = seeds.select("node", F.lit(0).alias("hops"))
    front = seen
    for k in range(1, depth + 1):
        front = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        front = cut(front)
        seen = seen.unionByName(front)
    return seen
