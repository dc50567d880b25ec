"""Helpers shared by the text-corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a folder of this machine, but only if Spark runs in this process alone (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/spark-{os.getpid()}-cut"
    return where


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let no more than BATCH_ROWS rows go to a Python worker at once: texts are long, and both sides hold the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Folders that cut() wrote in this process and that are still there.
MADE: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Ends the lineage: a lost executor costs the running stage only, and what follows is planned
    from real file sizes. Columnar and compressed, so it needs far less disk than checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomstat-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column name: each row's place, rising in the order of its files' part numbers and of rows in files.

    A scan reads file splits by size, not in order, so the place comes from file and row index. A df that isn't a plain scan of files
    (or a projection or filter of one) is written first, in its own order. Only one row for each file comes to the driver.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        df = cut(df)
    columns = [F.col(c) for c in df.columns]
    rows = df.select(*columns, F.col("_metadata.file_path").alias("loomstat_file"), F.col("_metadata.row_index").alias("loomstat_row"))
    sizes = rows.groupBy("loomstat_file").agg((F.max("loomstat_row") + 1).alias("n")).collect()
    part = lambda path: (int(m[1]) if (m := re.search(r"/part-([0-9]+)[^/]*$", path)) else -1, path)
    before, at = [], 0
    for path, n in sorted(map(tuple, sizes), key=lambda x: part(x[0])):
        before.append((path, at))
        at += n
    first = df.sparkSession.createDataFrame(before, "loomstat_path string, loomstat_first long")
    placed = rows.join(F.broadcast(first), F.col("loomstat_file") == F.col("loomstat_path"))
    return placed.select(*columns, (F.col("loomstat_first") + F.col("loomstat_row")).alias(name))


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that cut() wrote, once nothing reads them any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in MADE:
            MADE.remove(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that cut() returned."""
    names = [name.rpartition("/")[0].rpartition("/loomstat-")[2] for name in df.inputFiles()[:1]]
    drop(df.sparkSession, [p for p in MADE if p.rpartition("/loomstat-")[2] in names])


#: A key of at least so many rows is hot, and there are at most so many hot keys: with more rows, it takes more of them to be hot.
HOT_ROWS, MOST_HOT = 128, 100_000
#: A table of keys of narrow rows is sent to every executor as it is if it can't have more rows.
SMALL = 100_000


def hot_join(rows: DataFrame, other: DataFrame, key: str, n: str, total: int, how: str = "inner", small: int | None = None) -> DataFrame:
    """rows joined with other, which has one row for each key; no task gets all rows of a hot key.

    n: the column of other that says how many rows have its key; total: at least the sum of these. Keys of very many rows (at most
    MOST_HOT, which total bounds) are sent to every executor; the others are joined by a shuffle. how: inner or left. other is sent whole if total is at
    most `small` (SMALL; 0 for wide rows).
    """
    if total <= (SMALL if small is None else small):
        return rows.join(F.broadcast(other), key, how).select(*rows.columns, *[c for c in other.columns if c != key])
    hot_from = max(HOT_ROWS, total // MOST_HOT)
    rest = [c for c in other.columns if c != key]
    hot = F.broadcast(other.where(F.col(n) >= hot_from).select(F.col(key).alias("loomstat_hot"), *rest))
    met = rows.join(hot, F.col(key) == F.col("loomstat_hot"), "left")
    cold = met.where("loomstat_hot is null").select(*rows.columns).join(other.where(F.col(n) < hot_from), key, how)
    names = [*rows.columns, *rest]
    return met.where("loomstat_hot is not null").select(*names).unionByName(cold.select(*names))


def lowest(rows: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with m, the smallest v of each u. The minimum is combined before it is shuffled."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(rows, least, "u", "n", total).drop("n")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (id, component), component = smallest id reached.

    Alternating large-star / small-star rounds (Kiveris et al. 2014). A vertex with very many edges is neither collected nor paired with
    itself nor sent to one task: see hot_join(). Ids without an edge are not in the result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e)
    n = e.count()
    for _ in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(sym, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v")
        small = lowest(large, n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        nxt = cut(small.where("u > v").distinct())
        drop_cut(e)
        e = nxt
        # Settled once all edges are stars: no vertex has two smaller ones, or both a smaller and a greater one.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, unsettled = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
