"""Structured Streaming forms of the operators. Released output waits for the watermark, which is the tier's delay."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..functions.columns import cosine
from ..operators.gates import advance, refuse_identity
from ..operators.sizes import sent


def files(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a directory or glob."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def vetted(df: DataFrame, ts: str = "ts", now: Column | None = None, tolerance: str = "5 minutes") -> DataFrame:
    """Rows that don't come from the future; a future row would advance the watermark and release windows early. Must come before any watermark."""
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(ts) <= now + F.expr(f"interval {tolerance}"))


def dedup(df: DataFrame, keys: list[str], delay: str = "24 hours", ts: str = "ts") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed(df: DataFrame, keys: list[str], length: str, slide: str | None = None, delay: str = "24 hours", ts: str = "ts") -> DataFrame:
    """Counts per key and window; in append mode a window leaves only when the delay after its end has passed."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    got = df.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(df: DataFrame, keys: list[str], gap: str, delay: str = "24 hours", ts: str = "ts") -> DataFrame:
    got = df.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which transformWithStateInPandas needs; the session's setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Limiter(StatefulProcessor):
    """Counts rows of a key in the trailing stretch before each row of one slice of time. State: the times of the slice and of the stretch before it; a timer clears it once the watermark is past the slice."""

    def __init__(self, limit: int, micros: int, slice_micros: int):
        self.limit, self.micros, self.slice_micros = limit, micros, slice_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "id"])  # rows of one key and slice
        known = [r[0] for r in self.times.get()] if self.times.exists() else []
        if not known:
            self.handle.registerTimer((int(key[1]) + 1) * self.slice_micros // 1000 + 1)
        self.times.appendList([(int(t),) for t in new["t"]])
        times = np.sort(np.concatenate((np.array(known, dtype=np.int64), new["t"].to_numpy(dtype=np.int64))))
        own = new[~new["guest"]]
        t = own["t"].to_numpy(dtype=np.int64)
        # Rows of one moment all count for each other, as in a range frame.
        n = np.searchsorted(times, t, "right") - np.searchsorted(times, t - self.micros, "left")
        yield pd.DataFrame({"id": own["id"].to_numpy(), "n": n, "accepted": n <= self.limit})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limit(df: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: int = 3600, delay: str = "1 hour", stretches: int = 24) -> DataFrame:
    """(id, n, accepted): rows of the key in the trailing stretch, the row included, among those that have arrived by its batch. To be started within keyed_state().

    State is kept by key and slice of time (so many stretches), so a key of very many rows is spread over its slices; a row goes to its own slice and, in the slice's last stretch, also to the next one, to be counted. A
    row that is late by more than `delay` isn't counted and gets no row: late_splitter() keeps such rows.
    """
    micros = seconds * 1_000_000
    rows = df.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("t"))
    length = stretches * micros
    own = F.floor(F.col("t") / length)
    here, next_one = F.struct(own.alias("slice"), F.lit(False).alias("guest")), F.struct((own + 1).alias("slice"), F.lit(True).alias("guest"))
    dealt = rows.select("*", F.explode(F.when(F.pmod("t", F.lit(length)) >= length - micros, F.array(here, next_one)).otherwise(F.array(here))).alias("x"))
    dealt = dealt.select("key", "x.slice", "x.guest", "id", "ts", "t")
    return dealt.groupBy("key", "slice").transformWithStateInPandas(Limiter(limit, micros, length), "id long, n long, accepted boolean", "append", "eventTime")


class Machine(StatefulProcessor):
    """The state machine of a region over the days of all batches. State: the last day and the state after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "day string, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, now = tuple(self.now.get()) if self.now.exists() else ("", "silent")
        new = pd.concat(list(rows)).sort_values("day")  # a row for each day
        out = []
        for day, wanted in zip(new["day"], new["wanted"], strict=True):
            if day <= last:  # late: what was decided stays
                out.append(None)
                continue
            last, now = day, advance(now, wanted)
            out.append(now)
        self.now.update((last, now))
        yield pd.DataFrame({"region": key[0], "day": new["day"].to_numpy(), "wanted": new["wanted"].to_numpy(), "state": out})

    def close(self) -> None:
        pass


def area_states(df: DataFrame) -> DataFrame:
    """(region, day, wanted, state): the state machine over rows (region, day, wanted), aggregated to days, its state kept between batches. To be started within keyed_state().

    A day that comes after a later one, or again, is late: it has no state and changes nothing.
    """
    return df.groupBy("region").transformWithStateInPandas(Machine(), "region string, day string, wanted string, state string", "append", "none")


def assign(df: DataFrame, centroids: DataFrame, id_col: str, vector: str) -> Callable[[DataFrame, int], DataFrame]:
    """Nearest topic for each batch, without refitting; centroids: (topic, centroid), few."""

    def one(batch: DataFrame, _: int = 0) -> DataFrame:
        n = batch.join(sent(centroids), F.lit(True)).withColumn("s", cosine(F.col(vector), F.col("centroid")))
        return n.groupBy(id_col).agg(F.max_by("topic", F.struct("s", -F.col("topic"))).alias("topic"))

    return one


def late_splitter(path: str, ts: str, hours: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows older than the newest time seen in earlier batches minus the delay go to path/late, others to path/on_time; the newest time is kept in path/seen."""

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.schema("t timestamp, number long").parquet(f"{path}/seen").where(F.col("number") < number).agg(F.max("t")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        limit = F.lit(seen).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
        late = F.coalesce(F.col(ts) < limit, F.lit(False))
        # Partitions named by batch: a batch that runs again replaces its own rows.
        for name, cond in (("late", late), ("on_time", ~late)):
            batch.where(cond).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        batch.agg(F.max(ts).alias("t")).withColumn("number", F.lit(number).cast("long")).write.mode("append").parquet(f"{path}/seen")

    return split


def batch_counts(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps counts by key: each batch writes its own, in a partition named by batch, so a batch that runs again replaces them."""

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(number))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return put


def total_counts(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """Counts of all batches so far."""
    return spark.read.schema(f"{schema}, n long, batch int").parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole tables below a path, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = [f.getPath() for f in system.listStatus(where)]
    return sorted(int(f.getName()) for f in found if f.getName().isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def merged_counts(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one table of counts by key: each batch merges its own into the table that the batch before left, and writes it under its number.

    A batch that runs again starts from the same table, so it counts once. Of older tables only the one before stays.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if before:
            counts = spark.read.schema(counts.schema).parquet(f"{path}/{before[-1]}").unionByName(counts).groupBy(*keys).agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/{number}")
        for old in before[:-1]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return put


def to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run over what there is now, appending to a Parquet table."""
    refuse_identity(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
