"""Readers, sinks and streams on small hand-made files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstat.operators.limits import PROHIBITED
from loomstat.sources import adapters, readers, sinks
from loomstat.streaming import streams


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,zip,date,url\n"He said ""no"", twice",01101,2024-01-01,\n,01101,2024-01-01,\n   ,1,2,3\nok,1,2,3\n')
    ok, bad = readers.csv_signals(spark, f"file://{tmp_path}/a.csv")
    assert [(r["text"], r["source"]) for r in ok.orderBy("text").collect()] == [('He said "no", twice', "a"), ("ok", "a")]
    assert bad.count() == 2


def test_families_and_aliases(spark, tmp_path):
    for name in ("x_1.csv", "x_2.csv", "y_1.csv"):
        (tmp_path / name).write_text("text,zip,date,url\nhello,1,2,3\n")
    got = readers.families(spark, f"file://{tmp_path}", {"x_*.csv": "ex", "y_*.csv": "why"})
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"ex": 2, "why": 1}
    df = spark.createDataFrame([("a", None), (None, "b")], "Content string, message string")
    assert [r["text"] for r in readers.aliased(df, {"text": ["content", "MESSAGE"], "date": ["when"]}).collect()] == ["a", "b"]


def test_no_adapter_projects_an_identity(spark, sf):
    for f in (adapters.event_signals, adapters.text_signals, adapters.vector_groups, adapters.event_groups):
        assert not set(f(spark, sf).columns) & set(PROHIBITED)


def test_retention(spark):
    df = spark.createDataFrame([(1, "2024-01-30"), (2, "2023-01-01"), (3, None)], "id int, t string").withColumn("ts", F.to_timestamp("t"))
    kept, gone = sinks.pruned(df, F.to_timestamp(F.lit("2024-01-31")), 90)
    assert ([r["id"] for r in kept.collect()], sorted(r["id"] for r in gone.collect())) == ([1], [2, 3])


def test_windows_wait_for_the_delay(spark, tmp_path):
    schema = StructType.fromDDL("id long, region string, ts timestamp")
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"

    def put(*times):
        spark.createDataFrame([(k, "r", t) for k, t in enumerate(times)], "id long, region string, t string").select("id", "region", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(raw)

    def run():
        df = streams.vetted(streams.files(spark, raw, schema), now=F.to_timestamp(F.lit("2024-02-01")))
        streams.to_table(streams.windowed(df, ["region"], "1 hour"), f"{out}/t", f"{out}/c")
        return [(r["start"].day, r["start"].hour, r["n"]) for r in spark.read.parquet(f"{out}/t").orderBy("start").collect()]

    put("2024-01-01 10:10:00", "2024-01-01 10:20:00", "2024-01-01 12:00:00")
    assert run() == []  # nothing is older than 24 hours yet
    put("2024-01-02 11:30:00", "2030-01-01 00:00:00")  # a row from the future must not release anything
    assert run() == [(1, 10, 2)]
    put("2024-01-01 10:30:00", "2024-01-02 13:30:00")  # late for its window; and a sentinel
    assert run() == [(1, 10, 2), (1, 12, 1)]


def test_state_machine_keeps_state_between_batches(spark, tmp_path):
    schema = StructType.fromDDL("region string, day string, wanted string")
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for rows in ([("a", "1", "quiet"), ("a", "2", "active")], [("a", "3", "elevated"), ("b", "3", "elevated"), ("a", "0", "quiet")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(raw)
        with streams.keyed_state(spark):
            streams.to_table(streams.area_states(streams.files(spark, raw, schema)), f"{out}/t", f"{out}/c")
    got = {(r["region"], r["day"]): r["state"] for r in spark.read.parquet(f"{out}/t").collect()}
    assert got == {("a", "1"): "quiet", ("a", "2"): "active", ("a", "3"): "elevated", ("b", "3"): "silent", ("a", "0"): None}  # a late day has no state
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("stretches", [1, 24])
def test_rate_limit_over_batches(spark, tmp_path, stretches):
    """Counts go on over micro-batches and slices; a row that is late within the delay counts what has arrived; one beyond it gets no row."""
    schema = StructType.fromDDL("id long, region string, ts timestamp")
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    batches = [
        [(1, "10:10:00"), (2, "10:50:00"), (3, "10:50:00")],
        [(4, "11:05:00"), (5, "11:10:00"), (6, "11:10:01"), (7, "10:55:00")],  # 7 is late, but within an hour
        [(8, "15:00:00")],
        [(9, "15:30:00"), (10, "10:20:00")],  # 10 is late by hours
    ]
    for rows in batches:
        df = spark.createDataFrame([(i, "r", f"2024-01-01 {t}") for i, t in rows], "id long, region string, t string")
        df.select("id", "region", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(raw)
        with streams.keyed_state(spark):
            streams.to_table(streams.rate_limit(streams.files(spark, raw, schema), "region", "ts", "id", 3, stretches=stretches), f"{out}/t", f"{out}/c")
    got = {r["id"]: (r["n"], r["accepted"]) for r in spark.read.parquet(f"{out}/t").collect()}
    assert got == {1: (1, True), 2: (3, True), 3: (3, True), 4: (5, False), 5: (6, False), 6: (6, False), 7: (4, False), 8: (1, True), 9: (2, True)}


def test_counts_over_two_batches(spark, tmp_path):
    """Counts of a key add up over micro-batches, and a batch that runs again replaces its own."""
    schema = StructType.fromDDL("region string, source string")
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    put = streams.batch_counts(f"{out}/t", ["region", "source"])
    for n in (10, 5):
        spark.createDataFrame([("r", "s")] * n, schema).write.mode("append").parquet(raw)
        streams.each_batch(streams.files(spark, raw, schema), put, f"{out}/c")
    total = lambda: [tuple(r) for r in streams.total_counts(spark, f"{out}/t", ["region", "source"], "region string, source string").collect()]
    assert total() == [("r", "s", 15)]
    put(spark.createDataFrame([("r", "s")] * 5, schema), 1)
    assert total() == [("r", "s", 15)]


def test_counts_are_merged_once(spark, tmp_path):
    """Each batch is merged into what the one before left; a batch that runs again counts once, and older tables go."""
    path = f"file://{tmp_path}/t"
    put = streams.merged_counts(path, ["region"])
    batch = lambda **n: spark.createDataFrame([(r,) for r, k in n.items() for _ in range(k)], "region string")
    total = lambda: {r["region"]: r["n"] for r in spark.read.parquet(f"{path}/{streams.versions(spark, path)[-1]}").collect()}
    assert streams.versions(spark, path) == []
    put(batch(a=3, b=1), 0)
    put(batch(a=2), 1)
    put(batch(a=2), 1)
    assert total() == {"a": 5, "b": 1}
    put(batch(c=4), 2)
    put(batch(c=4), 2)
    put(batch(c=0), 3)
    assert total() == {"a": 5, "b": 1, "c": 4} and streams.versions(spark, path) == [2, 3]
