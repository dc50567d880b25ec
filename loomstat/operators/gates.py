"""Release gates, tiers, governance flags and the area state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.columns import all_of, cases, hours_before, reasons
from .limits import PROHIBITED, Limits
from .scans import finite_scan
from .slices import counts_within, gaps


def gates(limits: Limits, as_of: Column) -> dict[str, Column]:
    """Named conditions over columns size, n_sources, last_ts, volume (and quality, if wanted); null fails."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return {
        "size": ok(F.col("size") >= limits.min_size),
        "sources": ok(F.col("n_sources") >= limits.min_sources),
        "delay": ok(hours_before(as_of, F.col("last_ts")) >= limits.delay_hours),
        "volume": ok(F.col("volume") >= limits.min_volume),
    }


def release(groups: DataFrame, limits: Limits, as_of: Column) -> DataFrame:
    """Groups that pass every gate. Quality counts where the column exists and isn't null."""
    refuse_identity(groups)
    conds = list(gates(limits, as_of).values())
    if "quality" in groups.columns:
        conds.append(F.col("quality").isNull() | (F.col("quality") >= limits.min_quality))
    return groups.where(all_of(conds))


def audit(groups: DataFrame, limits: Limits, as_of: Column) -> DataFrame:
    """One row: groups in, out, and those that pass each gate, with the thresholds."""
    g = gates(limits, as_of)
    return groups.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(all_of(list(g.values()))).alias("n_out"), *[F.count_if(c).alias(f"pass_{k}") for k, c in g.items()],
        F.lit(limits.min_size).alias("min_size"), F.lit(limits.min_sources).alias("min_sources"), F.lit(limits.delay_hours).alias("delay_hours"),
    )


def failed(limits: Limits, as_of: Column) -> Column:
    """Names of the gates that a group fails."""
    return reasons([(~c, k) for k, c in gates(limits, as_of).items()])


def identity_fields(schema: DataType, prefix: str = "") -> list[str]:
    """Prohibited column names anywhere in a schema."""
    found = []
    if isinstance(schema, StructType):
        for f in schema.fields:
            if f.name.lower() in PROHIBITED:
                found.append(prefix + f.name)
            found += identity_fields(f.dataType, f"{prefix}{f.name}.")
    elif isinstance(schema, ArrayType):
        found += identity_fields(schema.elementType, prefix)
    elif isinstance(schema, MapType):
        found += identity_fields(schema.valueType, prefix)
    return found


def refuse_identity(df: DataFrame) -> DataFrame:
    """df, or an error if its schema has a column that identifies a person."""
    if bad := identity_fields(df.schema):
        raise ValueError(f"columns that identify a person: {', '.join(bad)}")
    return df


def precise(text: Column) -> Column:
    """Does the text hold coordinates or a street address?"""
    return text.rlike(r"[0-9]{2}\.[0-9]{4,},[ ]?-?[0-9]{2}\.[0-9]{4,}") | text.rlike(r"(?i)[0-9]{1,5} [a-z]+ (street|avenue|road|lane|drive)\b")


def delayed(df: DataFrame, as_of: Column, hours: int, ts: str = "ts") -> DataFrame:
    """Rows at least so old; rows without a time are dropped."""
    return df.where(F.col(ts) <= as_of - F.make_dt_interval(hours=F.lit(hours)))


def dynamic_threshold(base: Column, seed: int, context: Column, day: Column) -> Column:
    """The base threshold, moved by a daily choice of -1, 0, 0, 0 or 1 that depends on seed, day and context; at least 3."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), day.cast("string"), context.cast("string"))), 1, 8), 16, 10).cast("long") % 5
    return F.greatest(base + F.when(pick == 0, -1).when(pick == 4, 1).otherwise(0), F.lit(3))


def regularity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signs of coordination per key: 5 rows or more with regular short gaps, or one source with over 60 %."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    g = gaps(df, keys, slice_hours=1).groupBy(*keys).agg(F.var_pop(F.col("gap") / 6e7).alias("v"), F.avg(F.col("gap") / 6e7).alias("m"))
    g = per.join(g, keys, "left")
    share = df.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("top_share"))
    out = g.join(share, keys)
    five = F.col("n") >= 5
    return out.withColumn("regular", five & F.coalesce((F.col("v") < 25) & (F.col("m") < 30), F.lit(False))).withColumn("one_source", five & (F.col("top_share") > 0.6))


def concentration(df: DataFrame, keys: list[str], hours: int = 2) -> DataFrame:
    """The highest share of a key's rows within any such stretch."""
    k = counts_within(df, keys, 0, hours * 3_600_000_000 - 1)
    return k.groupBy(*keys).agg((F.max("k") / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))


# The states in order of attention, and the transitions that the machine allows; others keep the state.
STATES = ("silent", "insufficient", "delayed", "quiet", "active", "elevated")
ALLOWED = {
    "silent": {"insufficient", "delayed", "quiet", "active"},
    "insufficient": {"silent", "delayed", "quiet", "active", "elevated"},
    "delayed": {"silent", "insufficient", "quiet", "active", "elevated"},
    "quiet": {"silent", "insufficient", "delayed", "active"},
    "active": {"insufficient", "delayed", "quiet", "elevated"},
    "elevated": {"insufficient", "delayed", "quiet", "active"},
}


def area_state(n: Column, sources: Column, age_hours: Column, score: Column) -> Column:
    """The state of an area from its own numbers."""
    return cases([(F.coalesce(n, F.lit(0)) == 0, "silent"), ((n < 3) | (sources < 2), "insufficient"), (age_hours < 24, "delayed"), (score < 0.25, "quiet"), (score < 0.6, "active")], "elevated")


def advance(state: str, wanted: str) -> str:
    return wanted if wanted == state or wanted in ALLOWED[state] else state


def state_machine(days: DataFrame) -> DataFrame:
    """(region, day, wanted, before, state): the wanted state of each day (once a region and day; days as yyyy-MM-dd or as numbers), taken or not as the transitions allow, per region in the order of days, starting silent.

    A prefix scan over the six-to-six maps of days; no task folds a region.
    """
    number = {s: k for k, s in enumerate(STATES)}
    table = [[number[advance(s, w)] for s in STATES] for w in STATES]
    names = F.array(*[F.lit(s) for s in STATES])
    rows = days.select("region", "day", "wanted", F.expr("coalesce(try_cast(day as bigint), datediff(try_cast(day as date), date'0001-01-01'))").alias("at"))
    got = finite_scan(rows, ["region"], "at", F.array_position(names, F.col("wanted")).cast("int") - 1, number["silent"], table)
    name = lambda c: F.element_at(names, F.col(c) + 1)
    return rows.join(got, ["region", "at"]).select("region", "day", "wanted", name("before").alias("before"), name("after").alias("state"))


def transitions(states: DataFrame) -> DataFrame:
    """(region, day, previous, state, wanted): the log of a state machine, one row for each day on which the state changed."""
    return states.where("before <> state").select("region", "day", F.col("before").alias("previous"), "state", "wanted")


def checks(rows: Iterator[tuple[str, DataFrame, Column]] | list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(check, n, n_bad, passed): one row for each named check over a DataFrame; bad rows are those where the condition holds."""
    out = None
    for name, df, bad in rows:
        one = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("n_bad") == 0)
