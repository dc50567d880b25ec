"""Prefix scans of associative maps over ordered rows, by slices.

What a row does to a state is a map; maps compose. Slices of neighbouring places are composed in one aggregation, slices of slices in the next, until one is left for each key; then the state
at the beginning of each slice goes down again the same way. No task holds more than FAN rows of a key together, however long its history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Neighbours that are composed at a time.
FAN = 64


def scan(
    df: DataFrame, keys: list[str], place: str, start: Column, change: Column, compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column], fan: int = FAN
) -> DataFrame:
    """(keys, place, before, after): the state before and after each row of a key, in the order of places (whole numbers, not below 0, each once for a key; gaps are fine).

    start: the first state; change: a row's map; compose(first, second): the map of both; apply(map, state): the state after it.
    """
    key = [F.col(k) for k in keys]
    level = cut(df.select(*key, F.col(place).cast("long").alias("at"), change.alias("m")))
    most = level.agg(F.max("at")).first()[0] or 0
    levels = []
    while True:
        items = F.sort_array(F.collect_list(F.struct("at", "m"))).alias("items")  # at most fan
        level = level.groupBy(*keys, F.floor(F.col("at") / fan).cast("long").alias("slice")).agg(items)
        levels.append(level)
        if most < fan:
            break
        composed = F.aggregate(F.slice("items", 2, fan), F.element_at("items", 1)["m"], lambda m, x: compose(m, x["m"]))
        level = cut(level.select(*key, F.col("slice").alias("at"), composed.alias("m")))
        most //= fan
    states = levels[-1].select(*keys, "slice", start.alias("state"))
    for level in reversed(levels):
        def step(acc: Column, x: Column) -> Column:
            after = apply(x["m"], acc["now"])
            return F.struct(after.alias("now"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["now"].alias("before"), after.alias("after")))).alias("out"))

        joined = level.join(states, [*keys, "slice"])
        kind = joined.schema["state"].dataType.simpleString()
        none = F.struct(F.col("state").alias("now"), F.from_json(F.lit("[]"), f"array<struct<at:bigint,before:{kind},after:{kind}>>").alias("out"))
        run = F.aggregate("items", none, step, lambda acc: acc["out"])
        out = joined.select(*key, F.explode(run).alias("x"))
        states = out.select(*key, F.col("x.at").alias("slice"), F.col("x.before").alias("state"))
    return out.select(*key, F.col("x.at").alias(place), F.col("x.before").alias("before"), F.col("x.after").alias("after"))


def finite_scan(df: DataFrame, keys: list[str], place: str, wanted: Column, start: int, table: list[list[int]]) -> DataFrame:
    """The scan of an automaton: table[wanted][state] is the next state; wanted: a row's symbol, as a number."""
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])
    return scan(df, keys, place, F.lit(start), F.element_at(rows, wanted + 1), lambda a, b: F.transform(a, lambda s: F.element_at(b, s + 1)), lambda m, s: F.element_at(m, s + 1))


def decayed_sums(df: DataFrame, keys: list[str], place: str, value: Column, decay: float) -> DataFrame:
    """(keys, place, total, weight): the sums of values and of ones up to each row, those of k rows before weighing decay**k."""
    x = lambda d, t, w: F.struct(d.alias("d"), t.alias("t"), w.alias("w"))
    change = x(F.lit(decay), value.cast("double"), F.lit(1.0))
    compose = lambda a, b: x(a["d"] * b["d"], a["t"] * b["d"] + b["t"], a["w"] * b["d"] + b["w"])
    state = lambda t, w: F.struct(t.alias("t"), w.alias("w"))
    apply = lambda m, s: state(s["t"] * m["d"] + m["t"], s["w"] * m["d"] + m["w"])
    got = scan(df, keys, place, state(F.lit(0.0), F.lit(0.0)), change, compose, apply)
    return got.select(*keys, place, F.col("after.t").alias("total"), F.col("after.w").alias("weight"))
