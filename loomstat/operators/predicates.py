"""Composable predicates: filters and trees of filters as plain data, turned into one Column for Catalyst to push down."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, any_word


def _text(c: Column) -> Column:
    return F.lower(c.cast("string"))


def _low(v: Any) -> str:
    return str(v).lower()


#: Operator name -> (column, value) -> condition. Text operators ignore case; between is for dates and inclusive.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "equals": lambda c, v: c == F.lit(v),
    "not_equals": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "contains": lambda c, v: _text(c).contains(_low(v)),
    "not_contains": lambda c, v: ~F.coalesce(_text(c).contains(_low(v)), F.lit(False)),
    "starts_with": lambda c, v: _text(c).startswith(_low(v)),
    "ends_with": lambda c, v: _text(c).endswith(_low(v)),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~F.coalesce(c.isin(*v), F.lit(False)),
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "between": lambda c, v: (c >= F.to_timestamp(F.lit(v[0]))) & (c <= F.to_timestamp(F.lit(v[1]))),
    "exists": lambda c, v: c.isNotNull(),
    "not_exists": lambda c, v: c.isNull(),
}


def condition(spec: Mapping[str, Any] | Callable[[], Column]) -> Column:
    """One filter: {"field": "a.b", "operator": name, "value": v}, or a function that returns a Column."""
    if callable(spec):
        return spec()
    name = spec["operator"]
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}")
    return OPERATORS[name](F.col(spec["field"]), spec.get("value"))


def conjunction(specs: Sequence[Mapping[str, Any]]) -> Column:
    return all_of([condition(s) for s in specs])


def tree(spec: Mapping[str, Any]) -> Column:
    """A filter, or {"logic": "AND" | "OR", "rules": [trees]}. No rules: everything."""
    if "rules" not in spec:
        return condition(spec)
    parts = [tree(r) for r in spec["rules"]]
    if not parts:
        return F.lit(True)
    logic = spec.get("logic", "AND").upper()
    if logic not in ("AND", "OR"):
        raise ValueError(f"unknown logic {logic!r}")
    return all_of(parts) if logic == "AND" else any_of(parts)


def keywords(fields: Sequence[str], words: Sequence[str]) -> Column:
    """Any of the words, anywhere in any of the fields."""
    return F.concat_ws(" ", *[F.col(f) for f in fields]).rlike(any_word(list(words), whole=False))


def named(regions: Sequence[str] = (), strength: tuple[float | None, float | None] = (None, None), dates: tuple[str | None, str | None] = (None, None), sources: Sequence[str] = (), search: str = "") -> Column:
    """The fixed facets over columns region, strength, ts, sources (array); search looks into the whole row."""
    out = []
    if regions:
        out.append(F.col("region").isin(*regions))
    if strength[0] is not None:
        out.append(F.col("strength") >= strength[0])
    if strength[1] is not None:
        out.append(F.col("strength") <= strength[1])
    if dates[0]:
        out.append(F.col("ts") >= F.to_timestamp(F.lit(dates[0])))
    if dates[1]:
        out.append(F.col("ts") <= F.to_timestamp(F.lit(dates[1])))
    if sources:
        out.append(F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources])))
    if search:
        out.append(F.lower(F.to_json(F.struct("*"))).contains(search.lower()))
    return all_of(out)


def presets(as_of: str) -> dict[str, dict[str, Any]]:
    """Named conjunctions, relative to a time."""
    day = lambda n: {"field": "ts", "operator": ">=", "value": as_of, "days": n}
    return {
        "recent_24h": day(1),
        "recent_7d": day(7),
        "recent_30d": day(30),
        "high_intensity": {"field": "weight", "operator": ">=", "value": 75.0},
        "low_intensity": {"field": "weight", "operator": "<", "value": 25.0},
    }


def preset(name: str, as_of: str) -> Column:
    if name == "weekend":
        return F.dayofweek("ts").isin(1, 7)
    p = presets(as_of)[name]
    if "days" in p:
        return F.col(p["field"]) >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(days=F.lit(p["days"]))
    return condition(p)


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).where(F.col(field).isNotNull()).distinct().orderBy(field)
