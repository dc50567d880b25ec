"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, form blocks. In the ideal fluid mix all sources that still have blocks advance
at rates in proportion to their weights; block k of a source may not start before the fluid mix has reached its beginning (its release) and
must end by the slot in which the fluid mix completes it (its deadline). One block per slot, earliest deadline first among
the released, keeps every source within less than one block of the fluid mix at all times.

Weights are kept exactly as given, so releases and deadlines are those of the true fluid mix. What the scheduler knows at a slot is little: of each source the whole
blocks that the fluid mix has completed by then, and whether the block that it is in is already placed. So the slots are cut into periods, which are scheduled apart from each other from
a state that is estimated (of the blocks begun, those of the earliest deadlines are placed, as far as there were slots for them). Each period returns the state at its end; where
the next one started from another state, it is scheduled again, round by round until all agree. The result is then just that of one scheduler that goes through all slots.
Spark counts, ranks and places the documents and schedules the periods.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import ceil, lcm, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_HOT, cut, drop_cut

#: Slots of a period; 16 for each source, if that is more.
PERIOD = 1024
#: Periods before a slot that the estimate of its state looks back at.
LOOK = 8
#: A list of at most so many rows of fixed width (below 100 bytes) is sent to every executor; a longer one is joined by a shuffle.
MOST_SENT = 200_000
#: Documents of one (source, hash range) group, about, and ranges of a source that are added up together.
GROUP, RANGES = 500, 1024


class Fluid:
    """The ideal mix: in virtual time v, source s has advanced by min(weight * v, its blocks); all sources together fill the slots."""

    def __init__(self, blocks: list[int], weights: list[Fraction]):
        scale = lcm(*(w.denominator for w in weights))
        self.n, self.w = blocks, [int(w * scale) for w in weights]
        #: By phase (they end where a source runs out): its beginning, blocks of the sources that have run out, and the others' weight.
        self.starts, self.over, self.rate = [Fraction(0)], [0], [sum(self.w)]
        for end, s in sorted((Fraction(n, w), s) for s, (n, w) in enumerate(zip(self.n, self.w, strict=True))):
            self.starts.append(end)
            self.over.append(self.over[-1] + self.n[s])
            self.rate.append(self.rate[-1] - self.w[s])
        self.slots = [a + v * r for a, v, r in zip(self.over, self.starts, self.rate, strict=True)]

    def border(self, s: int, k: int) -> tuple[int, int]:
        """The slot in which the mix completes k blocks of a source, rounded down and up."""
        p = bisect_right(self.starts, Fraction(k, self.w[s])) - 1
        slot, rest = divmod(k * self.rate[p], self.w[s])
        return self.over[p] + slot, self.over[p] + slot + (rest > 0)

    def at(self, slot: int) -> list[Fraction]:
        """How many blocks of each source the mix has completed after so many slots."""
        p = bisect_right(self.slots, slot) - 1
        if not self.rate[p]:
            return [Fraction(n) for n in self.n]
        v = (slot - self.over[p]) / Fraction(self.rate[p])
        return [min(Fraction(n), w * v) for n, w in zip(self.n, self.w, strict=True)]

    def ceilings(self, first: int, last: int) -> np.ndarray:
        """For each slot of a range the blocks that the mix has begun or completed, in all (in doubles, for an estimate)."""
        slot = np.arange(first, last, dtype=np.float64)
        p = np.searchsorted(np.array([float(x) for x in self.slots]), slot, "right") - 1
        rate = np.maximum(np.array([float(x) for x in self.rate])[p], 1e-300)
        v = np.where(np.array(self.rate, dtype=object)[p] == 0, np.inf, (slot - np.array(self.over, dtype=np.float64)[p]) / rate)
        return sum(np.ceil(np.minimum(float(n), float(w) * v) - 1e-9) for n, w in zip(self.n, self.w, strict=True))


def estimated(mix: Fluid, slot: int, look: int) -> list[int]:
    """How many blocks of each source are placed before a slot, as earliest deadline first leaves it; exact unless what lies more than `look` slots back matters."""
    fluid = mix.at(slot)
    done = [int(f) for f in fluid]
    begun = sorted((mix.border(s, done[s] + 1)[1], -mix.w[s], s, mix.border(s, done[s])[0]) for s, f in enumerate(fluid) if f > done[s])
    more = slot - sum(done)
    if not more:
        return done
    # Of the blocks begun before slot t, so many at least are placed, for else t and later slots had to hold more than they can.
    first = max(0, slot - look, min(b[3] for b in begun) + 1)
    t = np.arange(first, slot)
    need = np.searchsorted(np.sort([b[3] for b in begun]), t, "left") - (mix.ceilings(first, slot) - t)
    t, room = t[need > 0], more - need[need > 0]
    for _, _, s, release in begun:
        late = t <= release
        if (room[late] > 0).all():
            room[late] -= 1
            done[s] += 1
            more -= 1
            if not more:
                break
    for _, _, s, _ in begun:  # only if the estimate left slots empty
        if more and done[s] == int(fluid[s]):
            done[s] += 1
            more -= 1
    return done


def scheduled(mix: Fluid, first: int, last: int, done: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """(slot, source number, block number from 0, release, deadline) of a range of slots, and how many blocks of each source are placed after it."""
    done, begin = list(done), {}

    def window(s: int) -> tuple[int, int, int]:
        """Release and deadline of the source's next block."""
        down, up = mix.border(s, done[s] + 1)
        release = begin.get(s)
        begin[s] = down
        return mix.border(s, done[s])[0] if release is None else release, up, s

    waiting = [window(s) for s, n in enumerate(mix.n) if done[s] < n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(first, last):
        while waiting and waiting[0][0] <= slot:
            r, d, s = heapq.heappop(waiting)
            heapq.heappush(ready, (d, -mix.w[s], s, r))
        if ready:
            d, _, s, r = heapq.heappop(ready)
        else:  # only after a wrong estimate could there be no released block
            r, d, s = heapq.heappop(waiting)
        out.append((slot, s, done[s], r, d))
        done[s] += 1
        if done[s] < mix.n[s]:
            heapq.heappush(waiting, window(s))
    return out, done


def schedule(blocks: list[int], weights: list[Fraction]) -> list[tuple[int, int, int, int, int]]:
    """(slot, source number, block number from 0, release, deadline), one for each block of every source, by one scheduler."""
    return scheduled(Fluid(blocks, weights), 0, sum(blocks), [0] * len(blocks))[0] if blocks else []


def target_weights(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None) -> dict[str | None, Fraction]:
    """The weight of each source, exactly as given in decimals (a source that isn't named gets the smallest), else the square root of its documents (as a double)."""
    if weights is None:
        return {s: Fraction(repr(sqrt(n))) for s, n in counts.items()}
    given = {s: Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(repr(float(w))) for s, w in weights.items() if w > 0}
    least = min(given.values(), default=Fraction(1))
    return {s: given.get(s, least) for s in counts}


def periods(spark, mix: Fluid, length: int) -> DataFrame:
    """The whole schedule, written: (slot, number, block, release, deadline). Periods are scheduled apart; those that began with a wrong estimate again."""
    total = sum(mix.n)
    n = -(-total // length)
    fields = "period long, start array<long>, end array<long>, number array<int>, block array<long>, release array<long>, deadline array<long>"

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for period, start in zip(b["period"].tolist(), b["start"], strict=True):
                start = estimated(mix, period * length, LOOK * length) if start is None else [int(x) for x in start]
                plan, end = scheduled(mix, period * length, min(total, (period + 1) * length), start)
                columns = list(zip(*plan, strict=True))
                yield pd.DataFrame([(period, start, end, *map(list, columns[1:]))], columns=[f.split()[0] for f in fields.split(", ")])

    todo = spark.range(0, n, 1, max(1, min(n, 512))).select(F.col("id").alias("period"), F.lit(None).cast("array<long>").alias("start"))
    done = cut(todo.mapInPandas(plans, fields))
    while n > 1:
        before = done.select((F.col("period") + 1).alias("period"), F.col("end").alias("before"))
        wrong = cut(done.select("period", "start").join(before, "period").where("start <> before").select("period", F.col("before").alias("start")))
        if wrong.isEmpty():
            break
        again = wrong.repartition("period").mapInPandas(plans, fields)
        now = cut(done.join(wrong.select("period"), "period", "left_anti").unionByName(again))
        drop_cut(done)
        done = now
    slots = F.posexplode(F.arrays_zip("number", "block", "release", "deadline")).alias("k", "x")
    return done.select("period", slots).select((F.col("period") * length + F.col("k")).alias("slot"), "x.number", "x.block", "x.release", "x.deadline")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 64, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every row with its place in the mix: (id, source, block, slot, release, deadline, position) and the columns named in keep.

    weights: source -> target share, relative and kept exactly, whatever the ratios; by default the square root of a source's rows. Null is a source of its own. Each row is in
    the mix once; a source that has run out leaves its share to the others in proportion to their weights. block: number within the source, of `block_docs` rows;
    position: order of all rows (slot * block size + place in the block, so with gaps after a source's last block). Order within a source is by a hash
    of the id; repeated and null ids are rows like others, in any order among themselves. An empty table gives an empty mix.
    """
    s = F.col(source_col).cast("string")
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    rows = cut(docs.select(F.col(id_col).alias("id"), s.alias("source"), F.xxhash64(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("salt"), *kept))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    names = sorted(counts, key=lambda x: (x is not None, x or ""))
    weight = target_weights(counts, weights)
    spark = docs.sparkSession
    fluid = Fluid([ceil(counts[x] / block_docs) for x in names], [weight[x] for x in names])
    plan = periods(spark, fluid, max(PERIOD, 16 * len(names)))
    plan = F.broadcast(plan) if sum(fluid.n) <= MOST_SENT else plan
    numbers = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "s string, number int")
    numbers = F.broadcast(numbers) if len(names) <= MOST_HOT and sum(len(x or "") for x in names) <= 8 << 20 else numbers

    # The rank of a row in its source, by hash ranges, so that no task sorts a whole source; rows of an id that repeats very often are dealt on.
    parts = max(1, ceil(total / GROUP))
    rows = rows.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("range", F.floor((F.shiftrightunsigned("h", 33) * parts) / (1 << 31)).cast("int"))
    hot = rows.groupBy("number", "range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(4 * GROUP, total // MOST_HOT))
    hot = F.broadcast(hot.select("number", "range", F.ceil(F.col("n") / GROUP).alias("dealt")))  # less than MOST_HOT rows of numbers
    rows = rows.join(hot, ["number", "range"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("salt"), "dealt"), F.lit(0)).cast("int")).drop("dealt")
    key = ["number", "range", "sub"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("upper", F.floor(F.col("range") / RANGES))
    # Rows before a group: of the ranges of its stretch before it, and of all stretches before.
    upper = groups.groupBy("number", "upper").agg(F.sum("n").alias("n"))
    upper = upper.select("number", "upper", (F.sum("n").over(Window.partitionBy("number").orderBy("upper")) - F.col("n")).alias("far"))
    near = (F.sum("n").over(Window.partitionBy("number", "upper").orderBy("range", "sub")) - F.col("n")).alias("near")
    before = groups.select(*key, "upper", near).join(upper, ["number", "upper"]).select(*key, (F.col("near") + F.col("far")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("h", "id", "salt")) - 1
    ranked = rows.withColumn("nth", nth).join(before, key).withColumn("rank", F.col("before") + F.col("nth")).withColumn("block", F.floor(F.col("rank") / block_docs).cast("long"))
    out = ranked.join(plan, ["number", "block"])
    position = (F.col("slot") * block_docs + F.col("rank") % block_docs).alias("position")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", "release", "deadline", position, *[F.col(f"keep_{c}").alias(c) for c in keep])


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", **parameters) -> DataFrame:
    """The input rows, unchanged, in the order of the mix: sorted by position across partitions and within, so files written from it hold it."""
    names = docs.columns
    places = cut(mix(docs, weights, id_col, source_col, **parameters).select(F.col(id_col).alias("loomstat_id"), F.col("position").alias("loomstat_position")))
    n = places.count()
    if places.where("loomstat_id is not null").select("loomstat_id").distinct().count() == n:  # then rows take their places by id, and only once move whole
        placed = docs.join(F.broadcast(places) if n <= MOST_SENT else places, F.col(id_col) == F.col("loomstat_id"))
    else:
        own = {c: f"loomstat_{k}" for k, c in enumerate(names)}
        rows = docs.select(*[F.col(c).alias(own[c]) for c in names], F.col(id_col).alias("id"), F.col(source_col).alias("source"))
        placed = mix(rows, weights, "id", "source", keep=tuple(own.values()), **parameters).withColumnRenamed("position", "loomstat_position")
        placed = placed.select("loomstat_position", *[F.col(own[c]).alias(c) for c in names])
    return placed.orderBy("loomstat_position").select(*names)
