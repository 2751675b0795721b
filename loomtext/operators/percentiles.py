"""Exact percentiles of real numbers by refined ranges: count, narrow, repeat. No value list is ever gathered.

Each wanted rank lies in a range of its group. A pass counts the values in ``parts`` parts of every open range, with
each part's smallest and largest value, which are the range of the next pass; a rank is found when both are one
value. A part's ends are values of its own, so every pass parts them at least. What comes to the driver is bounded by
groups x ranks x parts, whatever the number of values. Values are stored once, and each pass stores those that lie in
the parts of a wanted rank: few after the first pass, which has FIRST_PARTS parts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep

PARTS = 256
#: Parts of the first pass, over all groups.
FIRST_PARTS = 1 << 14


def _ranks(n: int, shares: list[float]) -> dict[float, tuple[int, int, float]]:
    """The ranks (from 0) on either side of each share's place, and how far it lies between them."""
    out = {}
    for p in shares:
        place = (n - 1) * p
        low = math.floor(place)
        out[p] = (low, min(n - 1, math.ceil(place)), place - low)
    return out


def exact_percentiles(rows: DataFrame, value: str, shares: list[float], by: str | None = None, parts: int = PARTS) -> dict[object, list[float]]:
    """By group (None without ``by``, and the name of a null group), the percentiles at ``shares``, linear between ranks.

    Nulls and NaN are left out; a group without values has no entry. Groups are a report's rows, so few."""
    group = F.col(by) if by else F.lit(None).cast("string")
    values = rows.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    values = keep(values, "values")
    ends = {r.g: r for r in values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    wanted = {g: _ranks(r.n, shares) for g, r in ends.items()}
    found: dict[tuple, float] = {}  # (group, rank) -> value
    # Open ranges: group, first and last value, values below, the ranks inside.
    todo = [(g, r.low, r.high, 0, sorted({k for low, high, _ in wanted[g].values() for k in (low, high)})) for g, r in ends.items()]
    given, parts = parts, max(parts, FIRST_PARTS // max(1, len(ends)))
    while True:
        still = []
        for g, low, high, below, ranks in todo:
            if low == high:
                found |= {(g, k): low for k in ranks}
            else:
                still.append((g, low, high, below, ranks))
        if not still:
            break
        kind = f"g {values.schema['g'].dataType.simpleString()}, at int, low double, high double"
        open_ranges = values.sparkSession.createDataFrame([(g, i, low, high) for i, (g, low, high, *_) in enumerate(still)], kind)
        listed = open_ranges.groupBy("g").agg(F.collect_list(F.struct("at", "low", "high")).alias("ranges"))  # groups x ranks
        met = values.join(F.broadcast(listed), values["g"].eqNullSafe(listed["g"])).select(
            values["g"], "v", F.try_element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("v")) & (F.col("v") <= r["high"])), F.lit(1)).alias("r")
        )
        # Halves, so that the width of a range can't overflow.
        share = (F.col("v") / 2 - F.col("r.low") / 2) / (F.col("r.high") / 2 - F.col("r.low") / 2)
        part = F.least(F.lit(parts - 1), F.floor(share * parts).cast("int"))
        met = met.select("g", "v", "r", part.alias("part")).where("r is not null")
        cells = met.groupBy(F.col("r.at").alias("at"), "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        told: dict[int, list] = {}
        for c in cells.collect():  # ranges x parts at most
            told.setdefault(c["at"], []).append(c)
        todo, open_parts = [], []
        for i, (g, _, _, below, ranks) in enumerate(still):
            for c in sorted(told[i], key=lambda c: c["part"]):
                inside = [k for k in ranks if below <= k < below + c["n"]]
                if inside:
                    todo.append((g, c["low"], c["high"], below, inside))
                    if c["low"] != c["high"]:
                        open_parts.append(i * parts + c["part"])
                below += c["n"]
        if open_parts:
            values = keep(met.where((F.col("r.at").cast("long") * parts + F.col("part")).isin(open_parts)).select("g", "v"), "values")
        parts = given
    between = lambda a, b, f: a if a == b else a * (1 - f) + b * f
    return {g: [between(found[g, low], found[g, high], f) for low, high, f in (of[p] for p in shares)] for g, of in wanted.items()}
