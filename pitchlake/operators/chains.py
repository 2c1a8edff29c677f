"""Greedy thinning by pointer doubling.

A gate takes the first event of a key, then always the first event at least `gap` later than the last one taken. Every
event points to the one that would follow it, an as-of look ahead. From these pointers come pointers over 2, 4, 8, ...
steps, each a join of the last ones with themselves, until no event has one. The events taken are those reached from the
first: going through the pointers from the longest to the shortest, whatever is reached so far reaches its targets as
well. The rounds are the logarithm of the events taken in the longest key, and every join is on (key, time), so a hot key
is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import scan


def following(times: DataFrame, keys: Sequence[str], gap: int, block: int) -> DataFrame:
    """(keys, at, to): for each time the first one at least `gap` later; times without one are left out.

    Walking back in time, the last time seen is the next one; both walk on one axis, in blocks.
    """
    given = times.select(*keys, (-F.col("at")).alias("back"), F.lit(0).alias("asks"), F.col("at").alias("seen"))
    asked = times.select(*keys, (-F.col("at") - gap).alias("back"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("seen"))
    both = scan.prefix_scan(given.unionByName(asked), keys, ["back", "asks"], scan.block_of("back", block), {"to": scan.last_seen("seen")})
    return both.filter("asks = 1 AND to IS NOT NULL").select(*keys, (-F.col("back") - gap).alias("at"), "to")


def taken(times: DataFrame, keys: Sequence[str], gap: int, first: Column | None = None, block: int = 65536 * 64) -> DataFrame:
    """(keys, at): the times that a gate lets through, from distinct (keys, at: long).

    The first time of a key is let through, or the first one for which `first` holds. `gap` is at least 1.
    """
    keys = list(keys)
    held = durable(times.select(*keys, "at"))
    steps, jump = [], durable(following(held, keys, gap, block))
    while not jump.isEmpty():
        steps.append(jump)
        on = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = durable(jump.join(on, [*keys, "to"]).select(*keys, "at", F.col("beyond").alias("to")))
    start = held if first is None else held.filter(first)
    reached = start.groupBy(*keys).agg(F.min("at").alias("at"))
    for step in reversed(steps):
        reached = durable(reached.unionByName(step.join(reached, [*keys, "at"], "left_semi").select(*keys, F.col("to").alias("at"))))
    return reached
