"""Ordered windows that stay parallel inside one hot key.

A plain `Window.partitionBy(match).orderBy(frame)` sorts a whole match in one task. If one match
holds a third of the rows, that task is the job. The functions here cut every key into blocks of
consecutive rows, run ordinary window functions inside `(key, block)`, and carry a one-row summary
per block across blocks. The only window over the bare key is over those summaries, which are
smaller than the data by the block size.

* `prefix_scan`   running sums, last/first non-null, previous row, rows since a mark or a change: anything with
                  an associative merge
* `with_position` row number inside a key
* `halo_rows`     fixed look-back windows (`ROWS n PRECEDING`): the last n rows of a block are copied
                  into the next one
* `halo_range`    the same for `RANGE n PRECEDING` on a numeric order column

`block` is a Column that never decreases along `order` (such as `frame div 8192`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK = "__block"
HALO = "__halo"
PLACE, BEFORE = "__place", "__before"  # row number inside a block, rows of the key before the block
COUNTED = ("since", "run")


@dataclass(frozen=True)
class Running:
    """One running aggregate; `before` leaves the current row out."""

    kind: str
    value: Column
    before: bool = False


def total(value, before: bool = False) -> Running:
    return Running("sum", _col(value), before)


def last_seen(value, before: bool = False) -> Running:
    """Last non-null value so far."""
    return Running("last", _col(value), before)


def first_seen(value) -> Running:
    """First non-null value so far."""
    return Running("first", _col(value))


def previous(value) -> Running:
    """Value of the previous row, null included."""
    return Running("prev", _col(value), True)


def highest(value, before: bool = False) -> Running:
    return Running("max", _col(value), before)


def lowest(value, before: bool = False) -> Running:
    return Running("min", _col(value), before)


def since(condition) -> Running:
    """Rows since the condition last held: 0 on such a row, null before the first."""
    return Running("since", _col(condition))


def run_length(value) -> Running:
    """Rows since the value last changed (nulls equal each other): 0 on the row of the change and on the first."""
    return Running("run", _col(value))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def block_of(column: str, size: int) -> Column:
    return F.floor(F.col(column) / F.lit(size)).cast("long")


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence, block: Column,
                outputs: dict[str, Running]) -> DataFrame:
    """Add running aggregates per key in the given order."""
    order = [_col(o) for o in order]
    blocked = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*keys).orderBy(BLOCK)
    across = chain.rowsBetween(Window.unboundedPreceding, -1)

    counted = any(agg.kind in COUNTED for agg in outputs.values())
    if counted:  # places inside a block, and marks on them; the first row of a block learns from the carry whether it is one
        blocked = blocked.withColumn(PLACE, F.row_number().over(inside))
        blocked = blocked.withColumns({f"__m{i}": F.when(agg.value if agg.kind == "since" else (F.col(PLACE) > 1) & ~F.struct(
            F.lag(agg.value).over(inside).alias("v")).eqNullSafe(F.struct(agg.value.alias("v"))), F.col(PLACE)) for i, agg in enumerate(outputs.values()) if agg.kind in COUNTED})

    local, partial, carry = {}, [], []
    for i, agg in enumerate(outputs.values()):
        frame = prior if agg.before else upto
        value = F.struct(agg.value.alias("v")) if agg.kind == "prev" else agg.value
        part, held = f"__p{i}", F.col(f"__p{i}")
        if agg.kind == "sum":
            local[f"__l{i}"] = F.sum(value).over(frame)
            partial.append(F.sum(value).alias(part))
            carry.append(F.sum(held).over(across).alias(f"__c{i}"))
        elif agg.kind in ("max", "min"):
            fn = F.max if agg.kind == "max" else F.min
            local[f"__l{i}"] = fn(value).over(frame)
            partial.append(fn(value).alias(part))
            carry.append(fn(held).over(across).alias(f"__c{i}"))
        elif agg.kind in COUNTED:
            local[f"__l{i}"] = F.col(PLACE) - F.max(f"__m{i}").over(upto)
            partial.append(F.max(f"__m{i}").alias(part))
            known = F.col(BEFORE) + held
            if agg.kind == "run":
                state = F.struct(agg.value.alias("v"))
                partial += [F.min_by(state, PLACE).alias(f"__first{i}"), F.max_by(state, PLACE).alias(f"__last{i}")]
                known = F.coalesce(known, F.when(F.col(f"__new{i}"), F.col(BEFORE) + 1))
                carry.append(F.col(f"__new{i}"))
            carry.append((F.col(BEFORE) - F.last(known, ignorenulls=True).over(across)).alias(f"__c{i}"))
        elif agg.kind == "first":
            local[f"__l{i}"] = F.first(value, ignorenulls=True).over(frame)
            partial.append(_pick(F.min_by, value, order).alias(part))
            carry.append(F.first(held, ignorenulls=True).over(across).alias(f"__c{i}"))
        else:
            local[f"__l{i}"] = F.last(value, ignorenulls=True).over(frame)
            partial.append(_pick(F.max_by, value, order).alias(part))
            carry.append(F.last(held, ignorenulls=True).over(across).alias(f"__c{i}"))

    rows = blocked.withColumns(local)
    # partial aggregation runs before this shuffle: one row per (key, block) and map task
    summary = blocked.groupBy(*keys, BLOCK).agg(*partial, *([F.max(PLACE).cast("long").alias("__size")] if counted else []))
    if counted:
        summary = summary.withColumns({BEFORE: F.coalesce(F.sum("__size").over(across), F.lit(0)), **{
            f"__new{i}": ~F.lag(f"__last{i}").over(chain).eqNullSafe(F.col(f"__first{i}")) for i, agg in enumerate(outputs.values()) if agg.kind == "run"}})
    carried = summary.select(*keys, BLOCK, *carry)
    joined = rows.join(carried, [*keys, BLOCK])

    merged = []
    for i, (name, agg) in enumerate(outputs.items()):
        here, there = F.col(f"__l{i}"), F.col(f"__c{i}")
        if agg.kind == "sum":
            out = F.coalesce(here + there, here, there)
            if agg.before:
                out = F.coalesce(out, F.lit(0))
        elif agg.kind == "max":
            out = F.greatest(here, there)
        elif agg.kind == "min":
            out = F.least(here, there)
        elif agg.kind == "since":
            out = F.coalesce(here, there + F.col(PLACE))
        elif agg.kind == "run":
            out = F.coalesce(here, F.when(F.col(f"__new{i}"), F.col(PLACE).cast("long") - 1), there + F.col(PLACE))
        elif agg.kind == "first":
            out = F.coalesce(there, here)
        else:
            out = F.coalesce(here, there)
            if agg.kind == "prev":
                out = out.getField("v")
        merged.append(out.alias(name))
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*kept, *merged)


def _pick(fn, value: Column, order: list[Column]) -> Column:
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return fn(value, F.when(value.isNotNull(), rank))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence, block: Column,
                  name: str = "__pos") -> DataFrame:
    """1-based row number inside each key."""
    return prefix_scan(df, keys, order, block, {name: total(F.lit(1).cast("long"))})


def halo_rows(df: DataFrame, keys: Sequence[str], pos: str, lookback: int,
              size: int = 65536) -> tuple[DataFrame, WindowSpec]:
    """Rows cut by position, each block preceded by the last `lookback` rows of the one before.

    Returns the frame and an ordered window; apply window functions, then `drop_halo`.
    """
    return halo_range(df, keys, pos, lookback, max(size, lookback + 1))


def halo_range(df: DataFrame, keys: Sequence[str], column: str, lookback: int,
               size: int = 65536) -> tuple[DataFrame, WindowSpec]:
    size = max(size, lookback + 1)
    own = block_of(column, size)
    reach = F.pmod(F.col(column), F.lit(size)) >= F.lit(size - lookback)
    copies = F.explode(F.when(reach, F.array(own, own + 1)).otherwise(F.array(own)))
    spread = df.withColumn("__own", own).withColumn(BLOCK, copies)
    spread = spread.withColumn(HALO, F.col(BLOCK) != F.col("__own")).drop("__own")
    return spread, Window.partitionBy(*keys, BLOCK).orderBy(column)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, BLOCK)


def spread_tasks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by the keys a Python step groups by, into a fixed number of tasks. Such steps
    cost far more than the few bytes of their input, by which adaptive execution would merge them."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def join_one_per_key(rows: DataFrame, one: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                     salts: int = 32) -> DataFrame:
    """Inner join with a table of one row per key, where an aggregation by the same key follows.

    Adaptive execution does not split a skewed join whose output must stay partitioned by the join
    key, so the hot key is spread here: rows are salted, the small side is repeated per salt.
    """
    salted = rows.withColumn("__salt", F.pmod(F.hash(*spread_by), F.lit(salts)))
    repeated = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"]).drop("__salt")
