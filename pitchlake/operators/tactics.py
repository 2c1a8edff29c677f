"""Zone focus, passing chains and the insight table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import pattern_label, percent, style_summary
from . import scan

TEAM = ["match_id", "team"]
ORDER = ["frame", "seq"]


def _label(names: tuple[str, ...] | None, zone):
    if names is None:
        return F.concat(F.lit("Zone_"), zone.cast("string"))
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), zone), F.concat(F.lit("Zone_"), zone.cast("string")))


def zone_focus(zone_frames: DataFrame, keys=tuple(TEAM), names: tuple[str, ...] | None = None,
               share: float = 0.60) -> DataFrame:
    """Zones by share (ties by id) until they reach `share`, their concentration and pattern, and the
    percent of every zone. A group holds one row per zone, so it fits an array."""
    keys = list(keys)
    groups = zone_frames.groupBy(*keys).agg(
        F.sum("frames").alias("__total"),
        F.sort_array(F.collect_list(F.struct((-F.col("frames")).alias("f"), F.col("zone_id").cast("int").alias("z")))).alias("__s"))
    groups = groups.filter("__total > 0")
    upto = F.expr("transform(__s, (e, i) -> aggregate(slice(__s, 1, i), 0L, (acc, q) -> acc - q.f))")
    groups = groups.withColumn("__before", upto)
    top = F.expr(f"filter(__s, (e, i) -> __before[i] / __total < {share}D)")
    groups = groups.withColumn("__top", top).withColumn(
        "__held", F.expr("aggregate(__top, 0L, (acc, q) -> acc - q.f)"))
    ids = F.transform("__top", lambda e: e["z"])
    detail = F.transform(F.array_sort(F.transform("__s", lambda e: F.struct(
        e["z"].alias("zone_id"), (-e["f"] * 100.0 / F.col("__total")).alias("percent")))), lambda e: e)
    return (groups.withColumn("concentration", F.col("__held") / F.col("__total"))
            .withColumn("zone_ids", ids)
            .withColumn("dominant_zones", F.transform("zone_ids", lambda z: _label(names, z)))
            .withColumn("pattern", pattern_label(F.size("zone_ids"), "concentration"))
            .withColumn("zone_details", detail)
            .drop("__total", "__s", "__before", "__top", "__held"))


def zone_shift(focus: DataFrame, order: str = "frame", block: int = 8192) -> DataFrame:
    """Zones that joined or left the dominant set since the previous measurement of the team.
    New and lost zones are sorted; the first measurement has nothing to compare with."""
    prev = scan.prefix_scan(focus, TEAM, [order], scan.block_of(order, block),
                            {"__was": scan.previous("dominant_zones")})
    out = prev.filter(F.col("__was").isNotNull()).withColumns({
        "new_zones": F.sort_array(F.array_except("dominant_zones", "__was")),
        "lost_zones": F.sort_array(F.array_except("__was", "dominant_zones"))})
    return out.withColumn("shifted", (F.size("new_zones") > 0) | (F.size("lost_zones") > 0)).drop("__was")


def shift_text(new="new_zones", lost="lost_zones"):
    return F.concat_ws(" and ",
                       F.when(F.size(new) > 0, F.concat(F.lit("more in "), F.array_join(new, ", "))),
                       F.when(F.size(lost) > 0, F.concat(F.lit("less in "), F.array_join(lost, ", "))))


def cumulative_zones(positions: DataFrame, batches: DataFrame, size: int, num_zones: int = 9) -> DataFrame:
    """Rows per team and zone up to the end of each micro-batch. `positions`: match_id, batch_idx,
    team, zone_id. Counting precedes the grid of batches x teams x zones."""
    on = ["match_id", "batch_idx", "team", "zone_id"]
    counts = (positions.filter((F.col("zone_id") >= 0) & F.col("team").isin(0, 1))
              .groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    grid = (batches.select("match_id", "batch_idx").distinct()
            .withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("zone_id", F.explode(F.sequence(F.lit(0), F.lit(num_zones - 1)))))
    steps = grid.join(counts, on, "left").fillna(0, subset=["n"])
    out = scan.prefix_scan(steps, ["match_id", "team", "zone_id"], ["batch_idx"],
                           scan.block_of("batch_idx", 65536), {"frames": scan.total("n")})
    return out.select(*on, "frames", ((F.col("batch_idx") + 1) * F.lit(size)).alias("frame"))


# ---- passing chains --------------------------------------------------------------------------

def numbered_passes(events: DataFrame, block_frames: int = 8192) -> DataFrame:
    """Passes with their chain number: how many times the team had lost the ball before."""
    own = events.filter(F.col("type").isin("pass", "possession_loss") & F.col("team").isin(0, 1))
    lost = (F.col("type") == "possession_loss").cast("long")
    out = scan.prefix_scan(own, TEAM, ORDER, scan.block_of("frame", block_frames), {"chain": scan.total(lost)})
    return out.filter("type = 'pass'")


def passing_chains(events: DataFrame, min_length: int = 3, fps: float = 30.0,
                   block_frames: int = 8192) -> DataFrame:
    """A team's passes between two of its losses, opponents' passes notwithstanding: length, times,
    zones in first-seen order, and the frame of the loss that closed it (null while open).

    Zones are reduced to one row per chain and zone before they are listed, so no list grows with
    the number of passes.
    """
    chained = [*TEAM, "chain"]
    made = numbered_passes(events, block_frames).withColumn("zone", F.coalesce("zone", F.lit("unknown")))
    per_zone = made.groupBy(*chained, "zone").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"),
        F.min(F.struct(*ORDER)).alias("first"))
    chains = per_zone.groupBy(*chained).agg(
        F.sum("n").alias("length"), F.min("f0").alias("start_frame"), F.max("f1").alias("end_frame"),
        F.transform(F.sort_array(F.collect_list(F.struct("first", "zone"))), lambda e: e["zone"]).alias("zones"))
    losses = events.filter((F.col("type") == "possession_loss") & F.col("team").isin(0, 1)).select(*TEAM, *ORDER)
    ends = scan.with_position(losses, TEAM, ORDER, scan.block_of("frame", block_frames)).select(
        *TEAM, (F.col("__pos") - 1).alias("chain"), F.col("frame").alias("closed_frame"))
    out = chains.filter(F.col("length") >= min_length).join(ends, chained, "left")
    return out.withColumns({
        "start_time": F.col("start_frame") / F.lit(fps), "end_time": F.col("end_frame") / F.lit(fps),
        "duration": (F.col("end_frame") - F.col("start_frame")) / F.lit(fps)})


def active_chain(chains: DataFrame) -> DataFrame:
    """The open chain of each team, if it is long enough to count."""
    return chains.filter(F.col("closed_frame").isNull())


def chain_stats(chains: DataFrame, last: int = 5) -> DataFrame:
    """Completed chains per team: number, average and longest length, average duration, and the
    lengths of the last ones, oldest first."""
    done = chains.filter(F.col("closed_frame").isNotNull())
    w = Window.partitionBy(*TEAM).orderBy(F.col("chain").desc())
    recent = (done.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= last)
              .groupBy(*TEAM).agg(F.transform(F.sort_array(F.collect_list(F.struct("chain", "length"))),
                                              lambda e: e["length"]).alias("last_lengths")))
    stats = done.groupBy(*TEAM).agg(
        F.count(F.lit(1)).alias("total_chains"), F.avg("length").alias("avg_length"),
        F.max("length").alias("max_length"), F.avg("duration").alias("avg_duration"))
    return stats.join(recent, TEAM)


def notable_chains(chains: DataFrame, min_length: int = 5, top: int = 3) -> DataFrame:
    """Longest completed chains; equal lengths in order of time."""
    done = chains.filter(F.col("closed_frame").isNotNull() & (F.col("length") >= min_length))
    w = Window.partitionBy(*TEAM).orderBy(F.col("length").desc(), "chain")
    return done.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_zones(zone_frames: DataFrame, top: int = 3, of_match: bool = False) -> DataFrame:
    """Top zones of each team with any time in them; share of the team's own total, or of both."""
    whole = F.sum("frames").over(Window.partitionBy("match_id") if of_match else Window.partitionBy(*TEAM))
    w = Window.partitionBy(*TEAM).orderBy(F.col("frames").desc(), "zone_id")
    ranked = zone_frames.withColumns({"percent": percent("frames", whole), "rank": F.row_number().over(w)})
    return ranked.filter((F.col("rank") <= top) & (F.col("frames") > 0))


def insights(focus: DataFrame, chains: DataFrame, share: DataFrame, notable_length: int = 4) -> DataFrame:
    """One row per match and team: zone focus, open chain, best chains, chain statistics, style.
    `share` has match_id, team, percent."""
    best = notable_chains(chains, notable_length, top=3).groupBy(*TEAM).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "length"))), lambda e: e["length"]).alias("notable_lengths"))
    good = chains.filter(F.col("closed_frame").isNotNull() & (F.col("length") >= notable_length))
    avg = good.groupBy(*TEAM).agg(F.avg("length").alias("notable_avg"))
    is_open = active_chain(chains).groupBy(*TEAM).agg(F.max("length").alias("active_length"))
    out = share.select(*TEAM, "percent")
    for part in (focus.select(*TEAM, "dominant_zones", "concentration", "pattern"), is_open, best,
                 chain_stats(chains), avg):
        out = out.join(part, TEAM, "left")
    zones = F.coalesce("dominant_zones", F.array().cast("array<string>"))
    return out.withColumn("style", style_summary(zones, "notable_avg", "percent")).drop("notable_avg")
