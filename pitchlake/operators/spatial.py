"""Zones and heatmaps. Heatmaps are long tables of cells (match, team, iy, ix, weight).

Points are always reduced to cells before anything else happens, so smoothing, masking and
normalising work on at most a few thousand cells per team, however many points there were.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.columns import c, percent
from . import scan

GROUP = ["match_id", "team"]
CELL = [*GROUP, "iy", "ix"]
NX, NY = 50, 34


def _zone_grid(df: DataFrame, num_zones: int, teams=(0, 1)) -> DataFrame:
    ids = F.explode(F.sequence(F.lit(0), F.lit(num_zones - 1)))
    return (df.select("match_id").distinct()
            .withColumn("team", F.explode(F.array(*[F.lit(t) for t in teams])))
            .withColumn("zone_id", ids))


def zone_time(positions: DataFrame, num_zones: int = 9) -> DataFrame:
    """Rows per team and zone, zero-filled; percent of both teams' total."""
    counted = (positions.filter((F.col("zone_id") >= 0) & F.col("team").isin(0, 1))
               .groupBy("match_id", "team", "zone_id").agg(F.count(F.lit(1)).alias("frames")))
    full = (_zone_grid(positions, num_zones).join(counted, ["match_id", "team", "zone_id"], "left")
            .fillna(0, subset=["frames"]))
    whole = F.sum("frames").over(Window.partitionBy("match_id"))  # two teams times the zones
    return full.withColumn("percent", percent("frames", whole))


def zone_split(zone_frames: DataFrame) -> DataFrame:
    """Per zone, each team's share of it."""
    of = lambda t: F.sum(F.when(F.col("team") == t, F.col("frames")).otherwise(0))
    both = zone_frames.groupBy("match_id", "zone_id").agg(of(0).alias("frames_0"), of(1).alias("frames_1"))
    total = F.col("frames_0") + F.col("frames_1")
    return both.withColumns({"percent_0": percent("frames_0", total), "percent_1": percent("frames_1", total)})


def cell_of(value, size: float, n: int, edge: str = "drop") -> Column:
    """Cell index by truncation. `edge`: drop what falls outside, clamp it, or close the last cell."""
    value = F.when(~F.isnan(c(value)), c(value))
    raw = (value / size * n).cast("int")
    if edge == "clamp":
        return F.greatest(F.lit(0), F.least(raw, F.lit(n - 1)))
    if edge == "closed":
        raw = F.when(value == size, n - 1).otherwise(F.floor(value / size * n).cast("int"))
    return F.when((raw >= 0) & (raw < n), raw)


def heatmap(positions: DataFrame, x="x", y="y", weight=None, nx: int = NX, ny: int = NY,
            edge: str = "drop") -> DataFrame:
    """Count, or sum of `weight`, per cell; rows without coordinates are skipped."""
    ix, iy = cell_of(x, pitch.LENGTH, nx, edge), cell_of(y, pitch.WIDTH, ny, edge)
    cells = positions.select(*GROUP, iy.alias("iy"), ix.alias("ix"),
                             (F.lit(1) if weight is None else c(weight)).alias("w"))
    kept = cells.filter(F.col("iy").isNotNull() & F.col("ix").isNotNull())
    return kept.groupBy(*CELL).agg(F.sum("w").alias("weight"))


def heatmap_batch_mean(positions: DataFrame, x="x", y="y", nx: int = NX, ny: int = NY) -> DataFrame:
    """Mean position per track and batch, counted once in its cell (clamped to the grid)."""
    mean = positions.groupBy(*GROUP, "batch_idx", "track_id").agg(
        F.avg(c(x)).alias("x"), F.avg(c(y)).alias("y"))
    return heatmap(mean, nx=nx, ny=ny, edge="clamp")


def diffuse(cells: DataFrame, nx: int = NX, ny: int = NY) -> DataFrame:
    """Full weight on the own cell, three tenths on each neighbour. Counted in tenths, so integer
    input stays exact."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"),
                                         F.lit(10 if dx == dy == 0 else 3).alias("tenths"))
                                for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    moved = cells.withColumn("s", steps).select(
        *GROUP, (F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"),
        (F.col("weight") * F.col("s.tenths")).alias("t"))
    inside = F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1)
    return moved.filter(inside).groupBy(*CELL).agg((F.sum("t") / 10.0).alias("weight"))


def normalise(cells: DataFrame, how: str | None = "max", frames: DataFrame | None = None) -> DataFrame:
    """Divide by the team's maximum, its sum, or the number of frames of the match; zero stays zero."""
    if how is None:
        return cells
    if how == "frames":
        return (cells.join(frames, "match_id").withColumn(
            "weight", F.when(F.col("num_frames") > 0, F.col("weight") / F.col("num_frames"))
            .otherwise(F.col("weight"))).drop("num_frames"))
    agg = {"max": F.max, "sum": F.sum}[how]("weight").over(Window.partitionBy(*GROUP))  # <= nx * ny rows
    return cells.withColumn("__by", agg).withColumn(
        "weight", F.when(F.col("__by") > 0, F.col("weight") / F.col("__by")).otherwise(F.col("weight"))
    ).drop("__by")


def normalised(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """The three ways of `normalise` side by side as by_max, by_sum and by_frames, from one pass over the cells."""
    team = Window.partitionBy(*GROUP)  # <= nx * ny rows
    share = lambda d: F.when(d > 0, F.col("weight") / d).otherwise(F.col("weight"))
    return cells.withColumns({"__max": F.max("weight").over(team), "__sum": F.sum("weight").over(team)}).join(frames, "match_id").select(
        *CELL, share(F.col("__max")).alias("by_max"), share(F.col("__sum")).alias("by_sum"), share(F.col("num_frames")).alias("by_frames"))


def _kernel(n: int, sigma: float) -> np.ndarray:
    """weight[target, source] of a truncated Gaussian on n cells with reflected edges."""
    radius = int(4.0 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    raw = np.exp(-0.5 * (offsets / sigma) ** 2)
    source = (np.arange(n)[:, None] + offsets) % (2 * n)
    table = np.zeros((n, n))
    np.add.at(table, (np.arange(n)[:, None], np.where(source >= n, 2 * n - 1 - source, source)), raw / raw.sum())
    return table


def gaussian(cells: DataFrame, sigma: float = 2.0, nx: int = 50, ny: int = 50) -> DataFrame:
    """Separable Gaussian smoothing over cells; every cell of a (match, team) comes out.

    A (match, team) is one row with its cells as an array, which the grid bounds. The grids of an Arrow batch are
    stacked, a few million cells at a time, and smoothed by two matrix products. A null weight counts as 0.
    """
    down, along = _kernel(ny, sigma), _kernel(nx, sigma)
    step = max(1, (1 << 21) // (nx * ny))
    grids = cells.groupBy(*GROUP).agg(F.collect_list(F.struct(
        (F.col("iy") * nx + F.col("ix")).cast("int").alias("at"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))).alias("e"))
    kinds = ", ".join(f"{n} {cells.schema[n].dataType.simpleString()}" for n in GROUP)

    def smooth(batches):
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start:start + step]
                flat = np.zeros((len(part), ny * nx))
                for row, at, weight in zip(flat, part["at"], part["w"]):
                    np.add.at(row, at, weight)
                done = down @ flat.reshape(-1, ny, nx) @ along.T
                yield part[GROUP].assign(weight=list(done.reshape(len(part), -1)))

    done = scan.spread_tasks(grids, GROUP).select(*GROUP, "e.at", "e.w").mapInPandas(smooth, f"{kinds}, weight array<double>")
    flat = done.select(*GROUP, F.posexplode("weight").alias("__at", "weight"))
    return flat.withColumns({"iy": F.expr(f"CAST(__at DIV {nx} AS INT)"), "ix": F.col("__at") % nx}).select(*CELL, "weight")


def masked_cells(spark, nx: int = 50, ny: int = 50, goal_margin: float = pitch.GOAL_LINE_MARGIN,
                 side_margin: float = pitch.SIDELINE_MARGIN, radius: float = pitch.POINT_RADIUS) -> DataFrame:
    """Cells that are always blank: goal-line and sideline margins, and a box around each named
    point and its mirror image."""
    gx = max(1, int(goal_margin / pitch.LENGTH * nx))
    gy = int(side_margin / pitch.WIDTH * ny)  # below one cell at 50 rows: no margin there
    rx, ry = (max(1, int(radius / size * n)) for size, n in ((pitch.LENGTH, nx), (pitch.WIDTH, ny)))
    blank = {(iy, ix) for iy in range(ny) for ix in range(nx)
             if ix < gx or ix >= nx - gx or iy < gy or iy >= ny - gy}
    for x, y in pitch.exclusion_points():
        cx, cy = int(x / pitch.LENGTH * nx), int(y / pitch.WIDTH * ny)
        blank |= {(iy, ix) for iy in range(max(0, cy - ry), min(ny, cy + ry + 1))
                  for ix in range(max(0, cx - rx), min(nx, cx + rx + 1))}
    return spark.createDataFrame(sorted(blank), "iy int, ix int")


def mask(cells: DataFrame, nx: int = 50, ny: int = 50) -> DataFrame:
    blank = masked_cells(cells.sparkSession, nx, ny).withColumn("__blank", F.lit(True))
    return (cells.join(F.broadcast(blank), ["iy", "ix"], "left")
            .withColumn("weight", F.when(F.col("__blank"), F.lit(0.0)).otherwise(F.col("weight").cast("double")))
            .select(*CELL, "weight"))


def rendered(positions: DataFrame, sigma: float = 2.0, nx: int = 50, ny: int = 50) -> DataFrame:
    """The heatmap query: valid points -> histogram -> smoothing -> scale to the maximum."""
    from ..functions.columns import heatmap_valid
    good = positions.filter(heatmap_valid("x", "y", pitch.SIDELINE_MARGIN))
    return normalise(gaussian(heatmap(good, nx=nx, ny=ny, edge="closed"), sigma, nx, ny), "max")


def carry_position(owned: DataFrame, patience: int = 30, block_frames: int = 8192) -> DataFrame:
    """Owner rows without a position borrow the team's last one while fewer than `patience` rows in
    a row lack it. Adds `carried`."""
    keys, order, block = GROUP, ["frame", "seq"], scan.block_of("frame", block_frames)
    have = F.when(F.col("x").isNotNull(), F.struct("x", "y", "zone_id"))
    seen = scan.prefix_scan(owned, keys, order, block, {
        "__last": scan.last_seen(have), "__since": scan.since(F.col("x").isNotNull())})
    borrow = F.col("x").isNull() & F.coalesce(F.col("__since") < patience, F.lit(False))
    return seen.withColumns({
        "carried": borrow,
        **{n: F.when(borrow, F.col(f"__last.{n}")).otherwise(F.col(n)) for n in ("x", "y", "zone_id")}
    }).drop("__last", "__since")


def prefer_source(sources: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """Cells of the best source present for each (match, team); lower numbers win."""
    parts = [df.select(*CELL, F.col("weight").cast("double").alias("weight"), F.lit(rank).alias("priority"),
                       F.lit(name).alias("source")) for rank, name, df in sources]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy(*GROUP).agg(F.min("priority").alias("priority"))
    return every.join(best, [*GROUP, "priority"], "left_semi")


def near_shapes(positions: DataFrame, shapes: dict[str, tuple[float, float, float, float]], within: float) -> DataFrame:
    """Positions at most `within` metres from a point, a side-parallel line or a box (x0, y0, x1, y1), one row
    per shape as `shape`. The shapes are constants of the plan, so no join meets them."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box)])
                      for n, box in shapes.items()])
    gap = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))

    def near(s):
        dx, dy = gap(F.col("x"), s["x0"], s["x1"]), gap(F.col("y"), s["y0"], s["y1"])
        return dx * dx + dy * dy <= within * within

    return positions.withColumn("__s", F.explode(F.filter(table, near))).withColumn("shape", F.col("__s.n")).drop("__s")


def union_teams(team_0: DataFrame, team_1: DataFrame) -> DataFrame:
    """Two per-team point lists as one table."""
    return team_0.withColumn("team", F.lit(0)).unionByName(team_1.withColumn("team", F.lit(1)))


def export_totals(points: DataFrame, keypoint_frames: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Per match: points per team, frames with keypoints, whether a calibration exists."""
    of = lambda t: F.sum((F.col("team") == t).cast("long"))
    pts = points.groupBy("match_id").agg(of(0).alias("points_0"), of(1).alias("points_1"))
    kps = keypoint_frames.groupBy("match_id").agg(F.countDistinct("frame").alias("keypoint_frames"))
    cal = calibrated.groupBy("match_id").agg(F.max(F.col("ok")).alias("calibrated"))
    return (pts.join(kps, "match_id", "left").join(cal, "match_id", "left")
            .fillna(0, subset=["keypoint_frames"]).fillna(False, subset=["calibrated"]))
