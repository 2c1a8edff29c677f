"""Zones and heatmaps (A6-A15, A32, E13, S12, SO3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch
from ..functions.columns import rounded as R
from ..functions.columns import zone_of
from ..operators import spatial as sp
from .registry import query
from .views import CTES

_LANE = """CASE WHEN Y - 34 < -68.0::DOUBLE / 6 THEN 0 WHEN Y - 34 < 68.0::DOUBLE / 6 THEN 1 ELSE 2 END"""
_AL = "CASE WHEN team_id = 0 THEN X - 52.5::DOUBLE ELSE 52.5::DOUBLE - X END"
CTES.update({
    "placed": f"""SELECT match_id, frame, seq, track_id, team_id AS team, X AS px, Y AS py, conf,
        CASE WHEN {_AL} < -17.5 THEN 0 WHEN {_AL} < 17.5 THEN 1 ELSE 2 END * 3 + {_LANE} AS zone_id FROM players""",
    "ztime": """SELECT m.match_id, t.team, z.zone_id, coalesce(n, 0) AS frames
        FROM (SELECT DISTINCT match_id FROM placed) m CROSS JOIN (VALUES (0), (1)) t(team)
        CROSS JOIN (SELECT unnest(range(9)) AS zone_id) z
        LEFT JOIN (SELECT match_id, team, zone_id, count(*) AS n FROM placed GROUP BY 1, 2, 3) c
          ON c.match_id = m.match_id AND c.team = t.team AND c.zone_id = z.zone_id""",
    "cells": """SELECT match_id, team, CAST(trunc(py / 68 * 34) AS INT) AS iy, CAST(trunc(px / 105 * 50) AS INT) AS ix, count(*) AS weight
        FROM placed WHERE px < 105 GROUP BY ALL""",
    "hist": """SELECT match_id, team, CAST(least(floor(py / 68 * 50), 49) AS INT) AS iy, CAST(least(floor(px / 105 * 50), 49) AS INT) AS ix, count(*) AS weight
        FROM placed GROUP BY ALL""",
})


def placed(v):
    return v.players.select("match_id", "frame", "seq", "track_id", F.col("team_id").alias("team"),
                            F.col("X").alias("x"), F.col("Y").alias("y"), "conf",
                            zone_of("X", "Y", "team_id").alias("zone_id"))


@query("A6_zone_time", """SELECT match_id, team, zone_id, frames,
    round(frames * 100.0::DOUBLE / sum(frames) OVER (PARTITION BY match_id), 6) AS percent FROM ztime""")
def _(v):
    return sp.zone_time(placed(v)).withColumn("percent", R("percent"))


@query("A7_zone_split", """WITH s AS (SELECT match_id, zone_id, CAST(sum(frames) FILTER (team = 0) AS BIGINT) AS frames_0,
      CAST(sum(frames) FILTER (team = 1) AS BIGINT) AS frames_1 FROM ztime GROUP BY 1, 2)
    SELECT *, round(CASE WHEN frames_0 + frames_1 > 0 THEN frames_0 * 100.0::DOUBLE / (frames_0 + frames_1) ELSE 0 END, 6) AS percent_0,
      round(CASE WHEN frames_0 + frames_1 > 0 THEN frames_1 * 100.0::DOUBLE / (frames_0 + frames_1) ELSE 0 END, 6) AS percent_1 FROM s""")
def _(v):
    out = sp.zone_split(sp.zone_time(placed(v)))
    return out.withColumns({"percent_0": R("percent_0"), "percent_1": R("percent_1")})


@query("A8_heatmap_counts", "SELECT match_id, team, iy, ix, weight FROM cells")
def _(v):
    return sp.heatmap(placed(v))


@query("A8_heatmap_counts_lineitem", """WITH p AS (SELECT l_suppkey % 20 AS match_id, l_partkey % 2 AS team, l_quantity::DOUBLE * 2.1 AS x,
      l_extendedprice::DOUBLE - 68.0::DOUBLE * floor(l_extendedprice::DOUBLE / 68.0::DOUBLE) AS y FROM lineitem)
    SELECT match_id, team, CAST(trunc(y / 68 * 34) AS INT) AS iy, CAST(trunc(x / 105 * 50) AS INT) AS ix, count(*) AS weight FROM p
    WHERE trunc(x / 105 * 50) < 50 AND trunc(y / 68 * 34) < 34 GROUP BY ALL""")
def _(v):
    price = F.col("l_extendedprice").cast("double")
    pts = v.table("lineitem").select(
        (F.col("l_suppkey") % 20).alias("match_id"), (F.col("l_partkey") % 2).alias("team"),
        (F.col("l_quantity").cast("double") * 2.1).alias("x"), (price - 68.0 * F.floor(price / 68.0)).alias("y"))
    return sp.heatmap(pts)


@query("A9_heatmap_weighted", """SELECT match_id, team, CAST(trunc(py / 68 * 34) AS INT) AS iy, CAST(trunc(px / 105 * 50) AS INT) AS ix,
    round(sum(conf), 6) AS weight FROM placed WHERE px < 105 AND conf > 0.05 GROUP BY ALL""")
def _(v):
    x = F.when(F.col("conf") > 0.05, F.col("x")).otherwise(F.lit(float("nan")))
    return sp.heatmap(placed(v).withColumn("x", x), weight="conf").withColumn("weight", R("weight"))


@query("A10_heatmap_batch_mean", """WITH m AS (SELECT match_id, team, frame // 6 AS b, track_id, avg(px) AS x, avg(py) AS y FROM placed GROUP BY ALL)
    SELECT match_id, team, greatest(0, least(33, CAST(trunc(y / 68 * 34) AS INT))) AS iy,
      greatest(0, least(49, CAST(trunc(x / 105 * 50) AS INT))) AS ix, count(*) AS weight FROM m GROUP BY ALL""")
def _(v):
    return sp.heatmap_batch_mean(placed(v).withColumn("batch_idx", F.expr("frame div 6")))


@query("A11_heatmap_diffuse", """WITH o AS (SELECT a AS dy, b AS dx, CASE WHEN a = 0 AND b = 0 THEN 10 ELSE 3 END AS tenths
      FROM (VALUES (-1), (0), (1)) p(a) CROSS JOIN (VALUES (-1), (0), (1)) q(b))
    SELECT match_id, team, iy + dy AS iy, ix + dx AS ix, round(sum(weight * tenths) / 10, 6) AS weight FROM cells CROSS JOIN o
    WHERE iy + dy BETWEEN 0 AND 33 AND ix + dx BETWEEN 0 AND 49 GROUP BY 1, 2, 3, 4""")
def _(v):
    return sp.diffuse(sp.heatmap(placed(v))).withColumn("weight", R("weight"))


@query("A12_heatmap_normalise", """WITH f AS (SELECT match_id, count(DISTINCT frame) AS nf FROM placed GROUP BY 1)
    SELECT match_id, team, iy, ix, round(weight / max(weight) OVER (PARTITION BY match_id, team), 6) AS by_max,
      round(weight / sum(weight) OVER (PARTITION BY match_id, team), 6) AS by_sum, round(weight / nf, 6) AS by_frames
    FROM cells JOIN f USING (match_id)""")
def _(v):
    return sp.normalised(sp.heatmap(placed(v)), placed(v).groupBy("match_id").agg(F.countDistinct("frame").alias("num_frames"))).select(
        *sp.CELL, *[R(n).alias(n) for n in ("by_max", "by_sum", "by_frames")])


@query("A13_histogram2d", "SELECT match_id, team, iy, ix, weight FROM hist")
def _(v):
    return sp.heatmap(placed(v), nx=50, ny=50, edge="closed")


_SMOOTH = """k AS (SELECT d, exp(-0.5::DOUBLE * (d / {s}::DOUBLE) * (d / {s}::DOUBLE)) AS w FROM (SELECT unnest(range(-{r}, {r} + 1)) AS d)),
    kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
    kt AS (SELECT t, CASE WHEN (t + d + 100) % 100 >= 50 THEN 99 - (t + d + 100) % 100 ELSE (t + d + 100) % 100 END AS s, sum(w) AS w
           FROM kn CROSS JOIN (SELECT unnest(range(50)) AS t) GROUP BY 1, 2),
    s1 AS (SELECT match_id, team, kt.t AS iy, ix, sum(weight * w) AS weight FROM {src} JOIN kt ON kt.s = iy GROUP BY 1, 2, 3, 4),
    s2 AS (SELECT match_id, team, iy, kt.t AS ix, sum(weight * w) AS weight FROM s1 JOIN kt ON kt.s = ix GROUP BY 1, 2, 3, 4),
    sd AS (SELECT g.match_id, g.team, y.iy, x.ix, coalesce(s2.weight, 0) AS weight FROM (SELECT DISTINCT match_id, team FROM {src}) g
      CROSS JOIN (SELECT unnest(range(50)) AS iy) y CROSS JOIN (SELECT unnest(range(50)) AS ix) x
      LEFT JOIN s2 ON s2.match_id = g.match_id AND s2.team = g.team AND s2.iy = y.iy AND s2.ix = x.ix)"""


@query("A14_gaussian_smooth", f"""WITH {_SMOOTH.format(s='2.5', r=10, src='hist')}
    SELECT match_id, team, iy, ix, round(weight, 6) AS weight FROM sd""")
def _(v):
    base = sp.heatmap(placed(v), nx=50, ny=50, edge="closed")
    return sp.gaussian(base, 2.5).withColumn("weight", R("weight"))


_BLANK = """SELECT DISTINCT iy, ix FROM (SELECT unnest(range(50)) AS iy) CROSS JOIN (SELECT unnest(range(50)) AS ix)
    WHERE ix < 1 OR ix >= 49 OR EXISTS (SELECT 1 FROM excl WHERE
      abs(ix - floor(ex / 105 * 50)) <= 1 AND abs(iy - floor(ey / 68 * 50)) <= 1)"""


@query("A15_heatmap_mask", f"""SELECT h.match_id, h.team, h.iy, h.ix, CASE WHEN b.iy IS NOT NULL THEN 0 ELSE weight END AS weight
    FROM hist h LEFT JOIN ({_BLANK}) b ON b.iy = h.iy AND b.ix = h.ix""")
def _(v):
    return sp.mask(sp.heatmap(placed(v), nx=50, ny=50, edge="closed"))


@query("heatmap_rendered", f"""WITH good AS (SELECT match_id, team, CAST(least(floor(py / 68 * 50), 49) AS INT) AS iy, CAST(least(floor(px / 105 * 50), 49) AS INT) AS ix,
      count(*) AS weight FROM placed WHERE px > 2 AND px < 103 AND py > 0.4 AND py < 67.6::DOUBLE
      AND NOT EXISTS (SELECT 1 FROM excl WHERE sqrt((px - ex) * (px - ex) + (py - ey) * (py - ey)) <= 1.2) GROUP BY ALL),
    {_SMOOTH.format(s='2', r=8, src='good')}
    SELECT match_id, team, iy, ix, round(weight / max(weight) OVER (PARTITION BY match_id, team), 6) AS weight FROM sd""")
def _(v):
    return sp.rendered(placed(v)).withColumn("weight", R("weight"))


@query("E13_position_carry", """WITH o AS (SELECT match_id, team, frame, seq, CASE WHEN seq % 4 = 0 THEN px END AS x, CASE WHEN seq % 4 = 0 THEN py END AS y,
      CASE WHEN seq % 4 = 0 THEN zone_id END AS zone_id, row_number() OVER (PARTITION BY match_id, team ORDER BY frame, seq) AS rn FROM placed),
    l AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS lr, last_value(x IGNORE NULLS) OVER w AS lx,
      last_value(y IGNORE NULLS) OVER w AS ly, last_value(zone_id IGNORE NULLS) OVER w AS lz FROM o
      WINDOW w AS (PARTITION BY match_id, team ORDER BY frame, seq ROWS UNBOUNDED PRECEDING))
    SELECT match_id, team, seq, coalesce(x IS NULL AND rn - lr < 3, false) AS carried,
      round(CASE WHEN rn - lr < 3 THEN lx END, 6) AS x, round(CASE WHEN rn - lr < 3 THEN ly END, 6) AS y,
      CASE WHEN rn - lr < 3 THEN lz END AS zone_id FROM l""")
def _(v):
    has = F.col("seq") % 4 == 0
    owned = placed(v).withColumns({n: F.when(has, F.col(n)) for n in ("x", "y", "zone_id")})
    out = sp.carry_position(owned, patience=3, block_frames=16)
    return out.select("match_id", "team", "seq", "carried", R("x").alias("x"), R("y").alias("y"), "zone_id")


@query("S12_source_preference", """WITH a AS (SELECT match_id, team, iy, ix, weight::DOUBLE AS weight, 1 AS priority, 'points' AS source FROM cells WHERE match_id % 3 = 0
      UNION ALL SELECT match_id, team, iy, ix, weight * 2.0, 2, 'flip' FROM cells WHERE match_id % 3 < 2
      UNION ALL SELECT match_id, team, iy, ix, weight * 3.0, 3, 'classic' FROM cells)
    SELECT match_id, team, iy, ix, weight, priority, source FROM a
    QUALIFY dense_rank() OVER (PARTITION BY match_id, team ORDER BY priority) = 1""")
def _(v):
    cells = sp.heatmap(placed(v))
    return sp.prefer_source([
        (1, "points", cells.filter("match_id % 3 = 0")),
        (2, "flip", cells.filter("match_id % 3 < 2").withColumn("weight", F.col("weight") * 2.0)),
        (3, "classic", cells.withColumn("weight", F.col("weight") * 3.0))])


@query("SO3_team_union", "SELECT seq, team, round(px, 6) AS x, round(py, 6) AS y FROM placed")
def _(v):
    p = placed(v)
    out = sp.union_teams(*[p.filter(F.col("team") == t).select("seq", "x", "y") for t in (0, 1)])
    return out.select("seq", "team", R("x").alias("x"), R("y").alias("y"))


@query("A32_export_summary", """WITH k AS (SELECT match_id, count(DISTINCT frame) AS keypoint_frames FROM kp GROUP BY 1),
    c AS (SELECT match_id, max(n) >= 8 AS calibrated FROM (SELECT match_id, frame, count(*) AS n FROM seen GROUP BY 1, 2) GROUP BY 1)
    SELECT match_id, count(*) FILTER (team = 0) AS points_0, count(*) FILTER (team = 1) AS points_1,
      coalesce(any_value(keypoint_frames), 0) AS keypoint_frames, coalesce(any_value(calibrated), false) AS calibrated
    FROM placed LEFT JOIN k USING (match_id) LEFT JOIN c USING (match_id) GROUP BY 1""")
def _(v):
    ok = v.seen.groupBy("match_id", "frame").agg((F.count(F.lit(1)) >= 8).alias("ok"))
    return sp.export_totals(placed(v), v.kp, ok)


# The lines of a pitch of 105 x 68 metres, origin in a corner.
CTES["pitch_lines"] = """SELECT * FROM (VALUES ('penalty_area_left_top', 0.0::DOUBLE, 54.15::DOUBLE, 16.5::DOUBLE, 54.15::DOUBLE),
    ('penalty_area_left_bottom', 0, 13.85, 16.5, 13.85), ('penalty_area_left_front', 16.5, 13.85, 16.5, 54.15), ('goal_line_left', 0, 0, 0, 68),
    ('penalty_area_right_top', 88.5, 54.15, 105, 54.15), ('penalty_area_right_bottom', 88.5, 13.85, 105, 13.85),
    ('penalty_area_right_front', 88.5, 13.85, 88.5, 54.15), ('goal_line_right', 105, 0, 105, 68), ('sideline_top', 0, 68, 105, 68),
    ('sideline_bottom', 0, 0, 105, 0), ('halfway_line', 52.5, 0, 52.5, 68)) t(name, x0, y0, x1, y1)"""


@query("S15_pitch_lines", """WITH p AS (SELECT X AS px, Y AS py FROM players)
    SELECT name, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x1 - x0 + y1 - y0, 6) AS metres,
      count(px) AS near FROM pitch_lines LEFT JOIN p ON greatest(x0 - px, px - x1, 0) ** 2 + greatest(y0 - py, py - y1, 0) ** 2 <= 2.25 GROUP BY ALL""")
def _(v):
    lines = pitch.pitch_lines()
    near = sp.near_shapes(v.players.select(F.col("X").alias("x"), F.col("Y").alias("y")), lines, 1.5)
    near = near.groupBy(F.col("shape").alias("name")).agg(F.count(F.lit(1)).alias("near"))
    table = v.spark.createDataFrame([(n, *box) for n, box in lines.items()], "name string, x0 double, y0 double, x1 double, y1 double")
    return table.join(near, "name", "left").fillna(0, ["near"]).select(
        "name", *[R(c).alias(c) for c in ("x0", "y0", "x1", "y1")], R(F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")).alias("metres"), "near")


@query("S15_zones", """WITH z AS (SELECT unnest(range(24))::INT AS zone_id),
      n AS (SELECT CAST(least(floor(Y / 68 * 4), 3) * 6 + least(floor(X / 105 * 6), 5) AS INT) AS zone_id, count(*) AS n FROM players GROUP BY 1)
    SELECT zone_id, 'zone_' || zone_id AS zone_name, round(zone_id % 6 * 17.5::DOUBLE, 6) AS x_min, round(zone_id // 6 * 17.0::DOUBLE, 6) AS y_min,
      round((zone_id % 6 + 1) * 17.5::DOUBLE, 6) AS x_max, round((zone_id // 6 + 1) * 17.0::DOUBLE, 6) AS y_max, coalesce(n, 0) AS seen FROM z LEFT JOIN n USING (zone_id)""")
def _(v):
    seen = v.players.groupBy(zone_of("X", "Y", 0, "grid").alias("zone_id")).agg(F.count(F.lit(1)).alias("seen"))
    return pitch.zones(v.spark, "grid").join(seen, "zone_id", "left").fillna(0, ["seen"]).select(
        "zone_id", "zone_name", *[R(c).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], "seen")


CTES["model_xy"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {x!r}::DOUBLE, {y!r}::DOUBLE, {str(n in pitch.CRITICAL_POINTS).lower()})"
    for i, (n, (x, y)) in enumerate(pitch.calibration_points().items())) + ") t(model_order, name, px, py, critical)"


@query("S15_model_points", """SELECT model_order, name, round(px, 6) AS px, round(py, 6) AS py, critical, count(X) AS near
    FROM model_xy LEFT JOIN players ON (X - px) * (X - px) + (Y - py) * (Y - py) <= 9 GROUP BY ALL""")
def _(v):
    points = {n: (x, y, x, y) for n, (x, y) in pitch.calibration_points().items()}
    near = sp.near_shapes(v.players.select(F.col("X").alias("x"), F.col("Y").alias("y")), points, 3.0)
    near = near.groupBy(F.col("shape").alias("name")).agg(F.count(F.lit(1)).alias("near"))
    return pitch.model_points(v.spark).join(near, "name", "left").fillna(0, ["near"]).select(
        "model_order", "name", R("px").alias("px"), R("py").alias("py"), "critical", "near")
