"""Projections, scalar functions and per-frame ownership (P*, J1, J2, J8, J12, E6, E7, A36, T5, S15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import pitch
from ..functions.columns import rounded
from ..operators import ownership as ow
from . import possession_queries  # noqa: F401  (its CTEs)
from .registry import query
from .views import CTES

R = rounded


def rsql(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


@query("P1_bbox_center", "SELECT seq, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM det")
def _(v):
    cx, cy = fn.box_centre()
    return v.det.select("seq", R(cx).alias("cx"), R(cy).alias("cy"))


@query("P2_bbox_foot", "SELECT seq, round((x1 + x2) / 2, 6) AS fx, round(y2, 6) AS fy FROM det")
def _(v):
    fx, fy = fn.box_foot()
    return v.det.select("seq", R(fx).alias("fx"), R(fy).alias("fy"))


@query("P3_class_name", """SELECT seq, CASE seq % 5 WHEN 0 THEN 'player' WHEN 1 THEN 'ball' WHEN 2 THEN 'referee'
    WHEN 3 THEN 'goalkeeper' ELSE 'unknown' END AS class_name FROM det""")
def _(v):
    return v.det.select("seq", fn.class_name(F.col("seq") % 5).alias("class_name"))


@query("P4_outfield_filter", "SELECT seq, track_id FROM det WHERE class_id IN (0, 3)")
def _(v):
    return v.det.filter(fn.of_class("class_id", (0, 3))).select("seq", "track_id")


@query("P5_valid_team", "SELECT seq, CASE WHEN team_id >= 0 THEN team_id END AS team FROM det")
def _(v):
    return v.det.select("seq", fn.valid_team("team_id").alias("team"))


@query("P6_conf_filter_max_det", """SELECT match_id, frame, seq, row_number() OVER (PARTITION BY match_id, frame ORDER BY conf DESC, seq) AS rank
    FROM det WHERE conf >= 0.3 QUALIFY rank <= 3""")
def _(v):
    return ow.top_detections(v.det, 0.3, 3).select("match_id", "frame", "seq", "rank")


@query("P7_normalise_input", """SELECT seq, round(CASE WHEN seq % 3 = 0 THEN X * 12 WHEN seq % 3 = 1 THEN (x1 + x2) / 2 END, 6) AS px,
    round(CASE WHEN seq % 3 = 0 THEN Y * 10 WHEN seq % 3 = 1 THEN (y1 + y2) / 2 END, 6) AS py,
    coalesce(CASE WHEN seq % 2 = 0 THEN team_id END, track_id % 2) AS team FROM det WHERE seq % 3 <> 2""")
def _(v):
    given, boxed = F.col("seq") % 3 == 0, F.col("seq") % 3 == 1
    raw = v.det.select(
        "seq", F.when(given, F.struct((F.col("X") * 12).alias("x"), (F.col("Y") * 10).alias("y"))).alias("pos"),
        F.when(boxed, F.struct("x1", "y1", "x2", "y2")).alias("bbox"),
        F.when(F.col("seq") % 2 == 0, F.col("team_id")).alias("team_id"),
        (F.col("track_id") % 2).alias("team"))
    cx, cy = fn.box_centre("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
    return (raw.select("seq", R(F.coalesce("pos.x", cx)).alias("px"), R(F.coalesce("pos.y", cy)).alias("py"),
                       F.coalesce("team_id", "team").alias("team"))
            .filter(F.col("px").isNotNull()))


@query("P8_size_gate", """SELECT seq FROM det WHERE x2 - x1 >= 15 AND y2 - y1 >= 30
    AND (x2 - x1) * (y2 - y1) / 921600.0::DOUBLE >= 0.001""")
def _(v):
    return v.det.filter(fn.usable_crop("x1", "y1", "x2", "y2", 1280.0 * 720.0)).select("seq")


@query("P9_pitch_normalise", """SELECT seq, round((X - 52.5 + 52.5) / 105, 6) AS u, round((Y - 34 + 34) / 68, 6) AS v,
    round(X / 105, 6) AS cu, round(Y / 68, 6) AS cv, round(X - 52.5, 6) AS bx, round(Y - 34, 6) AS "by" FROM det""")
def _(v):
    u, w = fn.to_unit(F.col("X") - 52.5, F.col("Y") - 34.0)
    cu, cv = fn.to_unit("X", "Y", "corner")
    bx, by = fn.from_unit(u, w)
    return v.det.select("seq", R(u).alias("u"), R(w).alias("v"), R(cu).alias("cu"), R(cv).alias("cv"),
                        R(bx).alias("bx"), R(by).alias("by"))


_XS, _YS = "(X * 1.1 - 5)", "(Y * 1.1 - 3)"  # some points fall outside the pitch
_OUT = f"{_XS} < 0 OR {_XS} > 105 OR {_YS} < 0 OR {_YS} > 68"


@query("P10_zone_from_xy", f"""WITH z AS (SELECT seq, {_XS} AS px, {_YS} AS py, track_id % 2 AS team FROM det),
    o AS (SELECT *, CASE WHEN team = 0 THEN px - 52.5::DOUBLE ELSE 52.5::DOUBLE - px END AS al, py - 34.0::DOUBLE AS ac,
          px < 0 OR px > 105 OR py < 0 OR py > 68 AS outside FROM z),
    t AS (SELECT *, CASE WHEN al < -17.5 THEN 0 WHEN al < 17.5 THEN 1 ELSE 2 END AS third,
          CASE WHEN ac < -68.0::DOUBLE / 6 THEN 0 WHEN ac < 68.0::DOUBLE / 6 THEN 1 ELSE 2 END AS lane FROM o)
    SELECT seq, CASE WHEN outside THEN -1 ELSE least(floor(py / 68 * 4), 3) * 6 + least(floor(px / 105 * 6), 5) END AS grid,
      CASE WHEN outside THEN -1 ELSE third END AS thirds, CASE WHEN outside THEN -1 ELSE third * 3 + lane END AS lanes FROM t""")
def _(v):
    px, py, team = F.col("X") * 1.1 - 5, F.col("Y") * 1.1 - 3, F.col("track_id") % 2
    return v.det.select("seq", fn.zone_of(px, py, team, "grid").alias("grid"),
                        fn.zone_of(px, py, team, "thirds").alias("thirds"), fn.zone_of(px, py, team).alias("lanes"))


@query("P11_zone_name_bounds", """WITH z AS (SELECT seq, seq % 26 - 1 AS zone_id FROM det)
    SELECT seq, CASE WHEN zone_id BETWEEN 0 AND 23 THEN 'zone_' || zone_id ELSE 'unknown' END AS grid_name,
      coalesce((['def_left', 'def_center', 'def_right', 'mid_left', 'mid_center', 'mid_right', 'off_left', 'off_center', 'off_right'])
        [CASE WHEN zone_id >= 0 THEN zone_id + 1 ELSE 99 END], 'unknown') AS lane_name,
      round(CASE WHEN zone_id BETWEEN 0 AND 23 THEN (zone_id % 6) * 17.5::DOUBLE END, 6) AS x_min,
      round(CASE WHEN zone_id BETWEEN 0 AND 23 THEN (zone_id // 6) * 17.0::DOUBLE END, 6) AS y_min,
      round(CASE WHEN zone_id BETWEEN 0 AND 23 THEN (zone_id % 6 + 1) * 17.5::DOUBLE END, 6) AS x_max,
      round(CASE WHEN zone_id BETWEEN 0 AND 23 THEN (zone_id // 6 + 1) * 17.0::DOUBLE END, 6) AS y_max FROM z""")
def _(v):
    z = F.col("seq") % 26 - 1
    bounds = {n: R(b).alias(n) for n, b in fn.zone_bounds(z).items()}
    return v.det.select("seq", fn.zone_name(z, "grid").alias("grid_name"), fn.zone_name(z).alias("lane_name"),
                        *bounds.values())


@query("P12_coarse_area", """SELECT seq, CASE WHEN X < 35 THEN 'Defence' WHEN X < 70 THEN 'Midfield' ELSE 'Attack' END AS area,
    CASE WHEN Y < 68.0::DOUBLE / 3 THEN 'Right' WHEN Y < 136.0::DOUBLE / 3 THEN 'Centre' ELSE 'Left' END AS lane FROM det""")
def _(v):
    area, lane = fn.coarse_area("X", "Y")
    return v.det.select("seq", area.alias("area"), lane.alias("lane"))


@query("P13_display_zone_name", """SELECT seq, coalesce((['Defensive Left', 'Defensive Center', 'Defensive Right', 'Midfield Left', 'Midfield Center',
    'Midfield Right', 'Offensive Left', 'Offensive Center', 'Offensive Right'])[seq % 10 + 1], 'Zone ' || (seq % 10)) AS name FROM det""")
def _(v):
    return v.det.select("seq", fn.display_zone(F.col("seq") % 10).alias("name"))


_NEAR = "EXISTS (SELECT 1 FROM excl WHERE sqrt((d.X - ex) * (d.X - ex) + (d.Y - ey) * (d.Y - ey)) <= {r})"


@query("P14_heatmap_valid", f"SELECT seq, X > 2 AND X < 103 AND NOT {_NEAR.format(r=1.2)} AS ok FROM det d")
def _(v):
    return v.det.select("seq", fn.heatmap_valid("X", "Y").alias("ok"))


@query("P15_heatmap_valid_render", f"""SELECT seq, X > 2 AND X < 103 AND Y > 0.4 AND Y < 67.6::DOUBLE AND NOT {_NEAR.format(r=1.2)} AS ok FROM det d""")
def _(v):
    return v.det.select("seq", fn.heatmap_valid("X", "Y", pitch.SIDELINE_MARGIN).alias("ok"))


@query("J5_exclusion_anti_join", f"SELECT seq FROM det d WHERE NOT {_NEAR.format(r=3.0)}")
def _(v):
    return v.det.filter(~fn.near_pitch_point("X", "Y", 3.0)).select("seq")


@query("P16_iou", """WITH p AS (SELECT seq, x1, y1, x2, y2, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2
      FROM det WINDOW w AS (PARTITION BY match_id, frame ORDER BY seq)),
    q AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS i FROM p WHERE a1 IS NOT NULL)
    SELECT seq, round(i / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - i + 1e-6), 6) AS iou FROM q""")
def _(v):
    from pyspark.sql.window import Window
    w = Window.partitionBy("match_id", "frame").orderBy("seq")
    p = v.det.withColumn("o", F.lag(F.struct("x1", "y1", "x2", "y2")).over(w)).filter("o is not null")
    iou = fn.overlap(("x1", "y1", "x2", "y2"), ("o.x1", "o.y1", "o.x2", "o.y2"))
    return p.select("seq", R(iou).alias("iou"))


@query("P29_frame_clock", """SELECT seq, round(minute / 30.0::DOUBLE, 6) AS seconds,
    (minute // 1800) || ':' || lpad(CAST((minute // 30) % 60 AS VARCHAR), 2, '0') AS clock FROM base""")
def _(v):
    return v.base.select("seq", R(fn.seconds("minute")).alias("seconds"), fn.clock("minute").alias("clock"))


@query("P32_pattern_label", """SELECT seq, CASE WHEN seq % 4 = 0 THEN 'balanced' WHEN k / 100.0::DOUBLE > 0.7 THEN 'concentrated'
    WHEN k / 100.0::DOUBLE > 0.5 THEN 'focused' ELSE 'distributed' END AS pattern FROM base""")
def _(v):
    return v.base.select("seq", fn.pattern_label(F.col("seq") % 4, F.col("k") / 100.0).alias("pattern"))


@query("P33_style_summary", """WITH s AS (SELECT seq, concat_ws('; ', CASE WHEN seq % 3 = 0 THEN 'Active in a, b, c' END,
        CASE WHEN seq % 2 = 0 THEN CASE WHEN k % 10 >= 5 THEN 'Long passing chains' ELSE 'Brief passing chains' END END,
        CASE WHEN k >= 60 THEN 'Mostly on the ball' WHEN k <= 40 THEN 'Mostly off the ball' END) AS t FROM base)
    SELECT seq, CASE WHEN t = '' THEN 'No clear style' ELSE t END AS style FROM s""")
def _(v):
    zones = F.when(F.col("seq") % 3 == 0, F.array(*[F.lit(z) for z in "abcd"])).otherwise(
        F.array().cast("array<string>"))
    avg = F.when(F.col("seq") % 2 == 0, F.col("k") % 10)
    return v.base.select("seq", fn.style_summary(zones, avg, "k").alias("style"))


@query("P31_to_json_safe", """SELECT seq, '{"track_id":' || track_id || ',"box":{"side":' || CASE WHEN seq % 3 = 0 THEN 'null' ELSE CAST((seq % 100) / 2.0::DOUBLE AS VARCHAR) END
    || ',"ids":[' || class_id || ',' || team_id || ']},"marks":[null,' || CAST((seq % 50) / 4.0::DOUBLE AS VARCHAR) || ',null],"by":{"a":null,"b":0.5}}' AS doc FROM det""")
def _(v):
    bad, worse = F.lit(float("nan")), F.lit(float("inf"))
    rows = v.det.select("seq", "track_id", F.struct(F.when(F.col("seq") % 3 == 0, bad).otherwise((F.col("seq") % 100) / 2.0).alias("side"),
                                                    F.array("class_id", "team_id").alias("ids")).alias("box"),
                        F.array(bad, (F.col("seq") % 50) / 4.0, worse).alias("marks"), F.create_map(F.lit("a"), -worse, F.lit("b"), F.lit(0.5)).alias("by"))
    return rows.select("seq", fn.json_safe(rows, "track_id", "box", "marks", "by").alias("doc"))


@query("P24_angle_class", """WITH s AS (SELECT seq, atan2(y2 - y1, x2 - x1) AS a0, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM lines),
    a AS (SELECT *, CASE WHEN a0 > pi() / 2 THEN a0 - pi() WHEN a0 < -pi() / 2 THEN a0 + pi() ELSE a0 END AS a FROM s WHERE len >= 50)
    SELECT seq, CASE WHEN abs(a) < radians(4) THEN 'horizontal' WHEN abs(abs(a) - pi() / 2) < radians(4) THEN 'vertical'
      WHEN a > 0 THEN 'diagonal_pos' ELSE 'diagonal_neg' END AS orientation FROM a""")
def _(v):
    g = fn.segment_geometry()
    return v.lines.filter(g["length"] >= 50).select("seq", fn.angle_class(g["angle"], 4.0).alias("orientation"))


@query("P34_segment_geometry", """WITH s AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM lines)
    SELECT seq, round((x1 + x2) / 2, 6) AS mid_x, round((y1 + y2) / 2, 6) AS mid_y, round(len, 6) AS length,
      round(atan2(y2 - y1, x2 - x1), 6) AS angle, round((x2 - x1) / len, 6) AS dir_x, round((y2 - y1) / len, 6) AS dir_y FROM s""")
def _(v):
    return v.lines.select("seq", *[R(x).alias(n) for n, x in fn.segment_geometry().items()])


CTES.update({
    "ball": "SELECT * FROM det WHERE class_id = 1 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY seq) = 1",
    "bdist": """SELECT d.match_id, d.frame, d.seq, d.track_id, d.team_id, d.class_id,
        sqrt(((d.x1 + d.x2) / 2 - (b.x1 + b.x2) / 2) * ((d.x1 + d.x2) / 2 - (b.x1 + b.x2) / 2)
           + ((d.y1 + d.y2) / 2 - (b.y1 + b.y2) / 2) * ((d.y1 + d.y2) / 2 - (b.y1 + b.y2) / 2)) AS dist
        FROM det d JOIN ball b ON d.match_id = b.match_id AND d.frame = b.frame WHERE d.class_id IN (0, 3)""",
    "owner": """SELECT match_id, frame, track_id AS owner_player, CASE WHEN team_id >= 0 THEN team_id END AS owner_team, dist
        FROM (SELECT * FROM bdist QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY dist, seq) = 1) WHERE dist < 200""",
    "near2": "SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY dist, seq) AS r FROM bdist",
    "cand": """SELECT match_id, frame, CASE WHEN d1 > 300 THEN 'none' WHEN d2 - d1 <= 40 THEN 'contested' ELSE 'player' END AS kind,
        CASE WHEN d1 <= 300 AND (d2 IS NULL OR d2 - d1 > 40) THEN track END AS player,
        CASE WHEN d1 <= 300 AND (d2 IS NULL OR d2 - d1 > 40) THEN tm END AS team
        FROM (SELECT match_id, frame, max(dist) FILTER (r = 1) AS d1, max(dist) FILTER (r = 2) AS d2, max(track_id) FILTER (r = 1) AS track,
          max(team_id) FILTER (r = 1) AS tm FROM near2 GROUP BY 1, 2)""",
})


def owners(v):
    return ow.ball_owner(v.det, limit=200.0, classes=(0, 3))


def candidates(v):
    return ow.contested_candidates(v.det, 300.0, 40.0, classes=(0, 3))


@query("J1_ball_owner", "SELECT match_id, frame, owner_player, owner_team, round(dist, 6) AS dist FROM owner")
def _(v):
    return owners(v).withColumn("dist", R("dist"))


@query("J1_ball_owner_metres", """WITH n AS (SELECT d.match_id, d.frame, d.seq, d.track_id, d.team_id,
      sqrt((d.X - b.X) * (d.X - b.X) + (d.Y - b.Y) * (d.Y - b.Y)) AS dist
      FROM det d JOIN ball b ON d.match_id = b.match_id AND d.frame = b.frame WHERE d.class_id IN (0, 3))
    SELECT match_id, frame, track_id AS owner_player, team_id AS owner_team, round(dist, 6) AS dist
    FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY dist, seq) = 1) WHERE dist <= 15""")
def _(v):
    return ow.ball_owner(v.det, 15.0, strict=False, classes=(0, 3), position=("X", "Y")).withColumn("dist", R("dist"))


@query("J2_contested_candidate", "SELECT match_id, frame, kind, player, team FROM cand")
def _(v):
    return candidates(v)


@query("T5_first_ball", "SELECT match_id, frame, seq, 0 AS track_id, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM ball")
def _(v):
    return ow.first_ball(v.det).select("match_id", "frame", "seq", "track_id", R("x1").alias("x1"), R("y1").alias("y1"))


@query("J8_track_team", """SELECT d.match_id, d.seq, d.track_id, coalesce(t.team, -1) AS team FROM det d
    LEFT JOIN (SELECT match_id, track_id, min(track_id % 2) AS team FROM det WHERE track_id % 3 <> 0 GROUP BY 1, 2) t
    ON t.match_id = d.match_id AND t.track_id = d.track_id""")
def _(v):
    teams = (v.det.filter("track_id % 3 <> 0").groupBy("match_id", "track_id")
             .agg(F.min(F.col("track_id") % 2).alias("team")))
    return ow.track_team(v.det.select("match_id", "seq", "track_id"), teams)


@query("J12_attach_owner_position", """SELECT p.match_id, p.seq, o.match_id IS NOT NULL AS owner,
    CASE WHEN o.match_id IS NOT NULL THEN round(X, 6) END AS field_x, CASE WHEN o.match_id IS NOT NULL THEN round(Y, 6) END AS field_y,
    CASE WHEN o.match_id IS NOT NULL THEN least(floor(Y / 68 * 4), 3) * 6 + least(floor(X / 105 * 6), 5) END AS zone_id
    FROM players p LEFT JOIN owner o ON o.match_id = p.match_id AND o.frame = p.frame AND o.owner_player = p.track_id""")
def _(v):
    placed = v.players.select("match_id", "frame", "seq", "track_id", R("X").alias("field_x"), R("Y").alias("field_y"),
                              fn.zone_of("X", "Y", 0, "grid").alias("zone_id"))
    return ow.attach_owner_position(placed, owners(v)).select(
        "match_id", "seq", "owner", "field_x", "field_y", "zone_id")


CTES["cobs"] = """SELECT match_id, frame, seq, CASE WHEN team IS NULL THEN 'none' WHEN k % 5 = 0 THEN 'contested' ELSE 'player' END AS kind,
    CASE WHEN team IS NOT NULL AND k % 5 <> 0 THEN k % 3 END AS player, CASE WHEN team IS NOT NULL AND k % 5 <> 0 THEN team END AS team FROM obs"""
CTES["dom0"] = """SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame, seq) AS rn FROM cobs"""
CTES["dom"] = """SELECT a.match_id, a.frame, a.seq, a.rn, count(*) AS rows_in,
    max(b.kind = 'player' AND b.player = 0) AS x, count(*) FILTER (b.player = 0) AS n0, count(*) FILTER (b.player = 1) AS n1,
    count(*) FILTER (b.player = 2) AS n2, count(*) FILTER (b.team = 0) AS t0, count(*) FILTER (b.team = 1) AS t1,
    count(*) FILTER (b.kind = 'contested') AS nc, count(*) FILTER (b.kind = 'none') AS nn
    FROM dom0 a JOIN dom0 b ON a.match_id = b.match_id AND b.rn BETWEEN a.rn - 4 AND a.rn GROUP BY 1, 2, 3, 4"""
_TOP = "CASE WHEN rows_in = 5 AND n0 >= 3 THEN 0 WHEN rows_in = 5 AND n1 >= 3 THEN 1 WHEN rows_in = 5 AND n2 >= 3 THEN 2 END"


def dominance(v):
    seen = F.col("team").isNotNull()
    kind = F.when(~seen, "none").when(F.col("k") % 5 == 0, "contested").otherwise("player")
    rows = v.obs.withColumn("kind", kind)
    is_player = F.col("kind") == "player"
    rows = rows.select("match_id", "frame", "seq", "kind", F.when(is_player, F.col("k") % 3).alias("player"),
                       F.when(is_player, F.col("team")).alias("team"))
    return ow.window_dominance(rows, halo_size=256)


@query("E6_window_dominance", f"SELECT match_id, frame, seq, {_TOP} AS dominant FROM dom")
def _(v):
    return dominance(v).select("match_id", "frame", "seq", "dominant")


@query("A36_vote_share", f"""SELECT match_id, frame, seq, round(t0 / rows_in::DOUBLE, 6) AS share_0, round(t1 / rows_in::DOUBLE, 6) AS share_1,
    round(nc / rows_in::DOUBLE, 6) AS share_contested, round(nn / rows_in::DOUBLE, 6) AS share_none,
    round(CASE {_TOP} WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 END / rows_in::DOUBLE, 6) AS player_share FROM dom""")
def _(v):
    names = ("share_0", "share_1", "share_contested", "share_none", "player_share")
    return ow.vote_share(dominance(v)).select("match_id", "frame", "seq", *[R(n).alias(n) for n in names])


@query("E7_frames_since_change", """WITH r AS (SELECT *, sum(CASE WHEN prev_team IS DISTINCT FROM current_team OR prev_frame IS NULL THEN 1 ELSE 0 END) OVER
      (PARTITION BY match_id ORDER BY frame, seq) AS g FROM poss)
    SELECT match_id, frame, seq, row_number() OVER (PARTITION BY match_id, g ORDER BY frame, seq) - 1 AS rows_since_change FROM r""")
def _(v):
    base = v.frames.select("match_id", "frame", "seq", "current_team")
    return ow.rows_since_change(base, ["current_team"]).select("match_id", "frame", "seq", "rows_since_change")


@query("P23_flip_point", "SELECT name, round(105 - PX, 6) AS x, round(PY, 6) AS y, count(*) AS seen FROM kp0 GROUP BY ALL")
def _(v):
    pts = v.kp.select("name").join(F.broadcast(pitch.field_points(v.spark)), "name")
    return pts.groupBy("name", R(fn.flip_x("px")).alias("x"), R("py").alias("y")).agg(F.count(F.lit(1)).alias("seen"))


@query("S15_pitch_points", """SELECT name, round(PX, 6) AS x, round(PY, 6) AS y, unambiguous, priority, coalesce(n, 0) AS seen FROM points
    LEFT JOIN (SELECT name, count(*) AS n FROM kp GROUP BY 1) USING (name)""")
def _(v):
    seen = v.kp.groupBy("name").agg(F.count(F.lit(1)).alias("seen"))
    return (pitch.field_points(v.spark).join(seen, "name", "left").fillna(0, subset=["seen"])
            .select("name", R("px").alias("x"), R("py").alias("y"), "unambiguous", "priority", "seen"))
