"""Tracks (P17, J6, J13, A28, A29, A37, E16, G5, ST2-ST4, ST7, ST8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.columns import rounded as R
from ..operators import machine
from ..operators import ownership as ow
from ..operators import sticky as sticky_rules
from ..operators import tracks as tr
from .registry import query
from .views import CTES

CTES["pts"] = "SELECT match_id, track_id, frame, seq, X AS px, Y AS py, conf FROM det"
_COS = "list_dot_product(n.vec, l.vec) / (sqrt(list_dot_product(n.vec, n.vec)) * sqrt(list_dot_product(l.vec, l.vec)) + 1e-6)"


def pts(v):
    return v.det.select("match_id", "track_id", "frame", "seq", F.col("X").alias("x"), F.col("Y").alias("y"), "conf")


@query("P17_cosine", f"SELECT n.vec_id, round({_COS}, 5) AS similarity FROM feat n JOIN feat l ON l.vec_id = n.vec_id + 1")
def _(v):
    a = v.feat.select("vec_id", "vec")
    b = v.feat.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("old"))
    return a.join(b, "vec_id").select("vec_id", R(fn.cosine("vec", "old"), 5).alias("similarity"))


@query("J6_reid_recover", f"""WITH s AS (SELECT n.match_id, n.vec_id AS det_id, l.vec_id AS track_id, {_COS} AS sim FROM feat n JOIN feat l ON n.match_id = l.match_id
      WHERE n.side = 1 AND l.side = 0 AND n.vec_id >= l.vec_id AND n.vec_id - l.vec_id <= 120)
    SELECT match_id, det_id, track_id, round(sim, 5) AS similarity FROM s WHERE sim > 0.2 QUALIFY row_number() OVER (PARTITION BY match_id, det_id ORDER BY sim DESC, track_id) = 1""")
def _(v):
    new = v.feat.filter("side = 1").select("match_id", F.col("vec_id").alias("det_id"), F.col("vec_id").cast("double").alias("t"), "vec")
    lost = v.feat.filter("side = 0").select("match_id", F.col("vec_id").alias("track_id"),
                                            F.col("vec_id").cast("double").alias("last_seen"), "vec")
    return tr.recover_tracks(new, lost, threshold=0.2).withColumn("similarity", R("similarity", 5))


@query("E16_trajectory_tail", """SELECT match_id, track_id, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame, round(sum(px), 4) AS sum_x
    FROM (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame DESC, seq DESC) <= 20) GROUP BY 1, 2""")
def _(v):
    t = tr.trajectory_tail(pts(v), 20)
    return t.select("match_id", "track_id", F.size("trajectory").alias("points"),
                    F.col("trajectory")[0]["frame"].alias("first_frame"), F.element_at("trajectory", -1)["frame"].alias("last_frame"),
                    R(F.expr("aggregate(trajectory, 0D, (s, p) -> s + p.x)"), 4).alias("sum_x"))


# one measurement per row, applied with noise 1, then with 1 / (conf + 0.1) where conf < 1; gains follow from the error p
CTES["kal0"] = "SELECT match_id, track_id, frame, seq, px AS zx, py AS zy, conf, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame, seq) AS rn FROM pts"


def _updated(rows: str, noise: str) -> str:
    """SQL: one update of (x, y, vx, vy, p) by the measurement (zx, zy)."""
    gain = f"(p + 0.01::DOUBLE) / (p + 0.01::DOUBLE + {noise})"
    keep = "match_id, track_id, frame, seq, rn, zx, zy, conf"
    return f"""SELECT {keep}, x + vx + g * (zx - (x + vx)) AS x, y + vy + g * (zy - (y + vy)) AS y, vx + g * (zx - (x + vx)) AS vx, vy + g * (zy - (y + vy)) AS vy,
        (1 - g) * (p + 0.01::DOUBLE) AS p FROM (SELECT *, {gain} AS g FROM ({rows}))"""


def _filtered(rows: str) -> str:
    return _updated(_updated(rows, "1.0::DOUBLE"), "CASE WHEN conf < 1 THEN 1.0::DOUBLE / (conf + 0.1::DOUBLE) ELSE 1.0::DOUBLE END")


_KAL = f"""WITH RECURSIVE kal AS ({_filtered("SELECT *, zx AS x, zy AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 1.0::DOUBLE AS p FROM kal0 WHERE rn = 1")}
    UNION ALL {_filtered("SELECT e.*, h.x, h.y, h.vx, h.vy, h.p FROM kal h JOIN kal0 e ON e.match_id = h.match_id AND e.track_id = h.track_id AND e.rn = h.rn + 1")})"""


def smoothed(v):
    return v.once("smoothed", lambda: tr.kalman_smooth(pts(v)))


@query("A28_smoothing_stats", f"""{_KAL} SELECT match_id, track_id, round(avg(sqrt(vx * vx + vy * vy)), 4) AS avg_velocity, round(max(sqrt(vx * vx + vy * vy)), 4) AS max_velocity, round(avg(conf), 6) AS avg_conf, round(min(conf), 6) AS min_conf
    FROM (SELECT * FROM kal QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame DESC, seq DESC) <= 30) GROUP BY 1, 2""")
def _(v):
    speed = smoothed(v).withColumn("velocity", F.hypot("vel_x", "vel_y")).join(pts(v), ["match_id", "track_id", "frame", "seq"])
    out = tr.smoothing_stats(speed)
    return out.select("match_id", "track_id", *[R(n, 4).alias(n) for n in ("avg_velocity", "max_velocity")], *[R(n).alias(n) for n in ("avg_conf", "min_conf")])


@query("A29_track_counts", """WITH l AS (SELECT match_id, track_id, max(frame) AS f FROM det GROUP BY 1, 2), e AS (SELECT match_id, max(frame) AS m FROM det GROUP BY 1)
    SELECT match_id, count(*) FILTER (m - f <= 5) AS active, count(*) FILTER (m - f > 5 AND m - f <= 10) AS lost, count(*) AS total_ids FROM l JOIN e USING (match_id) GROUP BY 1""")
def _(v):
    return tr.track_counts(v.det, fps=1.0, max_age_seconds=5.0, max_lost=10.0)


@query("ST3_kalman_smooth", f"""{_KAL} SELECT match_id, track_id, frame, seq, round(x, 4) AS smooth_x, round(y, 4) AS smooth_y, round(vx, 4) AS vel_x, round(vy, 4) AS vel_y FROM kal""")
def _(v):
    return smoothed(v).select("match_id", "track_id", "frame", "seq", *[R(n, 4).alias(n) for n in ("smooth_x", "smooth_y", "vel_x", "vel_y")])


_SPEED = "sqrt((e.zx - h.ax) * (e.zx - h.ax) + (e.zy - h.ay) * (e.zy - h.ay)) / ((e.frame - h.a_frame) / 0.5::DOUBLE)"
_WAS = "sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) / ((a_frame - b_frame) / 0.5::DOUBLE)"


@query("ST4_trajectory_valid", f"""WITH RECURSIVE val AS (SELECT match_id, track_id, frame, seq, rn, zx AS ax, zy AS ay, frame AS a_frame, NULL::DOUBLE AS bx, NULL::DOUBLE AS b_y, NULL::BIGINT AS b_frame, NULL::VARCHAR AS reason FROM kal0 WHERE rn = 1
      UNION ALL SELECT match_id, track_id, frame, seq, rn, CASE WHEN why IS NULL THEN zx ELSE ax END, CASE WHEN why IS NULL THEN zy ELSE ay END, CASE WHEN why IS NULL THEN frame ELSE a_frame END,
        CASE WHEN why IS NULL THEN ax ELSE bx END, CASE WHEN why IS NULL THEN ay ELSE b_y END, CASE WHEN why IS NULL THEN a_frame ELSE b_frame END, why FROM (
        SELECT *, CASE WHEN frame > a_frame AND speed > 20 THEN 'velocity' WHEN frame > a_frame AND a_frame > b_frame AND abs(speed - {_WAS}) / ((frame - a_frame) / 0.5::DOUBLE) > 8 THEN 'acceleration' END AS why FROM (
          SELECT e.*, h.ax, h.ay, h.a_frame, h.bx, h.b_y, h.b_frame, CASE WHEN e.frame > h.a_frame THEN {_SPEED} END AS speed
          FROM val h JOIN kal0 e ON e.match_id = h.match_id AND e.track_id = h.track_id AND e.rn = h.rn + 1)))
    SELECT match_id, track_id, frame, seq, reason IS NULL AS valid, reason FROM val""")
def _(v):
    return machine.validate_trajectories(pts(v), fps=0.5, max_speed=20.0, max_accel=8.0, block_rows=64)


@query("ST7_track_lifecycle", """WITH n AS (SELECT match_id, track_id, frame AS t, lead(frame) OVER (PARTITION BY match_id, track_id ORDER BY frame, seq) AS nx FROM det),
    u AS (SELECT n.*, coalesce(nx, e) AS until FROM n JOIN (SELECT match_id, max(frame) AS e FROM det GROUP BY 1) USING (match_id)),
    g AS (SELECT * FROM u WHERE until - t > 5)
    SELECT match_id, track_id, 'lost' AS state, (t + 5)::DOUBLE AS start, least(until, t + 20)::DOUBLE AS stop FROM g
    UNION ALL SELECT match_id, track_id, 'expired', (t + 20)::DOUBLE, until::DOUBLE FROM g WHERE until - t > 20""")
def _(v):
    return tr.lifecycle(v.det, fps=1.0, max_age_seconds=5.0, max_lost=20.0, block_frames=64)


@query("ST8_gap_fill_confidence", """WITH w AS (SELECT match_id, track_id, frame, seq, CASE WHEN conf > 0.75 THEN frame END AS sf, CASE WHEN conf > 0.75 THEN px END AS sx, CASE WHEN conf > 0.75 THEN py END AS sy FROM pts),
    l AS (SELECT *, last_value(sf IGNORE NULLS) OVER o AS lf, last_value(sx IGNORE NULLS) OVER o AS lx, last_value(sy IGNORE NULLS) OVER o AS ly FROM w
      WINDOW o AS (PARTITION BY match_id, track_id ORDER BY frame, seq ROWS UNBOUNDED PRECEDING))
    SELECT match_id, track_id, frame, seq, round(lx, 6) AS x, round(ly, 6) AS y, round(CASE WHEN lf IS NOT NULL THEN greatest(0.1, pow(0.95, frame - lf)) END, 6) AS flow_conf FROM l""")
def _(v):
    p = pts(v)
    out = tr.gap_fill(p.filter("conf > 0.75").select("match_id", "track_id", "frame", "seq", "x", "y"),
                      p.select("match_id", "track_id", "frame", "seq"), block_frames=64)
    return out.withColumns({n: R(n) for n in ("x", "y", "flow_conf")})


def ball_frames(v):
    """One row per frame: the ball's centre, or null, and the players as an array."""
    cx, cy = fn.box_centre()
    d = v.det.withColumns({"cx": cx, "cy": cy})
    ball = ow.first_ball(v.det).select("match_id", "frame", ((F.col("x1") + F.col("x2")) / 2.0).alias("ball_x"),
                                       ((F.col("y1") + F.col("y2")) / 2.0).alias("ball_y"))
    squads = d.groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(F.when(
        F.col("class_id").isin(0, 3), F.struct("seq", "track_id", F.col("cx").alias("x"), F.col("cy").alias("y"),
                                               F.col("team_id").alias("team"))))).alias("players"))
    return squads.join(ball, ["match_id", "frame"], "left")


def sticky(v):
    return v.once("sticky", lambda: sticky_rules.sticky_possession(
        v.once("ball_frames", lambda: ball_frames(v)), control=600.0, gap=10.0, hold_distance=400.0, dominance=0.4, window=4))


@query("ST2_possession_v1")
def _(v):
    return sticky(v)


@query("A37_assigned_share")
def _(v):
    return sticky_rules.assigned_share(sticky(v))


@query("G5_greedy_match")
def _(v):
    boxes = v.feat.select("match_id", F.expr("vec_id div 10").alias("frame"), F.col("vec_id").alias("seq"),
                          *[F.lit(x).cast("double").alias(n) for n, x in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 20))], "vec")
    return machine.greedy_match(boxes, fps=1.0)
