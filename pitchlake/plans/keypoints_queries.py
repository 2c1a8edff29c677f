"""Keypoints, homographies, projection and field lines (P18-P22, J3, J4, J7, J9-J11, J14, A25-A27,
A33, A34, A39, E8-E10, E17, E18, ST12, G1-G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import pitch
from ..functions.columns import H_COLUMNS
from ..functions.columns import rounded as R
from ..operators import keypoints as kpt
from .registry import query
from .views import CTES, POINT_NAMES

_H = {"h00": "0.09::DOUBLE + 0.000137::DOUBLE * (x - floor(x))", "h01": "-0.001::DOUBLE * conf", "h02": "conf - 3.0::DOUBLE",
      "h10": "0.002::DOUBLE * conf", "h11": "-0.1::DOUBLE - 0.01::DOUBLE * conf", "h12": "70.0::DOUBLE + conf",
      "h20": "0.00001::DOUBLE * conf", "h21": "-0.00001::DOUBLE + 0.0::DOUBLE * conf", "h22": "1.0::DOUBLE + 0.01::DOUBLE * conf"}
_FLIP_PAIRS = [(f"smallarea_{v}_inner", f"bigarea_{v}_inner") for v in ("top", "bottom")] + [
    (n, f"midline_{v}_intersection") for v in ("top", "bottom") for n in (f"bigarea_{v}_inner", f"{v}_arc_area_intersection")]

CTES.update({
    "hrow": "SELECT * FROM kp QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY seq) = 1",
    "hcount": "SELECT match_id, frame, count(*) AS num_keypoints FROM seen GROUP BY 1, 2",
    "homs": "SELECT r.match_id, r.frame, r.conf, c.num_keypoints, " + ", ".join(f"{e} AS {n}" for n, e in _H.items())
            + " FROM hrow r JOIN hcount c ON c.match_id = r.match_id AND c.frame = r.frame",
    "pairs": "SELECT s.match_id, s.frame, s.name, s.x, s.y, s.conf, p.PX, p.PY FROM seen s JOIN points p ON p.name = s.name WHERE s.conf >= 0.4",
    "plink": "SELECT d.match_id, d.seq, d.frame // 3 AS frame, (d.x1 + d.x2) / 2 AS ax, d.y2 AS ay FROM players d",
    "refs0": """SELECT p.match_id, p.seq, p.frame, p.ax, p.ay, k.name, k.x, k.y, k.PX, k.PY,
        sqrt((p.ax - k.x) * (p.ax - k.x) + (p.ay - k.y) * (p.ay - k.y)) AS dist
        FROM plink p JOIN pairs k ON k.match_id = p.match_id AND k.frame = p.frame""",
    "refs": """SELECT *, row_number() OVER (PARTITION BY match_id, seq ORDER BY dist, name) AS rnk,
        count(*) OVER (PARTITION BY match_id, seq) AS total FROM refs0 QUALIFY rnk <= 4""",
    "scales": """SELECT r.match_id, r.seq, coalesce(s.scale, 10.0) AS scale FROM (SELECT DISTINCT match_id, seq FROM refs) r LEFT JOIN (
        SELECT a.match_id, a.seq, median(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) /
          sqrt((a.PX - b.PX) * (a.PX - b.PX) + (a.PY - b.PY) * (a.PY - b.PY))) AS scale
        FROM refs a JOIN refs b ON a.match_id = b.match_id AND a.seq = b.seq AND b.rnk BETWEEN a.rnk + 1 AND a.rnk + 2
        WHERE sqrt((a.PX - b.PX) * (a.PX - b.PX) + (a.PY - b.PY) * (a.PY - b.PY)) > 2 GROUP BY 1, 2) s USING (match_id, seq)""",
    "votes": "SELECT match_id, frame, " + ", ".join(
        f"max(x) FILTER (name = '{a}') > max(x) FILTER (name = '{b}') AS v{i}" for i, (a, b) in enumerate(_FLIP_PAIRS))
        + " FROM pairs GROUP BY 1, 2",
    "flips": "SELECT match_id, frame, " + " + ".join(f"(v{i} IS NOT NULL)::INT" for i in range(6)) + " AS votes, "
        + " + ".join(f"coalesce(v{i}, false)::INT" for i in range(6)) + " AS flip_votes FROM votes",
    "lorient0": "SELECT *, atan2(y2 - y1, x2 - x1) AS a0 FROM lines",
    "lorient": """SELECT *, CASE WHEN abs(a) < radians(10) THEN 'horizontal' WHEN abs(abs(a) - pi() / 2) < radians(10) THEN 'vertical' ELSE 'other' END AS orientation
        FROM (SELECT *, CASE WHEN a0 > pi() / 2 THEN a0 - pi() WHEN a0 < -pi() / 2 THEN a0 + pi() ELSE a0 END AS a FROM lorient0)""",
})


def homs(v):
    first = v.kp.groupBy("match_id", "frame").agg(F.min_by(F.struct("x", "conf"), "seq").alias("r")).select(
        "match_id", "frame", "r.x", "r.conf")
    counts = v.seen.groupBy("match_id", "frame").agg(F.count(F.lit(1)).alias("num_keypoints"))
    cols = [F.expr(e.replace("::DOUBLE", "D")).alias(n) for n, e in _H.items()]
    return first.join(counts, ["match_id", "frame"]).select("match_id", "frame", "conf", "num_keypoints", *cols)


def pairs(v):
    return kpt.correspondences(v.seen, 0.4)


def points(v):
    return kpt.frame_points(pairs(v))


def player_feet(v):
    fx, fy = fn.box_foot()
    return v.players.select("match_id", "seq", F.expr("frame div 3").alias("frame"), "track_id", "team_id",
                            fx.alias("ax"), fy.alias("ay"))


def rh(df, *keep):
    return df.select(*keep, *[R(n).alias(n) for n in H_COLUMNS])


_RH = ", ".join(f"round({n}, 6) AS {n}" for n in H_COLUMNS)


@query("P18_keypoint_score", """SELECT seq, round(priority * (0.3::DOUBLE + 0.7::DOUBLE * greatest(0, 1 - sqrt((x - 640) * (x - 640) + (y - 360) * (y - 360)) / 500)), 6) AS score
    FROM kp JOIN points USING (name)""")
def _(v):
    d = fn.distance("x", "y", F.lit(640.0), F.lit(360.0))
    return v.kp.select("seq", R(fn.keypoint_score("name", d)).alias("score"))


_SIDED = "map {" + ", ".join(f"'{n}': {p}" for n, p in pitch.SIDE_POINT_PRIORITY.items()) + "}"
_SIDE = "CASE WHEN x < 640 THEN 'left' ELSE 'right' END"


@query("P18_keypoint_score_sides", f"""WITH s AS (SELECT seq, x, y, CASE WHEN name = 'corner' THEN 'corner_' || {_SIDE} || CASE WHEN y < 360 THEN '_bottom' ELSE '_top' END
      ELSE regexp_replace(replace(name, 'outter', 'outer'), '^(big|small)area_', {_SIDE} || '_\\1box_') END AS name FROM kp)
    SELECT seq, name, round(coalesce(({_SIDED})[name], 50) * (0.3::DOUBLE + 0.7::DOUBLE * greatest(0, 1 - sqrt((x - 640) * (x - 640) + (y - 360) * (y - 360)) / 500)), 6) AS score FROM s""")
def _(v):
    side = F.when(F.col("x") < 640, "left").otherwise("right")
    corner = F.concat(F.lit("corner_"), side, F.when(F.col("y") < 360, "_bottom").otherwise("_top"))
    area = F.regexp_replace(F.regexp_replace("name", "outter", "outer"), F.lit("^(big|small)area_"), F.concat(side, F.lit("_$1box_")))
    d = fn.distance("x", "y", F.lit(640.0), F.lit(360.0))
    rows = v.kp.withColumn("name", F.when(F.col("name") == "corner", corner).otherwise(area))
    return rows.select("seq", "name", R(fn.keypoint_score("name", d, pitch.SIDE_POINT_PRIORITY)).alias("score"))


_RAW_SQL = """SELECT DISTINCT CASE k % 5 WHEN 0 THEN name WHEN 1 THEN upper(replace(name, '_', ' ')) WHEN 2 THEN CAST(k AS VARCHAR)
    WHEN 3 THEN 'left-' || replace(name, '_', '-') ELSE 'x' || k END AS raw FROM kp JOIN base USING (seq)"""


def raw_names(v):
    rows = v.kp.join(v.base.select("seq", "k"), "seq")
    raw = (F.when(F.col("k") % 5 == 0, F.col("name")).when(F.col("k") % 5 == 1, F.upper(F.regexp_replace("name", "_", " ")))
           .when(F.col("k") % 5 == 2, F.col("k").cast("string"))
           .when(F.col("k") % 5 == 3, F.concat(F.lit("left-"), F.regexp_replace("name", "_", "-")))
           .otherwise(F.concat(F.lit("x"), F.col("k").cast("string"))))
    return rows.select(raw.alias("raw")).distinct()


_NUM = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in pitch.NUMBERED_POINTS.items()) + "}"


@query("P19_keypoint_name_match", f"""WITH n AS ({_RAW_SQL}), m AS (SELECT raw, replace(replace(lower(raw), ' ', '_'), '-', '_') AS norm FROM n),
    f AS (SELECT m.raw, arg_min(model.name, model.model_order) AS fuzzy, max(CASE WHEN model.name = m.norm THEN model.name END) AS exact
      FROM m JOIN model ON contains(model.name, m.norm) OR contains(m.norm, model.name) OR
        len(list_intersect(list_distinct(string_split(m.norm, '_')), list_distinct(string_split(model.name, '_')))) >= greatest(1, len(list_distinct(string_split(m.norm, '_'))) // 2)
      GROUP BY 1)
    SELECT n.raw, coalesce(({_NUM})[n.raw], f.exact, f.fuzzy) AS model_name FROM n LEFT JOIN f USING (raw)""")
def _(v):
    return kpt.match_names(raw_names(v), "raw")


@query("P20_critical_set", """WITH m AS (SELECT match_id, frame, name FROM (SELECT DISTINCT match_id, frame,
        (['corner_1', 'corner_2', 'corner_3', 'corner_4', 'center', 'penalty_left', 'circle_left', 'midfield_top'])[seq % 8 + 1] AS name FROM kp)),
    c AS (SELECT *, count(*) FILTER (name NOT IN ('circle_left', 'midfield_top')) OVER (PARTITION BY match_id, frame) AS n FROM m)
    SELECT match_id, frame, name AS model_name FROM c WHERE n < 4 OR name NOT IN ('circle_left', 'midfield_top')""")
def _(v):
    some = ["corner_1", "corner_2", "corner_3", "corner_4", "center", "penalty_left", "circle_left", "midfield_top"]
    rows = v.kp.select("match_id", "frame", pitch.name_lookup(some, F.col("seq") % 8).alias("model_name")).distinct()
    return kpt.critical_only(rows)


@query("J3_keypoint_correspondence", """SELECT seq, name, round(x, 6) AS x, round(y, 6) AS y, round(PX, 6) AS fx, round(PY, 6) AS fy
    FROM kp JOIN (SELECT name, PX, PY FROM points) USING (name) WHERE conf >= 0.4""")
def _(v):
    return kpt.correspondences(v.kp, 0.4).select(
        "seq", "name", *[R(a).alias(b) for a, b in (("x", "x"), ("y", "y"), ("px", "fx"), ("py", "fy"))])


@query("J4_k_nearest_refs", """SELECT match_id, seq, rnk - 1 AS rank, name, round(dist, 6) AS dist, round(1e6 / (greatest(1, dist) * greatest(1, dist)), 6) AS weight_ppm FROM refs""")
def _(v):
    refs = kpt.nearest_references(player_feet(v), points(v), 4, "ax", "ay")
    flat = refs.select("match_id", "seq", F.posexplode(F.arrays_zip("refs", "weights")).alias("rank", "r"))
    return flat.select("match_id", "seq", "rank", F.col("r.refs.name").alias("name"), R("r.refs.dist").alias("dist"),
                       R(F.col("r.weights") * 1e6).alias("weight_ppm"))


@query("A34_local_scale", "SELECT match_id, seq, round(scale, 6) AS scale FROM scales")
def _(v):
    refs = kpt.nearest_references(player_feet(v), points(v), 4, "ax", "ay")
    return kpt.local_scale(refs).select("match_id", "seq", R("scale").alias("scale"))


@query("G3_triangulate", """SELECT r.match_id, r.seq, CASE WHEN total >= 2 THEN round(greatest(0, least(105, PX + (ax - x) / scale)), 6) END AS field_x,
    CASE WHEN total >= 2 THEN round(greatest(0, least(68, PY - (ay - y) / scale)), 6) END AS field_y FROM refs r JOIN scales s USING (match_id, seq) WHERE rnk = 1""")
def _(v):
    refs = kpt.nearest_references(player_feet(v), points(v), 4, "ax", "ay")
    out = kpt.triangulate(kpt.local_scale(refs), "ax", "ay")
    return out.select("match_id", "seq", R("field_x").alias("field_x"), R("field_y").alias("field_y"))


@query("J7_asof_keypoints", """WITH f AS (SELECT DISTINCT match_id, frame FROM kp), p AS (SELECT match_id, frame, count(*) AS n FROM pairs GROUP BY 1, 2 HAVING count(*) >= 9)
    SELECT f.match_id, f.frame, p.frame AS points_frame, p.n FROM f ASOF LEFT JOIN p ON f.match_id = p.match_id AND f.frame >= p.frame""")
def _(v):
    """A frame with fewer than nine points borrows those of the last one that has them."""
    frames = v.kp.select("match_id", "frame").distinct()
    held = kpt.last_valid_points(frames, points(v).filter(F.size("points") >= 9), block_frames=8)
    return held.select("match_id", "frame", "points_frame",
                       F.when(F.col("points").isNotNull(), F.size("points")).alias("n"))


_FIX_H = (0.0909, 0.0, -3.0, 0.0, -0.1, 75.0, 0.0, 0.0001, 1.0)
_PU = "(0.0909::DOUBLE * x - 3.0::DOUBLE) / (0.0001::DOUBLE * y + 1.0::DOUBLE)"
_PV = "(-0.1::DOUBLE * y + 75.0::DOUBLE) / (0.0001::DOUBLE * y + 1.0::DOUBLE)"


def fixed_h(df):
    return df.withColumns({n: F.lit(h) for n, h in zip(H_COLUMNS, _FIX_H)})


@query("J9_pair_geometry", f"""WITH p AS (SELECT *, {_PU} AS u, {_PV} AS v, count(*) OVER (PARTITION BY match_id, frame) AS n FROM pairs),
    e AS (SELECT a.match_id, a.frame, avg(abs(sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v))
        / sqrt((a.PX - b.PX) * (a.PX - b.PX) + (a.PY - b.PY) * (a.PY - b.PY)) - 1)) AS err
      FROM p a JOIN p b ON a.match_id = b.match_id AND a.frame = b.frame AND a.name < b.name GROUP BY 1, 2)
    SELECT f.match_id, f.frame, CASE WHEN f.n >= 3 THEN round(err, 6) ELSE 'infinity'::DOUBLE END AS geom_error
    FROM (SELECT match_id, frame, count(*) AS n FROM pairs GROUP BY 1, 2) f LEFT JOIN e USING (match_id, frame)""")
def _(v):
    out = kpt.pair_geometry(fixed_h(points(v)))
    inf = F.lit(float("inf"))
    return out.select("match_id", "frame", F.when(F.col("geom_error") == inf, inf).otherwise(R("geom_error")).alias("geom_error"))


@query("A25_keypoint_mean", """SELECT match_id, name, seq, round(avg(x) OVER w, 6) AS mean_x, round(avg(y) OVER w, 6) AS mean_y FROM kp
    WINDOW w AS (PARTITION BY match_id, name ORDER BY frame RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(v):
    out = kpt.keypoint_mean(v.kp, 5, size=16)
    return out.select("match_id", "name", "seq", R("mean_x").alias("mean_x"), R("mean_y").alias("mean_y"))


@query("A26_homography_rate", """SELECT match_id, count(*) AS frames, count(*) FILTER (conf >= 0.5) AS successes, count(*) FILTER (coalesce(flip_votes > votes / 2, false)) AS flips,
    round(count(*) FILTER (conf >= 0.5) / count(*), 6) AS success_rate FROM homs LEFT JOIN (SELECT match_id, frame, flip_votes, votes::DOUBLE AS votes FROM flips) f USING (match_id, frame) GROUP BY 1""")
def _(v):
    flips = kpt.orientation_votes(points(v)).select("match_id", "frame", "flip")
    rows = homs(v).join(flips, ["match_id", "frame"], "left").select(
        "match_id", (F.col("conf") >= 0.5).alias("ok"), F.coalesce("flip", F.lit(False)).alias("flip"))
    return kpt.homography_rate(rows).withColumn("success_rate", R("success_rate"))


@query("A27_reprojection_error", f"""WITH d AS (SELECT match_id, frame, sqrt(({_PU} - PX) * ({_PU} - PX) + ({_PV} - PY) * ({_PV} - PY)) AS d FROM pairs)
    SELECT match_id, frame, count(*) FILTER (d <= 15) AS inliers, count(*) AS points, round(avg(d) FILTER (d <= 15), 6) AS error,
      coalesce(avg(d) FILTER (d <= 15) <= 8, false) AS ok FROM d GROUP BY 1, 2""")
def _(v):
    return kpt.reprojection_error(fixed_h(pairs(v)), reject=8.0, inlier=15.0).withColumn("error", R("error"))


@query("A33_orientation_vote", "SELECT match_id, frame, votes, flip_votes, flip_votes > votes / 2.0 AS flip FROM flips")
def _(v):
    return kpt.orientation_votes(points(v)).select("match_id", "frame", "votes", "flip_votes", "flip")


_W5 = "(PARTITION BY match_id ORDER BY frame ROWS 4 PRECEDING)"


@query("E8_weighted_homography", "WITH g AS (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS rn, "
       + ", ".join(f"{n} AS raw_{n}, sum(conf * {n}) OVER {_W5} / sum(conf) OVER {_W5} AS {n}" for n in H_COLUMNS) + " FROM homs WHERE conf >= 0.6), "
       + "s AS (SELECT match_id, frame AS h_frame, " + ", ".join(f"CASE WHEN rn = 1 THEN raw_{n} ELSE {n} / h22 END AS {n}" for n in H_COLUMNS) + " FROM g) "
       + f"SELECT f.match_id, f.frame, h_frame, {_RH} FROM (SELECT match_id, frame FROM homs) f ASOF LEFT JOIN s ON s.match_id = f.match_id AND f.frame >= s.h_frame")
def _(v):
    return rh(kpt.weighted_homography(homs(v), 5, 0.6, block_frames=16, halo_size=8), "match_id", "frame", "h_frame")


@query("E9_mean_homography", "SELECT match_id, frame, " + ", ".join(f"round(avg({n}) OVER {_W5}, 6) AS {n}" for n in H_COLUMNS)
       + " FROM homs WHERE conf >= 0.5")
def _(v):
    return rh(kpt.mean_homography(homs(v).filter("conf >= 0.5"), 5, block_frames=16, halo_size=8), "match_id", "frame")


@query("E10_consistent_motion", """SELECT match_id, frame, seq, coalesce(count(*) OVER w = 5 AND sum((k % 3 <> 0)::INT) OVER w >= 3.5, false) AS consistent FROM obs
    WINDOW w AS (PARTITION BY match_id ORDER BY frame, seq ROWS 4 PRECEDING)""")
def _(v):
    flags = v.obs.select("match_id", "frame", "seq", (F.col("k") % 3 != 0).alias("moving"))
    return kpt.consistent_motion(flags, halo_size=256).drop("moving")


@query("E17_keypoint_memory", """WITH u AS (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS u FROM (SELECT DISTINCT match_id, frame FROM seen)),
    g AS (SELECT u.match_id, u.frame, u.u, n.name, s.x, s.y FROM u CROSS JOIN (SELECT name FROM points) n
      LEFT JOIN seen s ON s.match_id = u.match_id AND s.frame = u.frame AND s.name = n.name),
    l AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN u END IGNORE NULLS) OVER w AS lu, last_value(x IGNORE NULLS) OVER w AS lx,
      last_value(y IGNORE NULLS) OVER w AS ly FROM g WINDOW w AS (PARTITION BY match_id, name ORDER BY frame ROWS UNBOUNDED PRECEDING))
    SELECT match_id, frame, name, round(lx, 6) AS x, round(ly, 6) AS y, u - lu AS age FROM l WHERE u - lu <= 4""")
def _(v):
    out = kpt.keypoint_memory(v.seen, POINT_NAMES, max_age=4, block_frames=16)
    return out.select("match_id", "frame", "name", R("x").alias("x"), R("y").alias("y"), "age")


@query("E18_best_of_batch", f"""SELECT a.match_id, a.frame, a.frame // 10 AS batch_idx, b.frame AS best_frame, {', '.join(f'round(b.{n}, 6) AS {n}' for n in H_COLUMNS)}
    FROM homs a JOIN homs b ON a.match_id = b.match_id AND a.frame // 10 = b.frame // 10 AND b.frame <= a.frame
    QUALIFY row_number() OVER (PARTITION BY a.match_id, a.frame ORDER BY b.num_keypoints DESC, b.frame) = 1""")
def _(v):
    return rh(kpt.best_of_batch(homs(v), 10), "match_id", "frame", "batch_idx", "best_frame")


@query("ST12_calibration_state", f"""SELECT f.match_id, f.frame, h_frame, {_RH} FROM (SELECT match_id, frame FROM homs) f
    ASOF LEFT JOIN (SELECT match_id, frame AS h_frame, {', '.join(H_COLUMNS)} FROM homs WHERE conf >= 0.7) s ON s.match_id = f.match_id AND f.frame >= s.h_frame""")
def _(v):
    h = homs(v)
    out = kpt.carry_homography(h.select("match_id", "frame"), h.filter("conf >= 0.7").select("match_id", "frame", *H_COLUMNS), 16)
    return rh(out, "match_id", "frame", "h_frame")


_W = "(h20 * ax + h21 * ay + h22)"
CTES["projected"] = f"""SELECT p.match_id, p.seq, p.frame, (h00 * ax + h01 * ay + h02) / {_W} AS fx, (h10 * ax + h11 * ay + h12) / {_W} AS fy
    FROM plink p LEFT JOIN homs h ON h.match_id = p.match_id AND h.frame = p.frame"""


def projected(v):
    return kpt.project_rows(player_feet(v), homs(v), "ax", "ay")


@query("P21_project_point", "SELECT match_id, seq, round(fx, 6) AS field_x, round(fy, 6) AS field_y FROM projected")
def _(v):
    return projected(v).select("match_id", "seq", R("field_x").alias("field_x"), R("field_y").alias("field_y"))


@query("P22_unproject_point", "SELECT match_id, seq, round(ax, 4) AS ax, round(ay, 4) AS ay FROM plink JOIN homs USING (match_id, frame)")
def _(v):
    h = homs(v)
    rows = kpt.project_rows(player_feet(v), h, "ax", "ay").join(h, ["match_id", "frame"])
    x, y = fn.unproject("field_x", "field_y")
    return rows.select("match_id", "seq", R(x, 4).alias("ax"), R(y, 4).alias("ay"))


@query("J11_projection_fallback", """WITH f AS (SELECT match_id, seq, X AS bx, Y AS by_ FROM players WHERE conf > 0.5)
    SELECT p.match_id, p.seq, CASE WHEN fx BETWEEN 0 AND 105 AND fy BETWEEN 0 AND 68 THEN 1.0 WHEN bx IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS conf_out,
      round(CASE WHEN fx BETWEEN 0 AND 105 AND fy BETWEEN 0 AND 68 THEN fx ELSE bx END, 6) AS out_x,
      round(CASE WHEN fx BETWEEN 0 AND 105 AND fy BETWEEN 0 AND 68 THEN fy ELSE by_ END, 6) AS out_y
    FROM projected p LEFT JOIN f ON f.match_id = p.match_id AND f.seq = p.seq""")
def _(v):
    spare = v.players.filter("conf > 0.5").select("match_id", "seq", F.col("X").alias("fb_x"), F.col("Y").alias("fb_y"))
    out = kpt.with_fallback(projected(v), spare, ["match_id", "seq"])
    return out.select("match_id", "seq", "conf_out", R("out_x").alias("out_x"), R("out_y").alias("out_y"))


def fits(v):
    return v.once("fits", lambda: kpt.fit_homographies(points(v)))


@query("G1_fit_homography")
def _(v):
    return kpt.fit_homographies(points(v), resolve_flip=False)


@query("G2_homography_with_flip")
def _(v):
    return fits(v)


@query("A39_calibration_info")
def _(v):
    return kpt.calibration_info(fits(v))


@query("J14_projection_priority")
def _(v):
    """Own frame 1.0, best of the batch 0.85, triangulation 0.55, carried position at 0.4 of its confidence."""
    from ..operators import tracks
    f = fits(v).withColumn("num_keypoints", F.col("num_points")).select(
        "match_id", "frame", "num_keypoints", "flip", *H_COLUMNS)
    feet, keys = player_feet(v), ["match_id", "seq"]
    own = kpt.project_rows(feet, f, "ax", "ay")
    batch = kpt.project_rows(feet, kpt.best_of_batch(f, 10), "ax", "ay")
    tri = kpt.triangulate(kpt.local_scale(kpt.nearest_references(
        feet, kpt.orientation_votes(points(v)), 4, "ax", "ay", keep=("flip",))), "ax", "ay", flip=F.col("flip"))
    carried = tracks.gap_fill(v.players.filter("conf > 0.5").select(
        "match_id", "track_id", F.expr("frame div 3").alias("frame"), "seq", F.col("X").alias("x"), F.col("Y").alias("y")),
        feet.select("match_id", "track_id", "frame", "seq")).select(
        "match_id", "seq", F.col("x").alias("field_x"), F.col("y").alias("field_y"), "flow_conf")
    out = kpt.by_priority(feet, [(own, 1.0), (batch, 0.85), (tri, 0.55),
                                 (carried, F.col("flow_conf") * 0.4)], keys)
    return out.select("match_id", "seq", R("out_x").alias("out_x"), R("out_y").alias("out_y"), "out_conf")


@query("J10_line_crossings", """WITH j AS (SELECT h.match_id, h.frame, h.seq AS h_seq, v.seq AS v_seq, h.x1, h.y1, h.x2, h.y2, v.x1 AS x3, v.y1 AS y3, v.x2 AS x4, v.y2 AS y4,
        (h.x1 - h.x2) * (v.y1 - v.y2) - (h.y1 - h.y2) * (v.x1 - v.x2) AS den
      FROM lorient h JOIN lorient v ON h.match_id = v.match_id AND h.frame = v.frame AND h.orientation = 'horizontal' AND v.orientation = 'vertical'),
    t AS (SELECT *, ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / den AS t, -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / den AS u FROM j WHERE abs(den) >= 1e-10)
    SELECT match_id, frame, h_seq, v_seq, round(x1 + t * (x2 - x1), 6) AS x, round(y1 + t * (y2 - y1), 6) AS y FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def _(v):
    segs = v.lines.withColumn("orientation", fn.angle_class(fn.segment_geometry()["angle"]))
    out = kpt.line_crossings(segs)
    return out.select("match_id", "frame", "h_seq", "v_seq", R("x").alias("x"), R("y").alias("y"))


_ENDS = "list_sort([" + ", ".join(f"{{'along': CASE WHEN flat THEN {s}x{i} ELSE {s}y{i} END, 'x': {s}x{i}, 'y': {s}y{i}}}" for s in ("", "n") for i in (1, 2)) + "])"
CTES.update({
    "lrow": """SELECT *, row_number() OVER (PARTITION BY match_id, frame, orientation ORDER BY CASE WHEN flat THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END, seq) AS rn
        FROM (SELECT match_id, frame, seq, orientation, x1, y1, x2, y2, abs(avg(atan2(y2 - y1, x2 - x1)) OVER (PARTITION BY match_id, frame, orientation)) < pi() / 4 AS flat FROM lorient)""",
    "lmerge": f"""SELECT match_id, frame, orientation, rn, flat, 0 AS part, x1, y1, x2, y2 FROM lrow WHERE rn = 1
        UNION ALL SELECT match_id, frame, orientation, rn, flat, CASE WHEN near THEN part ELSE part + 1 END, CASE WHEN near THEN e[1].x ELSE nx1 END, CASE WHEN near THEN e[1].y ELSE ny1 END,
          CASE WHEN near THEN e[4].x ELSE nx2 END, CASE WHEN near THEN e[4].y ELSE ny2 END FROM (
          SELECT *, {_ENDS} AS e, pow((x1 + x2 - nx1 - nx2) / 2, 2) + pow((y1 + y2 - ny1 - ny2) / 2, 2) < pow(80, 2) AS near FROM (
            SELECT m.match_id, m.frame, m.orientation, n.rn, m.flat, m.part, m.x1, m.y1, m.x2, m.y2, n.x1 AS nx1, n.y1 AS ny1, n.x2 AS nx2, n.y2 AS ny2
            FROM lmerge m JOIN lrow n ON n.match_id = m.match_id AND n.frame = m.frame AND n.orientation = m.orientation AND n.rn = m.rn + 1))""",
})


@query("G4_merge_collinear", """SELECT match_id, frame, orientation, part, x1, y1, x2, y2 FROM lmerge
    QUALIFY row_number() OVER (PARTITION BY match_id, frame, orientation, part ORDER BY rn DESC) = 1""")
def _(v):
    segs = v.lines.withColumn("orientation", fn.angle_class(fn.segment_geometry()["angle"]))
    return kpt.merge_collinear(segs, 40.0)


@query("SO2_token_intersection", """SELECT name, len(list_intersect(string_split(name, '_'), ['top', 'bottom', 'area', 'inner', 'arc'])) AS shared, count(*) AS seen FROM kp GROUP BY 1""")
def _(v):
    some = F.array(*[F.lit(t) for t in ("top", "bottom", "area", "inner", "arc")])
    shared = F.size(F.array_intersect(F.split("name", "_"), some))
    return v.kp.groupBy("name", shared.alias("shared")).agg(F.count(F.lit(1)).alias("seen"))
