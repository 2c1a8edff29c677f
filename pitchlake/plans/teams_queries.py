"""Colours and team assignment (P25-P28, A16-A22, E14, E15, ST14, ST15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.columns import rounded as R
from ..operators import machine
from ..operators import teams as tm
from .registry import query
from .views import CTES

CH = tm.COLOUR


def _rounds(n: int) -> None:
    """CTEs of the two-means iteration over the track medians."""
    sq = lambda p: " + ".join(f"(m.{c} - {p}{c}) * (m.{c} - {p}{c})" for c in CH)
    CTES["seed0"] = "SELECT match_id, " + ", ".join(f"{c} AS c0_{c}" for c in CH) + " FROM meds QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY track_id) = 1"
    CTES["cen0"] = (f"SELECT m.match_id, " + ", ".join(f"c0_{c}" for c in CH) + ", " + ", ".join(f"m.{c} AS c1_{c}" for c in CH)
                    + f", false AS stopped FROM meds m JOIN seed0 s ON s.match_id = m.match_id QUALIFY row_number() OVER (PARTITION BY m.match_id ORDER BY {sq('c0_')} DESC, m.track_id) = 1")
    for i in range(n):
        one = f"({sq('c1_')}) < ({sq('c0_')})"
        CTES[f"lab{i + 1}"] = f"SELECT m.*, c.* EXCLUDE (match_id), {one} AS one FROM meds m JOIN cen{i} c ON c.match_id = m.match_id"
        agg = ", ".join(f"CASE WHEN any_value(stopped) OR count(*) FILTER (one) IN (0, count(*)) THEN any_value(c{j}_{c}) ELSE avg({c}) FILTER ({'' if j else 'NOT '}one) END AS c{j}_{c}"
                        for j in (0, 1) for c in CH)
        CTES[f"cen{i + 1}"] = f"SELECT match_id, {agg}, any_value(stopped) OR count(*) FILTER (one) IN (0, count(*)) AS stopped FROM lab{i + 1} GROUP BY 1"


CTES["meds0"] = """SELECT match_id, track_id, count(*) AS samples, median(L) AS L, median(a) AS a, median(b) AS b
    FROM (SELECT * FROM colour QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY seq DESC) <= 4) GROUP BY 1, 2 HAVING count(*) >= 2"""
CTES["meds"] = "SELECT * FROM meds0 QUALIFY count(*) OVER (PARTITION BY match_id) >= 12"
_rounds(10)
CTES["mapped"] = "SELECT match_id, c1_L < c0_L AS swapped, " + ", ".join(
    f"CASE WHEN c1_L < c0_L THEN c{1 - i}_{c} ELSE c{i}_{c} END AS c{i}_{c}" for i in (0, 1) for c in CH) + " FROM cen10"
_D = {i: "sqrt(" + " + ".join(f"(s.{c} - c{i}_{c}) * (s.{c} - c{i}_{c})" for c in CH) + ")" for i in (0, 1)}
CTES["voted"] = f"SELECT s.match_id, s.track_id, s.seq, {_D[0]} AS d0, {_D[1]} AS d1, CASE WHEN {_D[0]} <= {_D[1]} THEN 0 ELSE 1 END AS team FROM colour s JOIN mapped m ON m.match_id = s.match_id"


def medians(v):
    return tm.track_medians(v.colour, last=4)


def centres(v):
    return v.once("centres", lambda: tm.two_means(v.once("medians", lambda: medians(v)), "track_id"))


def mapped(v):
    return tm.darker_first(centres(v))


def voted(v):
    return tm.nearest_centre(v.colour.select("match_id", "track_id", "seq", *CH), mapped(v).drop("swapped"))


@query("P25_chroma", """SELECT seq, round(sqrt(a * a + b * b), 6) AS plain, round(sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)), 6) AS centred FROM colour""")
def _(v):
    return v.colour.select("seq", R(fn.chroma("a", "b")).alias("plain"), R(fn.chroma("a", "b", True)).alias("centred"))


@query("P26_referee_rule", """SELECT seq, class_id = 2 OR (L < 80 AND sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) < 30) OR (H BETWEEN 20 AND 60 AND S >= 150) AS referee FROM colour""")
def _(v):
    return v.colour.select("seq", fn.referee_by_colour("L", "a", "b", "H", "S", "class_id").alias("referee"))


@query("P27_referee_rule_hsv", "SELECT seq, (V < 45 AND S < 60) OR (H BETWEEN 25 AND 55 AND S > 150 AND V > 120) AS referee FROM colour")
def _(v):
    return v.colour.select("seq", fn.referee_by_hsv("H", "S", "V").alias("referee"))


@query("P28_colour_sample_gates", """SELECT seq, sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) >= 30 AND area_ratio >= 0.002 AS lab_ok, S >= 20 AND V >= 30 AS hsv_ok,
    CASE WHEN area_ratio >= 0.005 THEN true WHEN sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) >= 20
      THEN seq % 2 = 0 OR sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) >= 30 ELSE seq % 3 = 0 END AS seed_ok FROM colour""")
def _(v):
    a, b = F.col("a") - 128.0, F.col("b") - 128.0
    seed = fn.seed_sample_ok("area_ratio", fn.chroma(a, b), F.col("seq") % 2 != 0, F.col("seq") % 3 == 0,
                             area_seed=0.005, min_chroma=20.0)
    return v.colour.select("seq", fn.colour_sample_ok(a, b, "area_ratio", 30.0).alias("lab_ok"),
                           fn.hsv_sample_ok("S", "V").alias("hsv_ok"), seed.alias("seed_ok"))


@query("A16_track_medians", "SELECT match_id, track_id, samples, round(L, 6) AS L, round(a, 6) AS a, round(b, 6) AS b FROM meds")
def _(v):
    return medians(v).select("match_id", "track_id", "samples", *[R(c).alias(c) for c in CH])


_D = {i: " + ".join(f"({c} - c{i}_{c}) * ({c} - c{i}_{c})" for c in CH) for i in (0, 1)}


@query("A17_team_kmeans", f"SELECT match_id, track_id, CASE WHEN sqrt({_D[0]}) <= sqrt({_D[1]}) THEN 0 ELSE 1 END AS cluster FROM meds JOIN cen10 USING (match_id)")
def _(v):
    return tm.match_kmeans(medians(v))


_NAMES = [f"c{i}_{c}" for i in (0, 1) for c in CH]
_RN = ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)


@query("A18_two_means", f"SELECT match_id, {_RN} FROM cen10")
def _(v):
    return centres(v).select("match_id", *[R(n).alias(n) for n in _NAMES])


@query("A19_cluster_to_team", f"SELECT match_id, swapped, {_RN} FROM mapped")
def _(v):
    return mapped(v).select("match_id", "swapped", *[R(n).alias(n) for n in _NAMES])


@query("A19_side_mapping", """WITH m AS (SELECT match_id, avg(seq % 13) FILTER (team = 0) AS x0, avg(seq % 13) FILTER (team = 1) AS x1 FROM voted GROUP BY 1)
    SELECT match_id, round(x0, 6) AS x0, round(x1, 6) AS x1, CASE WHEN x1 < x0 THEN 1 ELSE 0 END AS team_of_0 FROM m""")
def _(v):
    rows = voted(v).select("match_id", F.col("team").alias("cluster"), (F.col("seq") % 13).alias("cx"))
    return tm.side_mapping(rows).withColumns({"x0": R("x0"), "x1": R("x1")})


@query("A20_cluster_separation", "SELECT match_id, round(sqrt(" + " + ".join(f"(c0_{c} - c1_{c}) * (c0_{c} - c1_{c})" for c in CH)
       + "), 6) AS distance, sqrt(" + " + ".join(f"(c0_{c} - c1_{c}) * (c0_{c} - c1_{c})" for c in CH) + ") >= 15 AS separated FROM cen10")
def _(v):
    return tm.separation(centres(v)).withColumn("distance", R("distance"))


@query("A21_nearest_centroid", "SELECT match_id, seq, round(d0, 6) AS d0, round(d1, 6) AS d1, CASE WHEN least(d0, d1) > 45 THEN -1 ELSE team END AS team FROM voted")
def _(v):
    out = tm.nearest_centre(v.colour.select("match_id", "seq", *CH), mapped(v).drop("swapped"), limit=45.0)
    return out.select("match_id", "seq", R("d0").alias("d0"), R("d1").alias("d1"), "team")


@query("A22_team_distribution", """WITH t AS (SELECT match_id, track_id, max(CASE WHEN seq % 7 = 0 THEN -1 ELSE team END) AS team FROM voted GROUP BY 1, 2)
    SELECT match_id, team, count(*) AS players FROM t GROUP BY 1, 2""")
def _(v):
    each = voted(v).withColumn("team", F.when(F.col("seq") % 7 == 0, -1).otherwise(F.col("team")))
    return tm.team_distribution(each.groupBy("match_id", "track_id").agg(F.max("team").alias("team")))


@query("E14_sample_throttle", """SELECT match_id, track_id, seq FROM det QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY seq) % 5 = 0""")
def _(v):
    return tm.throttle(v.det.select("match_id", "track_id", "seq"), 5, block=512)


@query("E15_vote_majority", """WITH p AS (SELECT match_id, track_id, seq, row_number() OVER w AS rn, sum((seq % 3 = 0)::INT) OVER w5 AS n1, sum((seq % 3 <> 0)::INT) OVER w5 AS n0
      FROM det WINDOW w AS (PARTITION BY match_id, track_id ORDER BY seq), w5 AS (PARTITION BY match_id, track_id ORDER BY seq ROWS 3 PRECEDING)),
    c AS (SELECT *, CASE WHEN rn >= 4 THEN CASE WHEN n0 > n1 THEN 0 WHEN n1 > n0 THEN 1 END END AS ch FROM p)
    SELECT match_id, track_id, seq, last_value(ch IGNORE NULLS) OVER (PARTITION BY match_id, track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS confirmed FROM c""")
def _(v):
    votes = v.det.select("match_id", "track_id", "seq", (F.col("seq") % 3 == 0).cast("int").alias("team"))
    return tm.vote_majority(votes, history=4, block=512, halo_size=16).drop("team")


@query("E15_vote_majority_early", """WITH p AS (SELECT match_id, track_id, seq, row_number() OVER w AS rn, sum((seq % 3 = 0)::INT) OVER w5 AS n1, sum((seq % 3 <> 0)::INT) OVER w5 AS n0
      FROM det WINDOW w AS (PARTITION BY match_id, track_id ORDER BY seq), w5 AS (PARTITION BY match_id, track_id ORDER BY seq ROWS 3 PRECEDING))
    SELECT match_id, track_id, seq, CASE WHEN rn >= 2 THEN CASE WHEN n1 > n0 THEN 1 ELSE 0 END END AS confirmed FROM p""")
def _(v):
    votes = v.det.select("match_id", "track_id", "seq", (F.col("seq") % 3 == 0).cast("int").alias("team"))
    return tm.vote_majority(votes, history=4, needed=2, keep_on_tie=False, block=512).drop("team")


CTES["hold0"] = "SELECT match_id, track_id, seq, team, d0, d1, row_number() OVER (PARTITION BY match_id, track_id ORDER BY seq) AS rn FROM voted"


@query("ST14_team_hold", """WITH RECURSIVE h AS (SELECT match_id, track_id, seq, rn, CASE WHEN team IN (0, 1) THEN team END AS held, CASE WHEN team IN (0, 1) THEN seq END AS since FROM hold0 WHERE rn = 1
      UNION ALL SELECT match_id, track_id, seq, rn, CASE WHEN moves THEN team ELSE held END, CASE WHEN moves THEN seq ELSE since END FROM (
        SELECT e.*, h.held, h.since, e.team IN (0, 1) AND e.team IS DISTINCT FROM h.held AND (h.held IS NULL OR e.seq - h.since >= 12
          OR CASE e.team WHEN 0 THEN e.d0 ELSE e.d1 END < 0.85::DOUBLE * CASE h.held WHEN 0 THEN e.d0 ELSE e.d1 END) AS moves
        FROM h JOIN hold0 e ON e.match_id = h.match_id AND e.track_id = h.track_id AND e.rn = h.rn + 1))
    SELECT match_id, track_id, seq AS frame, seq, held AS held_team FROM h""")
def _(v):
    rows = voted(v).withColumn("frame", F.col("seq"))
    return machine.hold_team(rows.select("match_id", "track_id", "frame", "seq", "team", "d0", "d1"), block_rows=16)


CTES["drift0"] = "SELECT match_id, seq, L, a, b, row_number() OVER (PARTITION BY match_id ORDER BY seq) AS rn FROM colour"
_START = {0: (90.0, 120.0, 120.0), 1: (110.0, 135.0, 135.0)}
_OLD = {i: ", ".join(f"h.c{i}_{c}" for c in CH) for i in (0, 1)}
_FIRST = ", ".join(f"{x}::DOUBLE AS c{i}_{c}" for i in (0, 1) for c, x in zip(CH, _START[i]))
_FAR = {i: "sqrt(" + " + ".join(f"(e.{c} - h.c{i}_{c}) * (e.{c} - h.c{i}_{c})" for c in CH) + ")" for i in (0, 1)}
_MOVED = ", ".join(f"CASE WHEN pick = {i} THEN 0.8::DOUBLE * c{i}_{c} + 0.2::DOUBLE * {c} ELSE c{i}_{c} END" for i in (0, 1) for c in CH)


@query("ST15_centroid_update", f"""WITH RECURSIVE h AS (SELECT DISTINCT match_id, 0::BIGINT AS seq, 0::BIGINT AS rn, 0 AS pick, {_FIRST} FROM drift0
      UNION ALL SELECT match_id, seq, rn, pick, {_MOVED} FROM (SELECT *, CASE WHEN least(f0, f1) > 60 THEN -1 WHEN f0 <= f1 THEN 0 ELSE 1 END AS pick FROM (
        SELECT e.*, {_OLD[0]}, {_OLD[1]}, {_FAR[0]} AS f0, {_FAR[1]} AS f1 FROM h JOIN drift0 e ON e.match_id = h.match_id AND e.rn = h.rn + 1)))
    SELECT match_id, seq, pick::BIGINT AS team FROM h WHERE rn > 0""")
def _(v):
    return machine.drifting_centroids(v.colour.select("match_id", "seq", *CH), ((90.0, 120.0, 120.0), (110.0, 135.0, 135.0)), limit=60.0, block_rows=40)
