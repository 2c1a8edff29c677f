"""Tactics (A23, A24, E11, ST5, ST6, T1, T2, SO1, AL11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded as R
from ..operators import possession as po
from ..operators import spatial as sp
from ..operators import tactics as ta
from .registry import query
from .spatial_queries import placed
from .views import BATCH, CTES

ZONES = ("a", "b", "c", "d", "e")

CTES.update({
    "zrank": """SELECT *, sum(frames) OVER (PARTITION BY match_id, team) AS total,
        coalesce(sum(frames) OVER (PARTITION BY match_id, team ORDER BY frames DESC, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ztime""",
    "focus": """SELECT match_id, team, list(zone_id ORDER BY frames DESC, zone_id) AS zone_ids, list('Zone_' || zone_id ORDER BY frames DESC, zone_id) AS dominant_zones,
        sum(frames) / any_value(total) AS concentration FROM zrank WHERE total > 0 AND before / total < 0.60 GROUP BY 1, 2""",
    "pat": """SELECT *, CASE WHEN concentration > 0.70 THEN 'concentrated' WHEN concentration > 0.50 THEN 'focused' ELSE 'distributed' END AS pattern FROM focus""",
    "ev": """SELECT match_id, team, frame, seq, 'pass' AS type, (['a', 'b', 'c', 'd', 'e'])[to_player % 5 + 1] AS zone FROM pass
        UNION ALL SELECT match_id, from_team, frame, seq, 'possession_loss', NULL FROM chg""",
    "evn": """SELECT *, sum((type = 'possession_loss')::INT) OVER (PARTITION BY match_id, team ORDER BY frame, seq) AS chain FROM ev""",
    "losses": "SELECT match_id, team, frame, row_number() OVER (PARTITION BY match_id, team ORDER BY frame, seq) - 1 AS chain FROM ev WHERE type = 'possession_loss'",
    "zfirst": """SELECT match_id, team, chain, string_agg(zone, ',' ORDER BY frame, seq) AS zones FROM
        (SELECT * FROM evn WHERE type = 'pass' QUALIFY row_number() OVER (PARTITION BY match_id, team, chain, zone ORDER BY frame, seq) = 1) GROUP BY 1, 2, 3""",
    "chains": """SELECT c.match_id, c.team, c.chain, length, start_frame, end_frame, zones, l.frame AS closed_frame FROM
        (SELECT match_id, team, chain, count(*) AS length, min(frame) AS start_frame, max(frame) AS end_frame FROM evn WHERE type = 'pass' GROUP BY 1, 2, 3 HAVING count(*) >= 3) c
        JOIN zfirst z ON z.match_id = c.match_id AND z.team = c.team AND z.chain = c.chain
        LEFT JOIN losses l ON l.match_id = c.match_id AND l.team = c.team AND l.chain = c.chain""",
    "done": "SELECT * FROM chains WHERE closed_frame IS NOT NULL",
    "zgrid": f"""SELECT g.match_id, g.batch_idx, t.team, z.zone_id FROM (SELECT DISTINCT match_id, frame // {BATCH // 240} AS batch_idx FROM det) g
        CROSS JOIN (VALUES (0), (1)) t(team) CROSS JOIN (SELECT unnest(range(9)) AS zone_id) z""",
    "zcum": f"""SELECT g.match_id, g.batch_idx, g.team, g.zone_id, (g.batch_idx + 1) * {BATCH} AS frame,
        CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.match_id, g.team, g.zone_id ORDER BY g.batch_idx) AS BIGINT) AS frames FROM zgrid g
        LEFT JOIN (SELECT match_id, frame // {BATCH // 240} AS batch_idx, team, zone_id, count(*) AS n FROM placed GROUP BY ALL) c
        ON c.match_id = g.match_id AND c.batch_idx = g.batch_idx AND c.team = g.team AND c.zone_id = g.zone_id""",
})


def events(v):
    """Passes and changes with a stand-in zone per receiving player."""
    names = F.array(*[F.lit(z) for z in ZONES])
    made = po.match_events(v.frames, v.passed)
    return made.withColumn("zone", F.when(F.col("type") == "pass", F.get(names, (F.col("to_player") % 5).cast("int"))))


def chains(v):
    return v.once("chains", lambda: ta.passing_chains(v.once("events", lambda: events(v))))


def zones(v):
    return sp.zone_time(placed(v))


def zone_history(v):
    batch = F.expr(f"frame div {BATCH // 240}").alias("batch_idx")
    return v.once("zone_history", lambda: ta.cumulative_zones(
        placed(v).select("match_id", batch, "team", "zone_id"), v.det.select("match_id", batch), BATCH))


@query("A23_zone_focus", """SELECT match_id, team, array_to_string(dominant_zones, ',') AS dominant_zones, round(concentration, 6) AS concentration, pattern,
    (SELECT string_agg(CAST(CAST(round(frames * 100.0::DOUBLE / total, 3) AS DECIMAL(9,3)) AS VARCHAR), ',' ORDER BY zone_id) FROM zrank z WHERE z.match_id = pat.match_id AND z.team = pat.team) AS percents FROM pat""")
def _(v):
    f = ta.zone_focus(zones(v))
    text = F.array_join(F.transform("zone_details", lambda d: F.round(d["percent"], 3).cast("decimal(9,3)").cast("string")), ",")
    return f.select("match_id", "team", F.array_join("dominant_zones", ",").alias("dominant_zones"),
                    R("concentration").alias("concentration"), "pattern", text.alias("percents"))


@query("T1_top_zones", """SELECT match_id, team, zone_id, frames, row_number() OVER (PARTITION BY match_id, team ORDER BY frames DESC, zone_id) AS rank,
      round(frames * 100.0::DOUBLE / sum(frames) OVER (PARTITION BY match_id, team), 6) AS percent FROM ztime QUALIFY rank <= 3 AND frames > 0""")
def _(v):
    return ta.top_zones(zones(v)).withColumn("percent", R("percent"))


@query("T1_top_zones_of_match", """SELECT match_id, team, zone_id, frames, row_number() OVER (PARTITION BY match_id, team ORDER BY frames DESC, zone_id) AS rank,
      round(frames * 100.0::DOUBLE / sum(frames) OVER (PARTITION BY match_id), 6) AS percent FROM ztime QUALIFY rank <= 3 AND frames > 0""")
def _(v):
    return ta.top_zones(zones(v), of_match=True).withColumn("percent", R("percent"))


@query("match_events", """SELECT match_id, frame, seq, 'pass' AS type, round(frame / 30.0::DOUBLE, 6) AS timestamp, team, NULL AS from_team, NULL AS to_team, from_player, to_player FROM pass
    UNION ALL SELECT match_id, frame, seq, 'possession_change', round(frame / 30.0::DOUBLE, 6), NULL, from_team, to_team, NULL, player FROM chg
    UNION ALL SELECT match_id, frame, seq, 'possession_loss', round(frame / 30.0::DOUBLE, 6), from_team, NULL, NULL, NULL, NULL FROM chg""")
def _(v):
    return po.match_events(v.frames, v.passed).withColumn("timestamp", R("timestamp")).drop("zone")


@query("ST5_passing_chains", """SELECT match_id, team, chain, length, start_frame, end_frame, zones, closed_frame, round((end_frame - start_frame) / 30.0::DOUBLE, 6) AS duration FROM chains""")
def _(v):
    return chains(v).select("match_id", "team", "chain", "length", "start_frame", "end_frame",
                            F.array_join("zones", ",").alias("zones"), "closed_frame", R("duration").alias("duration"))


@query("ST6_active_chain", "SELECT match_id, team, chain, length, zones FROM chains WHERE closed_frame IS NULL")
def _(v):
    return ta.active_chain(chains(v)).select("match_id", "team", "chain", "length", F.array_join("zones", ",").alias("zones"))


@query("A24_chain_stats", """WITH l AS (SELECT match_id, team, string_agg(CAST(length AS VARCHAR), ',' ORDER BY chain) AS last_lengths FROM
      (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY match_id, team ORDER BY chain DESC) <= 5) GROUP BY 1, 2)
    SELECT match_id, team, count(*) AS total_chains, round(avg(length), 6) AS avg_length, max(length) AS max_length,
      round(avg((end_frame - start_frame) / 30.0::DOUBLE), 6) AS avg_duration, any_value(last_lengths) AS last_lengths FROM done JOIN l USING (match_id, team) GROUP BY 1, 2""")
def _(v):
    return ta.chain_stats(chains(v)).select("match_id", "team", "total_chains", R("avg_length").alias("avg_length"), "max_length",
                                            R("avg_duration").alias("avg_duration"), F.array_join("last_lengths", ",").alias("last_lengths"))


@query("T2_notable_chains", """SELECT match_id, team, chain, length, row_number() OVER (PARTITION BY match_id, team ORDER BY length DESC, chain) AS rank
    FROM done WHERE length >= 5 QUALIFY rank <= 3""")
def _(v):
    return ta.notable_chains(chains(v)).select("match_id", "team", "chain", "length", "rank")


_FOCUS_AT = """zr AS (SELECT *, sum(frames) OVER (PARTITION BY match_id, frame, team) AS total,
      coalesce(sum(frames) OVER (PARTITION BY match_id, frame, team ORDER BY frames DESC, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {src}),
    fo AS (SELECT match_id, frame, team, list('Zone_' || zone_id ORDER BY frames DESC, zone_id) AS dz, sum(frames) / any_value(total) AS concentration
      FROM zr WHERE total > 0 AND before / total < 0.60 GROUP BY 1, 2, 3),
    sh AS (SELECT *, lag(dz) OVER (PARTITION BY match_id, team ORDER BY frame) AS pz FROM fo),
    sx AS (SELECT match_id, frame, team, list_sort(list_filter(dz, lambda z: NOT list_contains(pz, z))) AS nz, list_sort(list_filter(pz, lambda z: NOT list_contains(dz, z))) AS lz FROM sh WHERE pz IS NOT NULL)"""


@query("E11_zone_shift", f"""WITH {_FOCUS_AT.format(src='zcum')}
    SELECT match_id, frame, team, array_to_string(nz, ',') AS new_zones, array_to_string(lz, ',') AS lost_zones, len(nz) + len(lz) > 0 AS shifted FROM sx""")
def _(v):
    focus = ta.zone_focus(zone_history(v), keys=("match_id", "frame", "team"))
    out = ta.zone_shift(focus)
    return out.select("match_id", "frame", "team", F.array_join("new_zones", ",").alias("new_zones"),
                      F.array_join("lost_zones", ",").alias("lost_zones"), "shifted")


@query("SO1_array_difference", """WITH g AS (SELECT match_id, frame, list(DISTINCT name) AS names FROM kp GROUP BY 1, 2),
    p AS (SELECT *, lag(names) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM g)
    SELECT match_id, frame, array_to_string(list_sort(list_filter(names, lambda z: NOT list_contains(prev, z))), ',') AS gained,
      array_to_string(list_sort(list_filter(prev, lambda z: NOT list_contains(names, z))), ',') AS lost FROM p WHERE prev IS NOT NULL""")
def _(v):
    from ..operators import scan
    sets = v.kp.groupBy("match_id", "frame").agg(F.collect_set("name").alias("names"))
    prev = scan.prefix_scan(sets, ["match_id"], ["frame"], scan.block_of("frame", 16), {"prev": scan.previous("names")})
    diff = lambda a, b: F.array_join(F.sort_array(F.array_except(a, b)), ",")
    return prev.filter("prev is not null").select("match_id", "frame", diff("names", "prev").alias("gained"), diff("prev", "names").alias("lost"))


def shares(v):
    return po.possession_stats(v.frames).select("match_id", "team", "percent")


@query("AL11_insights", """WITH n AS (SELECT match_id, team, avg(length) AS a, string_agg(CAST(length AS VARCHAR), ',' ORDER BY length DESC, chain) FILTER (r <= 3) AS lens
      FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY length DESC, chain) AS r FROM done WHERE length >= 4) GROUP BY 1, 2),
    st AS (SELECT match_id, team, count(*) AS total_chains, max(length) AS max_length FROM done GROUP BY 1, 2),
    ac AS (SELECT match_id, team, max(length) AS active_length FROM chains WHERE closed_frame IS NULL GROUP BY 1, 2),
    s AS (SELECT match_id, team, CASE WHEN total_frames > 0 THEN frames * 100.0::DOUBLE / total_frames ELSE 0 END AS percent FROM stats)
    SELECT s.match_id, s.team, round(percent, 6) AS percent, array_to_string(dominant_zones, ',') AS dominant_zones, pattern, active_length, lens AS notable_lengths, total_chains, max_length,
      coalesce(nullif(concat_ws('; ', CASE WHEN len(dominant_zones) > 0 THEN 'Active in ' || array_to_string(dominant_zones[1:3], ', ') END,
        CASE WHEN a >= 5 THEN 'Long passing chains' WHEN a IS NOT NULL THEN 'Brief passing chains' END,
        CASE WHEN percent >= 60 THEN 'Mostly on the ball' WHEN percent <= 40 THEN 'Mostly off the ball' END), ''), 'No clear style') AS style
    FROM s LEFT JOIN pat p ON p.match_id = s.match_id AND p.team = s.team LEFT JOIN n ON n.match_id = s.match_id AND n.team = s.team
      LEFT JOIN st ON st.match_id = s.match_id AND st.team = s.team LEFT JOIN ac ON ac.match_id = s.match_id AND ac.team = s.team""")
def _(v):
    out = ta.insights(ta.zone_focus(zones(v)), chains(v), shares(v))
    return out.select("match_id", "team", R("percent").alias("percent"), F.array_join("dominant_zones", ",").alias("dominant_zones"), "pattern",
                      "active_length", F.array_join("notable_lengths", ",").alias("notable_lengths"), "total_chains", "max_length", "style")
