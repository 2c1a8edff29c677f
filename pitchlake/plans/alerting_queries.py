"""Alerts (AL1-AL10, AL12, E12, J13, A35, T6, P30, ST9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded as R
from ..operators import alerts as al
from ..operators import machine
from ..operators import tactics as ta
from . import tactics_queries as tq
from .registry import query
from .views import CTES

GATE = 1800  # one minute at 30 frames per second

CTES.update({
    "ends": "SELECT DISTINCT match_id, frame FROM cum",
    "chk": f"""SELECT match_id, min(frame) FILTER (frame >= {GATE}) AS frame FROM ends GROUP BY 1
        UNION ALL SELECT match_id, nf FROM (SELECT c.match_id, (SELECT min(e.frame) FROM ends e WHERE e.match_id = c.match_id AND e.frame >= c.frame + {GATE}) AS nf FROM chk c) WHERE nf IS NOT NULL""",
    "chw": """SELECT match_id, frame, sum(frames) FILTER (team = 0) AS frames_0, sum(frames) FILTER (team = 1) AS frames_1, sum(passes) FILTER (team = 0) AS passes_0,
        sum(passes) FILTER (team = 1) AS passes_1, max(changes) AS changes FROM cum GROUP BY 1, 2""",
    "chp": """SELECT w.*, frames_0 + frames_1 AS total_frames, frames_0 * 100.0::DOUBLE / (frames_0 + frames_1) AS percent_0, frames_1 * 100.0::DOUBLE / (frames_0 + frames_1) AS percent_1
        FROM chw w JOIN (SELECT match_id, frame FROM chk) c ON c.match_id = w.match_id AND c.frame = w.frame WHERE frames_0 + frames_1 > 0""",
    "checks": """SELECT *, row_number() OVER w AS n, lag(percent_0) OVER w AS pp0, lag(percent_1) OVER w AS pp1 FROM chp WINDOW w AS (PARTITION BY match_id ORDER BY frame)""",
    "past": f"""SELECT c.match_id, c.frame, c.n, c.passes_0, c.passes_1, p.passes_0 AS past_0, p.passes_1 AS past_1 FROM checks c
        ASOF LEFT JOIN checks p ON p.match_id = c.match_id AND c.frame - 900 >= p.frame""",
    "zchk": "SELECT z.* FROM zcum z JOIN (SELECT match_id, frame FROM chp) c ON c.match_id = z.match_id AND c.frame = z.frame",
    "chkside": """SELECT match_id, frame, n, 0 AS team, percent_0 AS pct, percent_1 AS rival, pp0 AS before FROM checks
        UNION ALL SELECT match_id, frame, n, 1, percent_1, percent_0, pp1 FROM checks""",
})


def checks(v):
    return v.once("checks", lambda: al.check_table(v.progress, GATE))


def zones_at(v, c):
    return tq.zone_history(v).join(c.select("match_id", "frame"), ["match_id", "frame"], "left_semi")


@query("alert_gate", "SELECT match_id, frame, frames_0, frames_1, passes_0, passes_1, changes, n AS check FROM checks")
def _(v):
    return checks(v).select("match_id", "frame", "frames_0", "frames_1", "passes_0", "passes_1", "changes", "check")


@query("AL1_dominance", """SELECT match_id, frame, team, CASE WHEN pct >= 75 THEN 'warning' ELSE 'info' END AS severity, round(pct, 6) AS pct, round(pct - rival, 6) AS difference
    FROM chkside WHERE pct >= 55 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1""")
def _(v):
    return al.dominance(checks(v), 55.0).select("match_id", "frame", "team", "severity", R("pct").alias("pct"), R("difference").alias("difference"))


@query("J13_asof_lookback", "SELECT match_id, frame, past_0 AS past_passes_0, past_1 AS past_passes_1 FROM past")
def _(v):
    return al.lookback(checks(v), ["passes_0", "passes_1"], 900).select("match_id", "frame", "past_passes_0", "past_passes_1")


@query("AL2_pass_drought", """SELECT match_id, frame, 0 AS team, passes_0 - past_0 AS passes_in_period FROM past WHERE n >= 2 AND passes_0 - past_0 < 4
    UNION ALL SELECT match_id, frame, 1, passes_1 - past_1 FROM past WHERE n >= 2 AND passes_1 - past_1 < 4""")
def _(v):
    return al.pass_drought(checks(v))


@query("E12_possession_swing", "SELECT match_id, frame, team, round(pct - before, 6) AS swing FROM chkside WHERE n >= 2")
def _(v):
    return al.swings(checks(v)).select("match_id", "frame", "team", R("swing").alias("swing"))


@query("AL3_swing", """SELECT match_id, frame, team, round(pct - before, 6) AS swing FROM chkside WHERE n >= 2 AND abs(pct - before) >= 2
    QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1""")
def _(v):
    return al.swing(checks(v), 2.0).select("match_id", "frame", "team", R("swing").alias("swing"))


@query("AL4_intensity", """WITH r AS (SELECT match_id, frame, changes, changes / (total_frames / 30.0::DOUBLE / 60.0::DOUBLE) AS cpm, total_frames / 1800.0::DOUBLE AS minutes FROM checks)
    SELECT match_id, frame, CASE WHEN cpm > 15 THEN 'fragmented' ELSE 'controlled' END AS kind, round(cpm, 6) AS changes_per_minute, changes FROM r WHERE minutes >= 1 AND (cpm > 15 OR cpm < 4)""")
def _(v):
    return al.intensity(checks(v)).withColumn("changes_per_minute", R("changes_per_minute"))


@query("AL5_zone_pressure", """WITH h AS (SELECT match_id, frame, CASE WHEN zone_id IN (0, 3, 6, 9) THEN 0 WHEN zone_id IN (2, 5, 8, 11) THEN 1 END AS home, team, frames FROM zchk),
    s AS (SELECT match_id, frame, home, sum(frames) FILTER (team <> home) / nullif(sum(frames), 0) AS share FROM h WHERE home IS NOT NULL GROUP BY 1, 2, 3)
    SELECT match_id, frame, home AS team, round(share, 6) AS rival_share FROM s WHERE share >= 0.45""")
def _(v):
    return al.zone_pressure(zones_at(v, checks(v)), 0.45).withColumn("rival_share", R("rival_share"))


@query("AL6_zone_concentration", f"""WITH {tq._FOCUS_AT.format(src='zchk')}
    SELECT match_id, frame, team, array_to_string(dz, ',') AS dominant_zones, round(concentration, 6) AS concentration FROM fo WHERE concentration >= 0.60 AND len(dz) <= 5""")
def _(v):
    focus = ta.zone_focus(zones_at(v, checks(v)), keys=("match_id", "frame", "team"))
    return al.zone_concentration(focus, zones=5).select("match_id", "frame", "team", F.array_join("dominant_zones", ",").alias("dominant_zones"),
                                                        R("concentration").alias("concentration"))


@query("AL7_chain", """SELECT c.match_id, c.frame, d.team, d.length, replace(d.zones, ',', ', ') AS zones FROM chp c JOIN done d ON d.match_id = c.match_id AND d.closed_frame <= c.frame
    WHERE d.length >= 5 QUALIFY row_number() OVER (PARTITION BY c.match_id, c.frame, d.team ORDER BY d.length DESC, d.chain) = 1""")
def _(v):
    return al.best_chain(checks(v), tq.chains(v))


@query("AL8_tactical_shift", f"""WITH {tq._FOCUS_AT.format(src='zchk')}
    SELECT match_id, frame, team, concat_ws(' and ', CASE WHEN len(nz) > 0 THEN 'more in ' || array_to_string(nz, ', ') END, CASE WHEN len(lz) > 0 THEN 'less in ' || array_to_string(lz, ', ') END) AS shift
    FROM sx WHERE len(nz) + len(lz) > 0""")
def _(v):
    focus = ta.zone_focus(zones_at(v, checks(v)), keys=("match_id", "frame", "team"))
    return ta.zone_shift(focus).filter("shifted").select("match_id", "frame", "team", ta.shift_text().alias("shift"))


@query("AL9_summary", """WITH RECURSIVE s AS (SELECT match_id, min(frame) AS frame FROM chp GROUP BY 1
      UNION ALL SELECT match_id, nf FROM (SELECT s.match_id, (SELECT min(e.frame) FROM chp e WHERE e.match_id = s.match_id AND e.frame >= s.frame + 2700) AS nf FROM s) WHERE nf IS NOT NULL)
    SELECT c.match_id, c.frame, c.frame // 1800 AS minute, CASE WHEN abs(percent_0 - percent_1) < 10 THEN NULL WHEN percent_0 > percent_1 THEN 0 ELSE 1 END AS leader,
      abs(percent_0 - percent_1) >= 10 AND greatest(percent_0, percent_1) > 65 AS control,
      CASE WHEN passes_0 > 0 AND passes_1 > 0 THEN CASE WHEN passes_0 / passes_1 > 2 THEN 0 WHEN passes_0 / passes_1 < 0.5 THEN 1 END END AS better_passing
    FROM checks c JOIN s ON s.match_id = c.match_id AND s.frame = c.frame WHERE c.frame >= 1800""")
def _(v):
    return al.summary(checks(v)).select("match_id", "frame", "minute", "leader", "control", "better_passing")


@query("AL10_significant_event", """SELECT match_id, frame, CASE WHEN n < 2 THEN 'momentum_check' WHEN abs(percent_0 - pp0) >= 2 THEN 'possession_shift_team_0'
    WHEN abs(percent_1 - pp1) >= 2 THEN 'possession_shift_team_1' ELSE 'regular_check' END AS event FROM checks""")
def _(v):
    return al.significant_event(checks(v), 2.0)


CTES["sums"] = """SELECT match_id, min(frame) AS frame FROM chp GROUP BY 1
    UNION ALL SELECT match_id, nf FROM (SELECT s.match_id, (SELECT min(e.frame) FROM chp e WHERE e.match_id = s.match_id AND e.frame >= s.frame + 2700) AS nf FROM sums s) WHERE nf IS NOT NULL"""
CTES["basic"] = """SELECT match_id, frame, 'dominance_' || team AS alert_key FROM (SELECT * FROM chkside WHERE pct >= 60 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1)
    UNION ALL SELECT match_id, frame, 'drought_0' FROM past WHERE n >= 2 AND passes_0 - past_0 < 4
    UNION ALL SELECT match_id, frame, 'drought_1' FROM past WHERE n >= 2 AND passes_1 - past_1 < 4
    UNION ALL SELECT match_id, frame, 'swing_' || team FROM (SELECT * FROM chkside WHERE n >= 2 AND abs(pct - before) >= 15 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1)
    UNION ALL SELECT match_id, frame, 'intensity' FROM checks WHERE total_frames >= 1800 AND (changes / (total_frames / 1800.0::DOUBLE) > 15 OR changes / (total_frames / 1800.0::DOUBLE) < 4)
    UNION ALL SELECT match_id, frame, 'summary' FROM sums WHERE frame >= 1800"""


CTES["sumrow"] = """SELECT c.*, c.frame // 1800 AS minute FROM checks c JOIN sums s ON s.match_id = c.match_id AND s.frame = c.frame WHERE c.frame >= 1800"""


def _json(**values: str) -> str:
    """SQL: a JSON object of texts."""
    return "'{' || " + " || ',' || ".join(f"""'"{name}":"' || {value} || '"'""" for name, value in values.items()) + " || '}'"


#: every alert of every check; at 1800 frames between checks the limit of one alert in 10 seconds drops none;
#: texts round halves up, printf alone would round them to even
_ALERTS = f"""{tq._FOCUS_AT.format(src='zchk')},
    press AS (SELECT match_id, frame, home AS team, sum(frames) FILTER (team <> home) / nullif(sum(frames), 0) AS share FROM (
        SELECT match_id, frame, CASE WHEN zone_id IN (0, 3, 6, 9) THEN 0 WHEN zone_id IN (2, 5, 8, 11) THEN 1 END AS home, team, frames FROM zchk) WHERE home IS NOT NULL GROUP BY 1, 2, 3),
    rate AS (SELECT match_id, frame, changes, changes / (total_frames / 30.0::DOUBLE / 60.0::DOUBLE) AS cpm FROM checks WHERE total_frames >= 1800),
    best AS (SELECT c.match_id, c.frame, d.team, d.length, replace(d.zones, ',', ', ') AS zones FROM chp c JOIN done d ON d.match_id = c.match_id AND d.closed_frame <= c.frame
        WHERE d.length >= 5 QUALIFY row_number() OVER (PARTITION BY c.match_id, c.frame, d.team ORDER BY d.length DESC, d.chain) = 1),
    made AS (
    SELECT match_id, frame, 'possession' AS type, CASE WHEN pct >= 75 THEN 'warning' ELSE 'info' END AS severity, 'dominance' AS key, team, printf('Team %d dominates', team) AS title,
        printf('Team %d holds the ball %.1f%% of the time against %.1f%%.', team, round(pct, 1), round(rival, 1)) AS message, {_json(percent='pct', rival='rival', difference='(pct - rival)')} AS data
      FROM (SELECT * FROM chkside WHERE pct >= 60 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1)
    UNION ALL SELECT match_id, frame, 'passing', 'warning', 'drought', team, printf('Team %d is not passing', team), printf('Team %d completed %d passes in the last 30 seconds.', team, made), {_json(passes='made')}
      FROM (SELECT match_id, frame, n, 0 AS team, CAST(passes_0 - past_0 AS BIGINT) AS made FROM past UNION ALL SELECT match_id, frame, n, 1, CAST(passes_1 - past_1 AS BIGINT) FROM past) WHERE n >= 2 AND made < 4
    UNION ALL SELECT match_id, frame, 'tactical', 'info', 'swing', team, printf('Momentum of team %d', team), printf('Team %d moved by %.1f points of possession since the last check.', team, round(pct - before, 1)),
        {_json(swing='(pct - before)', percent='pct', previous='before')}
      FROM (SELECT * FROM chkside WHERE n >= 2 AND abs(pct - before) >= 15 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY team) = 1)
    UNION ALL SELECT match_id, frame, 'tactical', 'info', 'intensity', NULL, 'Play is ' || CASE WHEN cpm > 15 THEN 'fragmented' ELSE 'controlled' END, printf('%.1f changes of possession per minute.', round(cpm, 1)),
        {_json(changes_per_minute='cpm', changes='CAST(changes AS BIGINT)')} FROM rate WHERE cpm > 15 OR cpm < 4
    UNION ALL SELECT match_id, frame, 'tactical', 'info', 'summary', NULL, printf('Minute %d', CAST(minute AS BIGINT)), printf('Possession %.1f%% to %.1f%%, passes %d to %d.', round(percent_0, 1), round(percent_1, 1), CAST(passes_0 AS BIGINT), CAST(passes_1 AS BIGINT)),
        {_json(minute='CAST(minute AS BIGINT)', percent_0='percent_0', percent_1='percent_1', passes_0='CAST(passes_0 AS BIGINT)', passes_1='CAST(passes_1 AS BIGINT)')} FROM sumrow
    UNION ALL SELECT match_id, frame, 'zone', 'warning', 'pressure', team, printf('Team %d under pressure', team), printf('The rival holds %.0f%% of the time in the defence of team %d.', round(share * 100), team),
        {_json(rival_share='share')} FROM press WHERE share >= 0.55
    UNION ALL SELECT match_id, frame, 'zone', 'info', 'concentration', team, printf('Team %d plays in few zones', team), array_to_string(dz, ', ') || printf(' (%.0f%%)', round(concentration * 100)),
        {_json(concentration='concentration', pattern="CASE WHEN concentration > 0.70 THEN 'concentrated' WHEN concentration > 0.50 THEN 'focused' ELSE 'distributed' END")} FROM fo WHERE concentration >= 0.60 AND len(dz) <= 3
    UNION ALL SELECT match_id, frame, 'tactical', 'info', 'shift', team, printf('Team %d changes its zones', team),
        concat_ws(' and ', CASE WHEN len(nz) > 0 THEN 'more in ' || array_to_string(nz, ', ') END, CASE WHEN len(lz) > 0 THEN 'less in ' || array_to_string(lz, ', ') END),
        {_json(new="array_to_string(nz, ',')", lost="array_to_string(lz, ',')")} FROM sx WHERE len(nz) + len(lz) > 0
    UNION ALL SELECT match_id, frame, 'passing', 'info', 'chain', team, printf('Passing chain of team %d', team), printf('%d passes through %s.', length, zones), {_json(length='length')} FROM best),
    told AS (SELECT *, concat_ws('_', key, team) AS alert_key, concat_ws('_', 'alert', match_id, frame, key, team) AS id FROM made)"""


def all_alerts(v):
    return v.once("alerts", lambda: al.alert_table(checks(v), tq.zone_history(v), tq.chains(v)))


@query("AL12_alert_table", f"""WITH {_ALERTS} SELECT match_id, frame, type, severity, alert_key, team, title, message, data, frame / 30.0::DOUBLE AS timestamp, id FROM told""")
def _(v):
    return all_alerts(v).withColumn("data", F.to_json("data"))


@query("P30_alert_text", f"WITH {_ALERTS} SELECT id, title, message FROM told")
def _(v):
    return all_alerts(v).select("id", "title", "message")


def basic_alerts(v):
    """Alerts that need possession figures only."""
    return v.once("basic_alerts", lambda: al.alert_table(checks(v)))


@query("A35_alert_summary", """SELECT c.match_id, count(*) AS checks, max(frame) AS last_check_frame, any_value(coalesce(a.n, 0)) AS total_alerts
    FROM checks c LEFT JOIN (SELECT match_id, count(*) AS n FROM basic GROUP BY 1) a ON a.match_id = c.match_id GROUP BY 1""")
def _(v):
    return al.alert_summary(basic_alerts(v), checks(v))


@query("T6_alert_feed", "SELECT match_id, frame, alert_key FROM basic ORDER BY frame DESC, match_id, alert_key LIMIT 50")
def _(v):
    return al.alert_feed(basic_alerts(v).select("match_id", "frame", "alert_key"))


CTES["rl0"] = "SELECT match_id, k % 5 AS alert_key, frame, seq, row_number() OVER (PARTITION BY match_id, k % 5 ORDER BY frame, seq) AS rn FROM obs"


@query("ST9_rate_limit", """WITH RECURSIVE s AS (SELECT match_id, alert_key, frame, rn FROM rl0 WHERE rn = 1
      UNION ALL SELECT match_id, alert_key, nf, nr FROM (SELECT s.match_id, s.alert_key, e.frame AS nf, e.rn AS nr, row_number() OVER (PARTITION BY s.match_id, s.alert_key ORDER BY e.rn) AS o
        FROM s JOIN rl0 e ON e.match_id = s.match_id AND e.alert_key = s.alert_key AND e.rn > s.rn AND e.frame >= s.frame + 300) WHERE o = 1)
    SELECT s.match_id, s.alert_key, s.frame, e.seq FROM s JOIN rl0 e USING (match_id, alert_key, rn)""")
def _(v):
    rows = v.obs.select("match_id", (F.col("k") % 5).alias("alert_key"), "frame", "seq", (F.col("frame") / 30.0).alias("timestamp"))
    return machine.rate_limit(rows, 10.0).drop("timestamp")
