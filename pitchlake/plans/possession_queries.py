"""Possession queries (E1-E5, A1-A5, A30, A31, A38, E19, T3, T4, T7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import possession as po
from .registry import query
from .views import BATCH, CTES, HYSTERESIS, Views

N = HYSTERESIS

CTES.update({
    "runs0": """SELECT *, lag(team) OVER w AS lt, row_number() OVER w AS rn FROM obs
        WINDOW w AS (PARTITION BY match_id ORDER BY frame, seq)""",
    "runs1": """SELECT *, sum(CASE WHEN rn = 1 OR team IS DISTINCT FROM lt THEN 1 ELSE 0 END) OVER
        (PARTITION BY match_id ORDER BY frame, seq) AS run FROM runs0""",
    "runs2": """SELECT *, row_number() OVER (PARTITION BY match_id, run ORDER BY frame, seq) AS len,
        count(team) OVER (PARTITION BY match_id ORDER BY frame, seq ROWS UNBOUNDED PRECEDING) AS nn FROM runs1""",
    "runs3": f"""SELECT *, CASE WHEN team IS NOT NULL AND (len >= {N} OR nn = 1) THEN team END AS conf_team FROM runs2""",
    "runs4": """SELECT *, last_value(conf_team IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame, seq
        ROWS UNBOUNDED PRECEDING) AS current_team FROM runs3""",
    "poss": """SELECT match_id, frame, seq, team, player, current_team,
        lag(current_team) OVER w AS prev_team, lag(frame) OVER w AS prev_frame FROM runs4
        WINDOW w AS (PARTITION BY match_id ORDER BY frame, seq)""",
    "credit": """SELECT match_id, frame, seq, prev_team AS team, frame - prev_frame AS frames FROM poss
          WHERE prev_team IS NOT NULL AND frame > prev_frame
        UNION ALL SELECT match_id, frame, seq, current_team, 1 FROM poss
          WHERE current_team IS NOT NULL AND prev_team IS NULL""",
    "chg": """SELECT match_id, frame, seq, prev_team AS from_team, current_team AS to_team, player FROM poss
        WHERE prev_team <> current_team""",
    "seg0": """SELECT *, sum(CASE WHEN prev_team <> current_team THEN 1 ELSE 0 END) OVER
        (PARTITION BY match_id ORDER BY frame, seq) AS seg FROM poss""",
    "pass0": """SELECT *, lag(player) OVER (PARTITION BY match_id, seg ORDER BY frame, seq) AS from_player FROM seg0
        WHERE team = current_team AND player IS NOT NULL AND (prev_team IS NULL OR prev_team = current_team)""",
    "pass": """SELECT match_id, frame, seq, current_team AS team, from_player, player AS to_player FROM pass0
        WHERE from_player <> player""",
    "seg": """SELECT match_id, seg, min(frame) AS start_frame, min(seq) FILTER (first) AS seq, any_value(current_team) AS team
        FROM (SELECT *, row_number() OVER (PARTITION BY match_id, seg ORDER BY frame, seq) = 1 AS first
              FROM seg0 WHERE current_team IS NOT NULL) GROUP BY match_id, seg""",
    "tl": """SELECT s.match_id, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY s.match_id ORDER BY start_frame, seq), m.last) AS end_frame,
        team, seq FROM seg s JOIN (SELECT match_id, max(frame) AS last FROM obs GROUP BY 1) m ON s.match_id = m.match_id""",
    "team2": "SELECT * FROM (VALUES (0), (1)) t(team)",
    "stats": """SELECT e.match_id, t.team, e.total_frames, coalesce(c.frames, 0) AS frames, coalesce(p.passes, 0) AS passes
        FROM (SELECT match_id, CASE WHEN count(current_team) > 0 THEN max(frame) ELSE 0 END AS total_frames FROM poss GROUP BY 1) e
        CROSS JOIN (SELECT * FROM team2) t
        LEFT JOIN (SELECT match_id, team, sum(frames) AS frames FROM credit GROUP BY 1, 2) c ON c.match_id = e.match_id AND c.team = t.team
        LEFT JOIN (SELECT match_id, team, count(*) AS passes FROM pass GROUP BY 1, 2) p ON p.match_id = e.match_id AND p.team = t.team""",
    "step0": f"""SELECT DISTINCT match_id, frame // {BATCH} AS batch_idx, t.team FROM obs CROSS JOIN (SELECT * FROM team2) t""",
    "step1": f"""SELECT s.match_id, s.batch_idx, s.team, coalesce(c.f, 0) AS df, coalesce(p.n, 0) AS dp, coalesce(g.n, 0) AS dc FROM step0 s
        LEFT JOIN (SELECT match_id, frame // {BATCH} AS b, team, sum(frames) AS f FROM credit GROUP BY 1, 2, 3) c
          ON c.match_id = s.match_id AND c.b = s.batch_idx AND c.team = s.team
        LEFT JOIN (SELECT match_id, frame // {BATCH} AS b, team, count(*) AS n FROM pass GROUP BY 1, 2, 3) p
          ON p.match_id = s.match_id AND p.b = s.batch_idx AND p.team = s.team
        LEFT JOIN (SELECT match_id, frame // {BATCH} AS b, count(*) AS n FROM chg GROUP BY 1, 2) g
          ON g.match_id = s.match_id AND g.b = s.batch_idx""",
    "cum": f"""SELECT match_id, batch_idx, team, (batch_idx + 1) * {BATCH} AS frame, CAST(sum(df) OVER w AS BIGINT) AS frames,
        CAST(sum(dp) OVER w AS BIGINT) AS passes, CAST(sum(dc) OVER w AS BIGINT) AS changes FROM step1
        WINDOW w AS (PARTITION BY match_id, team ORDER BY batch_idx)""",
})


def frames(v: Views):
    return po.possession_frames(v.obs, n=N)


@query("E1_possession_hysteresis", "SELECT match_id, frame, seq, team, current_team FROM poss")
def _(v):
    return frames(v).select("match_id", "frame", "seq", "team", "current_team")


@query("E2_time_attribution", "SELECT match_id, frame, seq, team, CAST(frames AS BIGINT) AS frames FROM credit")
def _(v):
    return po.attributed_frames(frames(v))


@query("E3_pass_detection", "SELECT match_id, frame, seq, team, from_player, to_player FROM pass")
def _(v):
    return po.passes(v.frames)


@query("E4_possession_change", "SELECT match_id, frame, seq, from_team, to_team, player AS player_id FROM chg")
def _(v):
    return po.possession_changes(frames(v))


@query("E5_timeline", "SELECT match_id, start_frame, end_frame, team FROM tl")
def _(v):
    return po.timeline(v.frames).drop("seq")


@query("A1_possession_stats", """SELECT match_id, CAST(team AS BIGINT) AS team, CAST(frames AS BIGINT) AS frames, total_frames,
    round(frames / 30.0::DOUBLE, 6) AS seconds,
    round(CASE WHEN total_frames > 0 THEN frames * 100.0::DOUBLE / total_frames ELSE 0 END, 6) AS percent FROM stats""")
def possession_share(v):
    out = po.possession_stats(v.frames)
    return out.withColumns({"seconds": rounded("seconds"), "percent": rounded("percent")})


@query("A2_passes_by_team", "SELECT match_id, team, count(*) AS passes FROM pass GROUP BY 1, 2")
def _(v):
    return po.passes_by_team(v.passed)


@query("A3_match_summary", """WITH c AS (SELECT match_id, sum(frames) AS possession_frames,
        sum(frames) FILTER (team = 0) AS f0, sum(frames) FILTER (team = 1) AS f1 FROM credit GROUP BY 1),
    e AS (SELECT match_id, max(frame) AS total_frames, arg_max(current_team, frame * 1000000000 + seq) AS current_team FROM poss GROUP BY 1),
    p AS (SELECT match_id, count(*) AS passes FROM pass GROUP BY 1),
    t AS (SELECT match_id, count(*) AS players, count(*) FILTER (tm = 0) AS players_0, count(*) FILTER (tm = 1) AS players_1
          FROM (SELECT match_id, track_id, max(team_id) AS tm FROM det GROUP BY 1, 2) GROUP BY 1)
    SELECT e.match_id, total_frames, current_team, CAST(coalesce(possession_frames, 0) AS BIGINT) AS possession_frames,
      CAST(coalesce(f0, 0) AS BIGINT) AS frames_0, CAST(coalesce(f1, 0) AS BIGINT) AS frames_1, coalesce(passes, 0) AS passes,
      coalesce(players, 0) AS players, coalesce(players_0, 0) AS players_0, coalesce(players_1, 0) AS players_1,
      round(total_frames / 30.0::DOUBLE, 6) AS total_seconds,
      round(coalesce(f0, 0) * 100.0::DOUBLE / possession_frames, 6) AS percent_0,
      round(coalesce(f1, 0) * 100.0::DOUBLE / possession_frames, 6) AS percent_1
    FROM e LEFT JOIN c USING (match_id) LEFT JOIN p USING (match_id) LEFT JOIN t USING (match_id)""")
def _(v):
    out = po.match_summary(v.frames, v.passed, v.det)
    return out.withColumns({n: rounded(n) for n in ("total_seconds", "percent_0", "percent_1")})


@query("A4_final_stats", """SELECT match_id, team, CAST(sum(frames) AS BIGINT) AS frames,
    round(sum(frames) * 100.0::DOUBLE / sum(sum(frames)) OVER (PARTITION BY match_id), 6) AS percent
    FROM credit WHERE team >= 0 GROUP BY 1, 2""")
def _(v):
    return po.final_stats(po.attributed_frames(frames(v))).withColumn("percent", rounded("percent"))


@query("A5_chunk_stats", f"""WITH f AS (SELECT match_id, frame // {BATCH} AS batch_idx, count(DISTINCT frame) AS frames_processed,
        count(*) FILTER (prev_team <> current_team) AS changes, arg_max(current_team, frame * 1000000000 + seq) AS possession_team
        FROM poss GROUP BY 1, 2),
    d AS (SELECT match_id, frame // {BATCH // 240} AS batch_idx, count(*) AS n FROM det GROUP BY 1, 2),
    p AS (SELECT match_id, frame // {BATCH} AS batch_idx, count(*) AS n FROM pass GROUP BY 1, 2)
    SELECT f.match_id, f.batch_idx, frames_processed, possession_team, coalesce(d.n, 0) AS detections_count,
      changes + coalesce(p.n, 0) AS events_count FROM f LEFT JOIN d USING (match_id, batch_idx) LEFT JOIN p USING (match_id, batch_idx)""")
def _(v):
    boxes = v.det.withColumn("frame", F.col("frame") * 240)
    return po.chunk_stats(v.frames, v.passed, boxes, BATCH)


@query("A30_coverage_check", """SELECT m.match_id, last_frame, CAST(coalesce(assigned, 0) AS BIGINT) AS assigned, coalesce(assigned, 0) = last_frame AS complete
    FROM (SELECT match_id, max(frame) AS last_frame FROM obs GROUP BY 1) m
    LEFT JOIN (SELECT match_id, sum(frames) AS assigned FROM credit GROUP BY 1) c USING (match_id)""")
def _(v):
    return po.coverage(v.frames)


@query("A38_current_state", """SELECT match_id, arg_max(current_team, frame * 1000000000 + seq) AS team, max(frame) AS frame,
    count(current_team) > 0 AS initialized FROM poss GROUP BY 1""")
def _(v):
    return po.current_state(frames(v))


@query("E19_cumulative_progress", "SELECT match_id, batch_idx, team, frame, frames, passes, changes FROM cum")
def _(v):
    return v.progress


@query("T3_recent_passes", f"""SELECT match_id, frame // {BATCH} AS batch_idx, frame, seq, team, from_player, to_player,
    row_number() OVER (PARTITION BY match_id, frame // {BATCH} ORDER BY frame DESC, seq DESC) AS rank FROM pass QUALIFY rank <= 10""")
def _(v):
    return po.recent_passes(v.passed, BATCH)


@query("T4_timeline_preview", """SELECT match_id, start_frame, end_frame, team FROM
    (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start_frame, seq) AS a,
       row_number() OVER (PARTITION BY match_id ORDER BY start_frame DESC, seq DESC) AS b FROM tl) WHERE a <= 3 OR b <= 3""")
def _(v):
    return po.timeline_preview(po.timeline(v.frames)).drop("seq")


@query("T7_timeline_chart", """SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY start_frame, seq) AS segment,
    team, round((end_frame - start_frame) / 30.0::DOUBLE, 6) AS duration FROM tl""")
def _(v):
    out = po.timeline_chart(po.timeline(v.frames))
    return out.select("match_id", "segment", "team", rounded("duration").alias("duration"))
