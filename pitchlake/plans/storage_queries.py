"""Sources, sinks, batches and streams (S1-S14, A31, ST1, ST10, ST11, ST13)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.columns import rounded as R
from ..operators import possession as po
from ..operators import spatial as sp
from ..session import durable, scratch_path
from ..sources import readers, writers
from ..streaming import live
from . import possession_queries as pq  # noqa: F401  (its CTEs)
from .registry import query
from .spatial_queries import placed
from .views import BATCH, CTES, HYSTERESIS


def batched(v):
    return v.det.withColumns({"batch_idx": F.expr("frame div 30"), "class_name": fn.class_name("class_id")})


_BOX = ", ".join(f"round({n}, 6) AS {n}" for n in ("x1", "y1", "x2", "y2"))


@query("S1_read_detections", f"""SELECT match_id, frame // 30 AS batch_idx, frame, row_number() OVER (PARTITION BY match_id, frame ORDER BY seq) - 1 AS seq, track_id, class_id,
    CASE class_id WHEN 0 THEN 'player' WHEN 1 THEN 'ball' WHEN 2 THEN 'referee' ELSE 'goalkeeper' END AS class_name, team_id, {_BOX} FROM det""")
def _(v):
    path = scratch_path(v.spark, "detections")
    writers.write_detection_documents(batched(v), path)
    rows = readers.read_detections(v.spark, path, "*.txt")
    return rows.select(F.col("match_id").cast("long").alias("match_id"), "batch_idx", "frame", "seq", "track_id", "class_id", "class_name",
                       "team_id", *[R(f"bbox.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])


@query("S2_read_positions", "SELECT match_id, frame // 30 AS batch_idx, frame, track_id AS player_id, team_id, round((x1 + x2) / 2, 6) AS x, round((y1 + y2) / 2, 6) AS y FROM players")
def _(v):
    cx, cy = fn.box_centre()
    path = scratch_path(v.spark, "positions")
    rows = v.players.withColumn("batch_idx", F.expr("frame div 30"))
    writers.write_batch_documents(rows, path, "frame", (F.col("frame") / 30.0).alias("timestamp"), F.col("track_id").alias("player_id"), "team_id",
                                  F.array("x1", "y1", "x2", "y2").alias("bbox"), F.array(cx, cy).alias("position"))
    back = readers.read_positions(v.spark, path, "*.txt")
    return back.select(F.col("match_id").cast("long").alias("match_id"), "batch_idx", "frame", "player_id", "team_id", R("x").alias("x"), R("y").alias("y"))


@query("S3_read_events", """SELECT match_id, frame, 'pass' AS type, team, from_player, to_player FROM pass""")
def _(v):
    path = scratch_path(v.spark, "events")
    rows = v.passed.withColumns({"type": F.lit("pass"), "batch_idx": F.expr(f"frame div {BATCH}")})
    writers.write_batch_documents(rows, path, "type", "frame", "team", "from_player", "to_player")
    back = readers.read_events(v.spark, path, "*.txt")
    return back.select(F.col("match_id").cast("long").alias("match_id"), "frame", "type", "team", "from_player", "to_player")


CTES["cstat"] = """SELECT match_id, frame // 30 AS batch_idx, min(frame) AS start_frame, max(frame) AS end_frame, count(DISTINCT frame) AS frames_processed, count(*) AS detections_count,
    sum(seq % 100 + 1)::DOUBLE AS processing_time_ms FROM det GROUP BY 1, 2"""


def stored_stats(v):
    path = scratch_path(v.spark, "stats")
    stats = batched(v).groupBy("match_id", "batch_idx").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.countDistinct("frame").alias("frames_processed"),
        F.count(F.lit(1)).alias("detections_count"), F.sum(F.col("seq") % 100 + 1).cast("double").alias("processing_time_ms"))
    batch = F.col("batch_idx").alias("batch_idx")
    writers.write_batch_documents(stats, path, batch, "start_frame", "end_frame", "processing_time_ms",
                                  F.struct("frames_processed", "detections_count").alias("chunk_stats"))
    return readers.read_chunk_stats(v.spark, path, "*.txt").withColumn("match_id", F.col("match_id").cast("long")).drop(
        "events_count", "possession_team", "possession_player")


@query("S4_read_chunk_stats", "SELECT * FROM cstat")
def _(v):
    return stored_stats(v).orderBy("match_id", "batch_idx")


@query("A31_throughput", """SELECT match_id, batch_idx, round(frames_processed * 1000 / processing_time_ms, 6) AS frames_per_second, round(frames_processed * 1000 / processing_time_ms / 30, 6) AS realtime,
    round(sum(frames_processed) OVER (PARTITION BY match_id) * 1000.0::DOUBLE / sum(processing_time_ms) OVER (PARTITION BY match_id), 6) AS overall_fps FROM cstat""")
def _(v):
    out = readers.throughput(stored_stats(v))
    return out.select("match_id", "batch_idx", *[R(n).alias(n) for n in ("frames_per_second", "realtime", "overall_fps")])


def match_states(v):
    """Match documents derived from the possession results."""
    teams = po.possession_stats(v.frames, pass_events=v.passed).groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("team").cast("string"), "frames"))).alias("f"),
        F.map_from_entries(F.collect_list(F.struct(F.col("team").cast("string"), "passes"))).alias("p"),
        F.max("total_frames").alias("total_frames_processed"))
    return teams.select("match_id", F.lit(30.0).alias("fps"), F.lit("completed").alias("status"), "total_frames_processed",
                        F.struct(F.col("f").alias("frames_by_team"), F.col("p").alias("passes_by_team")).alias("possession_state"))


@query("S5_read_match_state", "SELECT match_id, team, CAST(frames AS BIGINT) AS frames, passes FROM stats")
def _(v):
    path = scratch_path(v.spark, "states")
    writers.write_match_states(match_states(v), path)
    return readers.team_counters(readers.read_match_state(v.spark, path)).withColumn("match_id", F.col("match_id").cast("long"))


@query("S6_list_matches", "SELECT DISTINCT match_id FROM obs")
def _(v):
    return readers.list_matches(v.obs)


@query("S7_write_chunk_outputs", """SELECT match_id, batch_idx, count(*) AS rows_kept, sum(frame) AS frame_sum FROM (SELECT match_id, frame // 30 AS batch_idx, frame FROM det) GROUP BY 1, 2""")
def _(v):
    root = scratch_path(v.spark, "chunks")
    rows = batched(v).select("match_id", "batch_idx", "frame", "seq", "track_id")
    writers.write_chunk_outputs(root, detections=rows)
    writers.write_chunk_outputs(root, detections=rows.filter("batch_idx = 1"))  # a replay replaces its batches
    return v.spark.read.parquet(f"{root}/detections").groupBy(
        F.col("match_id").cast("long").alias("match_id"), F.col("batch_idx").cast("long").alias("batch_idx")).agg(
        F.count(F.lit(1)).alias("rows_kept"), F.sum("frame").alias("frame_sum"))


@query("S8_upsert_delete_state", """SELECT match_id, max(frame) + CASE WHEN match_id % 2 = 0 THEN 1 ELSE 0 END AS last_frame FROM obs WHERE match_id % 5 <> 3 GROUP BY 1""")
def _(v):
    path = scratch_path(v.spark, "state_table")
    states = durable(v.obs.groupBy("match_id").agg(F.max("frame").alias("last_frame")))  # a row a match, read by every step below
    writers.save_state(states, path)
    writers.save_state(states.filter("match_id % 2 = 0").withColumn("last_frame", F.col("last_frame") + 1), path)
    writers.delete_state(v.spark, path, states.filter("match_id % 5 = 3").select("match_id"))
    return writers.read_states(v.spark, path).select(F.col("match_id").cast("long").alias("match_id"), "last_frame")


@query("S9_export_heatmaps", """SELECT match_id, team, iy, ix, round(weight / max(weight) OVER (PARTITION BY match_id, team), 6) AS weight FROM cells""")
def _(v):
    root = scratch_path(v.spark, "heatmaps")
    writers.export_heatmaps(placed(v), sp.zone_time(placed(v)), root)
    back = v.spark.read.parquet(f"{root}/cells")
    return back.select(F.col("match_id").cast("long").alias("match_id"), "team", "iy", "ix", R("weight").alias("weight"))


@query("S10_resume", f"""SELECT DISTINCT match_id, frame // {BATCH} AS batch_idx FROM obs WHERE (frame // {BATCH}) % 3 <> 0""")
def _(v):
    batches = v.obs.select("match_id", live.batch_index(BATCH).alias("batch_idx")).distinct()
    return readers.remaining(batches, batches.filter("batch_idx % 3 = 0"))


@query("S11_read_heatmap_points", "SELECT match_id, team, frame, track_id, round(px, 6) AS x, round(py, 6) AS y FROM placed")
def _(v):
    path = scratch_path(v.spark, "points")
    p = placed(v).withColumn("batch_idx", F.expr("frame div 30"))
    point = F.struct("frame", "track_id", F.array("x", "y").alias("position"), F.lit("homography").alias("method"))
    teams = [F.collect_list(F.when(F.col("team") == t, point)).alias(f"team_{t}") for t in (0, 1)]
    writers.write_documents(p.groupBy("match_id", "batch_idx").agg(F.to_json(F.struct(*teams)).alias("value")), path)
    out = readers.read_heatmap_points(v.spark, path)
    return out.select(F.col("match_id").cast("long").alias("match_id"), "team", "frame", "track_id", R("x").alias("x"), R("y").alias("y"))


@query("ST1_micro_batch", f"""SELECT match_id, frame // {BATCH} AS batch_idx, count(*) AS observations, min(frame) AS first_frame, max(frame) AS last_frame FROM obs GROUP BY 1, 2""")
def _(v):
    return v.obs.groupBy("match_id", live.batch_index(BATCH).alias("batch_idx")).agg(
        F.count(F.lit(1)).alias("observations"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


CHUNKS = 3


def arrivals(rows, source):
    """Write observations as they would arrive, a third of the time axis after the other; yields after each."""
    last = rows.agg(F.max("frame").alias("f")).first()["f"] or 0
    for chunk in range(CHUNKS):
        rows.filter(F.floor(F.col("frame") * CHUNKS / (last + 1)) == chunk).select("match_id", "frame", "seq", "team", "player").write.mode("append").parquet(source)
        yield chunk


def drain(v, root, sink=None):
    """Run the possession job over what has arrived, from its checkpoint."""
    stream = live.possession_stream(live.observation_stream(v.spark, f"{root}/observations"), HYSTERESIS)
    job = live.start_job(stream, f"{root}/checkpoint", sink or live.publish_stats(root, live.live_dominance(root, LEAD)))
    job.awaitTermination()


def streamed(v):
    """Observations streamed through possession and its sinks, a micro-batch for every third of the time axis."""
    if "streamed" not in v.folders:
        root = v.folders["streamed"] = scratch_path(v.spark, "stream")
        for _ in arrivals(v.obs, f"{root}/observations"):
            drain(v, root)
    return v.folders["streamed"]


LEAD = 52.0


@query("ST13_live_stats", """SELECT match_id, team, CAST(frames AS BIGINT) AS frames, passes, round(frames / 30.0::DOUBLE, 6) AS seconds FROM stats""")
def _(v):
    return live.live_stats(v.spark, streamed(v)).select("match_id", "team", "frames", "passes", R("seconds").alias("seconds"))


@query("S13_publish_batch_stats", "SELECT match_id, frame, seq, current_team FROM poss")
def _(v):
    return v.spark.read.parquet(f"{streamed(v)}/possession").select("match_id", "frame", "seq", "current_team")


_ARRIVED = f"(SELECT o.*, CAST(floor(frame * {CHUNKS} / (last + 1)) AS BIGINT) AS epoch FROM obs o, (SELECT max(frame) AS last FROM obs) m)"


@query("U1_callbacks", f"""SELECT 'batch' AS event, match_id, epoch, count(*) AS rows, max(frame) AS last_frame FROM {_ARRIVED} GROUP BY match_id, epoch""")
def _(v):
    return v.spark.read.schema(live.EVENT).parquet(f"{streamed(v)}/events").select("event", "match_id", "epoch", "rows", "last_frame")


@query("ST10_resume", "SELECT match_id, frame, seq, current_team FROM poss")
def _(v):
    """The job fails in its second micro-batch, after it has written, and a new one goes on from the checkpoint."""
    root = scratch_path(v.spark, "resumed")
    publish = live.publish_stats(root)

    def failing(batch, epoch):
        publish(batch, epoch)
        if epoch == 1:
            raise RuntimeError("lost between write and commit")

    for chunk in arrivals(v.obs, f"{root}/observations"):
        try:
            drain(v, root, failing if chunk == 1 else publish)
        except StreamingQueryException:
            drain(v, root, publish)
    return v.spark.read.parquet(f"{root}/possession").select("match_id", "frame", "seq", "current_team")


_MARKS = "(SELECT match_id, max(frame) AS mark FROM obs WHERE seq % 7 <> 0 GROUP BY 1)"
CTES["obs_t"] = f"SELECT obs.*, seq % 7 = 0 AS part FROM obs LEFT JOIN {_MARKS} m USING (match_id) WHERE NOT coalesce(seq % 7 = 0 AND frame < mark, false)"
_PRIOR = "obs"
for _name in ("runs0", "runs1", "runs2", "runs3", "runs4", "poss"):  # possession over the rows in time
    CTES[f"{_name}_t"] = CTES[_name].replace(f"FROM {_PRIOR}", f"FROM {_PRIOR}_t").replace("ORDER BY frame, seq", "ORDER BY frame, part, seq")
    _PRIOR = _name


@query("ST11_late_rows", f"""SELECT match_id, frame, seq, false AS late, current_team FROM poss_t
    UNION ALL SELECT obs.match_id, obs.frame, obs.seq, true, NULL FROM obs JOIN {_MARKS} m USING (match_id) WHERE seq % 7 = 0 AND frame < mark""")
def _(v):
    """Every seventh observation arrives after later ones of its match: the state takes none of them that it has passed."""
    root = scratch_path(v.spark, "late")
    rows = v.obs.select("match_id", "frame", "seq", "team", "player")
    for part in ("seq % 7 <> 0", "seq % 7 = 0"):
        rows.filter(part).write.mode("append").parquet(f"{root}/observations")
        drain(v, root, live.publish_stats(root))
    taken = v.spark.read.parquet(f"{root}/possession").select("match_id", "frame", "seq", F.lit(False).alias("late"), "current_team")
    return taken.unionByName(v.spark.read.parquet(f"{root}/late").select("match_id", "frame", "seq", F.lit(True).alias("late"), F.lit(None).cast("long").alias("current_team")))


@query("ST11_order_guard", """WITH m AS (SELECT match_id, max(frame) AS mark FROM obs WHERE seq % 7 <> 0 GROUP BY 1)
    SELECT obs.match_id, frame, seq, CASE WHEN seq % 7 = 0 AND frame < mark THEN 'late' ELSE 'taken' END AS fate FROM obs LEFT JOIN m USING (match_id)""")
def _(v):
    """Every seventh observation arrives in a later run, after later frames of its match."""
    root = scratch_path(v.spark, "guard")
    rows = v.obs.select("match_id", "frame", "seq", "team", "player")
    rows.filter("seq % 7 <> 0").write.parquet(f"{root}/in")
    stream = v.spark.readStream.schema(live.OBSERVATION).parquet(f"{root}/in")
    sink = live.guard_order(root, lambda df, epoch: live.write_epoch(df, f"{root}/taken", epoch))
    live.start_job(stream, f"{root}/checkpoint", sink).awaitTermination()
    rows.filter("seq % 7 = 0").write.mode("append").parquet(f"{root}/in")
    live.start_job(stream, f"{root}/checkpoint", sink).awaitTermination()
    taken = v.spark.read.parquet(f"{root}/taken").select("match_id", "frame", "seq", F.lit("taken").alias("fate"))
    return taken.unionByName(v.spark.read.parquet(f"{root}/late").select("match_id", "frame", "seq", F.lit("late").alias("fate")))


@query("S14_match_lifecycle", """SELECT DISTINCT match_id, CASE WHEN match_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN match_id % 4 = 0 THEN 'source ended' END AS error FROM obs""")
def _(v):
    path = scratch_path(v.spark, "status")
    ids = readers.list_matches(v.obs)
    writers.log_status(v.spark, path, ids, "running")
    writers.log_status(v.spark, path, ids.filter("match_id % 4 <> 0"), "completed")
    writers.log_status(v.spark, path, ids.filter("match_id % 4 = 0"), "failed", "source ended")
    return writers.latest_status(v.spark, path).drop("at")


@query("S13_publish_alerts", f"""WITH a AS {_ARRIVED}, chunk_ends AS (SELECT match_id, epoch, max(frame) AS frame FROM a GROUP BY 1, 2),
    c AS (SELECT e.match_id, e.frame, credit.team, sum(credit.frames) AS n FROM chunk_ends e JOIN credit ON credit.match_id = e.match_id AND credit.frame <= e.frame GROUP BY 1, 2, 3)
    SELECT match_id, frame, team, round(percent, 6) AS percent FROM (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY match_id, frame) AS percent FROM c) WHERE percent >= {LEAD}""")
def _(v):
    """Alerts that the sink wrote with every micro-batch, from the statistics up to it."""
    return v.spark.read.parquet(f"{streamed(v)}/alerts").select("match_id", "frame", "team", R("percent").alias("percent"))
