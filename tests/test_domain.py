"""Worked examples of zones, chains, alerts, homographies and stored files."""

import json

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import columns as fn
from pitchlake.functions import pitch
from pitchlake.operators import alerts, keypoints, possession, spatial, tactics
from pitchlake.sources import readers, writers
from pitchlake.streaming import live


def zone_rows(spark, counts, team):
    return spark.createDataFrame([(1, team, z, f) for z, f in enumerate(counts)],
                                 "match_id long, team int, zone_id int, frames long")


@pytest.mark.parametrize("counts,zones,share,pattern", [
    ([10, 10, 10, 20, 20, 20, 100, 120, 110], [7, 8, 6], 0.785714, "concentrated"),
    ([100, 120, 110, 20, 20, 20, 10, 10, 10], [1, 2, 0], 0.785714, "concentrated"),
    ([20, 20, 20, 40, 40, 40, 300, 350, 325], [7, 8, 6], 0.844156, "concentrated")])
def test_zone_focus(spark, counts, zones, share, pattern):
    row = tactics.zone_focus(zone_rows(spark, counts, 0)).first()
    assert (row.zone_ids, row.pattern) == (zones, pattern)
    assert row.concentration == pytest.approx(share, abs=1e-6)
    assert row.dominant_zones == [f"Zone_{z}" for z in zones]


def test_passing_chain(spark):
    zones = ["Offensive Center", "Offensive Right", "Midfield Center", "Offensive Center", "Offensive Right"]
    rows = [(1, 5 * i, i, "pass", 0, z) for i, z in enumerate(zones)] + [(1, 7, 50, "pass", 1, "x"), (1, 25, 9, "possession_loss", 0, None)]
    df = spark.createDataFrame(rows, "match_id long, frame long, seq long, type string, team int, zone string")
    row = tactics.passing_chains(df, block_frames=4).collect()
    assert len(row) == 1
    assert (row[0].length, row[0].zones, row[0].closed_frame) == (5, zones[:3], 25)
    assert row[0].duration == pytest.approx(0.666667, abs=1e-6)


def progress(spark, *rows):
    flat = [(1, f, t, (a, b)[t], (pa, pb)[t], ch) for f, a, b, pa, pb, ch in rows for t in (0, 1)]
    return spark.createDataFrame(flat, "match_id long, frame long, team int, frames long, passes long, changes long")


def test_alert_examples(spark):
    one = alerts.check_table(progress(spark, (3600, 700, 300, 30, 20, 100)), 1800)
    assert [(r.team, r.severity) for r in alerts.dominance(one).collect()] == [(0, "info")]
    assert alerts.summary(one).count() == 1
    even = alerts.check_table(progress(spark, (3600, 520, 480, 30, 20, 100)), 1800)
    assert alerts.dominance(even).count() == 0
    assert alerts.check_table(progress(spark, (10, 7, 3, 0, 0, 0)), 1800).count() == 0
    gated = alerts.check_table(progress(spark, (3600, 700, 300, 30, 20, 9), (3601, 701, 300, 30, 20, 9)), 1800)
    assert [r.frame for r in gated.collect()] == [3600]


def test_alert_table_kinds(spark):
    checks = alerts.check_table(progress(spark, (1800, 1500, 1000, 30, 20, 5)), 1800)
    zones = spark.createDataFrame(
        [(1, 1800, 0, z, f) for z, f in enumerate([20, 20, 20, 40, 40, 40, 300, 350, 325])]
        + [(1, 1800, 1, z, f) for z, f in enumerate([300, 350, 325, 40, 40, 40, 20, 20, 20])],
        "match_id long, frame long, team int, zone_id int, frames long")
    focus = tactics.zone_focus(zones, keys=("match_id", "frame", "team"))
    assert alerts.zone_concentration(focus).count() == 2
    row = alerts.intensity(checks).first()
    assert (row.kind, round(row.changes_per_minute, 2)) == ("controlled", 3.6)
    kinds = sorted(r.alert_key for r in alerts.alert_table(checks, zones).collect())
    assert [k for k in kinds if not k.startswith("pressure")] == [
        "concentration_0", "concentration_1", "dominance_0", "intensity", "summary"]


def test_weighted_heatmap_totals(spark):
    rows = [(1, 0, 20 + 0.5 * i, 30.0, 1.0) for i in range(10)] + [(1, 1, 80 - 0.3 * i, 35.0, 0.9) for i in range(10)]
    rows += [(1, 0, float("nan"), 3.0, 1.0), (1, 0, 105.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "match_id long, team int, x double, y double, conf double")
    total = {r.team: r.w for r in spatial.heatmap(df, weight="conf").groupBy("team").agg(F.sum("weight").alias("w")).collect()}
    assert total[0] == pytest.approx(10.0) and total[1] == pytest.approx(9.0)


def test_gaussian_keeps_mass(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 0, 20, 49, 2)], "match_id long, team int, iy int, ix int, weight long")
    out = spatial.gaussian(cells, 2.5).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    assert out.n == 2500 and out.w == pytest.approx(6.0)


def test_zone_edges(spark):
    pts = spark.createDataFrame([(105.0, 68.0), (0.0, 0.0), (105.01, 5.0), (52.5, -0.1)], "x double, y double")
    got = [tuple(r) for r in pts.select(fn.zone_of("x", "y", 0, "grid"), fn.zone_of("x", "y", 0), fn.zone_of("x", "y", 1)).collect()]
    assert got == [(23, 8, 2), (0, 0, 6), (-1, -1, -1), (-1, -1, -1)]


def test_pitch_tables(spark):
    assert pitch.field_points(spark).count() == 16 and pitch.model_points(spark).count() == 48
    outline = pitch.pitch_outline(spark)
    assert outline.filter("kind = 'line'").select("name").distinct().count() == 11
    assert outline.filter("kind = 'point'").count() == 23
    scaled = pitch.pitch_outline(spark, scaled=True).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(scaled) == (0.0, 1.0, 0.0, 1.0)


def test_homography_survives_outlier(spark):
    h = [[11.0, 1.5, 40.0], [0.4, -9.0, 700.0], [0.0, 0.002, 1.0]]
    rows = []
    for name, (X, Y) in list(pitch.DETECTED_POINTS.items())[:9]:
        w = h[2][1] * Y + 1
        x, y = (h[0][0] * X + h[0][1] * Y + h[0][2]) / w, (h[1][0] * X + h[1][1] * Y + h[1][2]) / w
        rows.append((1, 1, name, x + (400.0 if name == "center" else 0.0), y, 0.9))
    kp = spark.createDataFrame(rows, "match_id long, frame long, name string, x double, y double, conf double")
    pts = keypoints.frame_points(keypoints.correspondences(kp))
    fit = keypoints.fit_homographies(pts).first()
    assert (fit.inliers, fit.num_points, fit.flip) == (8, 9, False) and "center" not in fit.used
    assert fit.error < 1e-6
    few = keypoints.fit_homographies(keypoints.frame_points(keypoints.correspondences(kp.limit(3)))).first()
    assert few.h00 is None and few.inliers == 0


def test_orientation(spark):
    def frame(f, small, big):
        return [(1, f, "smallarea_top_inner", small, 1.0, 1.0), (1, f, "bigarea_top_inner", big, 2.0, 1.0)]
    rows = frame(1, 10.0, 50.0) + frame(2, 50.0, 10.0) + [(1, 3, "center", 5.0, 5.0, 1.0)]
    kp = spark.createDataFrame(rows, "match_id long, frame long, name string, x double, y double, conf double")
    votes = keypoints.orientation_votes(keypoints.frame_points(keypoints.correspondences(kp))).orderBy("frame").collect()
    assert [(r.flip, r.votes) for r in votes] == [(False, 1), (True, 1), (False, 0)]


def test_stored_layout(spark, tmp_path):
    """Files as the batch job of a single match leaves them: one folder per match, files per batch."""
    folder = tmp_path / "out" / "match-a"
    folder.mkdir(parents=True)
    for b in (0, 1):
        frames = {str(f): {"frame": f, "objects": [{"track_id": 7, "bbox": [0, 0, 10, 20], "class_id": 0, "class_name": "player", "team_id": 1}],
                           "ball_owner": 7, "possession_team": 1} for f in (2 * b, 2 * b + 1)}
        (folder / f"detections_batch_{b:04d}.json").write_text(json.dumps(frames, indent=1))
        pos = [{"frame": 2 * b, "timestamp": 0.1, "player_id": 7, "team_id": 1, "bbox": [0, 0, 10, 20], "position": [5.0, 10.0]}]
        (folder / f"positions_batch_{b:04d}.json").write_text(json.dumps(pos, indent=1))
        (folder / f"stats_batch_{b:04d}.json").write_text(json.dumps({
            "batch_idx": b, "start_frame": 2 * b, "end_frame": 2 * b + 1, "processing_time_ms": 50.0,
            "chunk_stats": {"frames_processed": 2, "detections_count": 2, "events_count": 0}}, indent=1))
    root = str(tmp_path / "out")
    det = readers.read_detections(spark, root).orderBy("frame").collect()
    assert [(r.match_id, r.batch_idx, r.frame, r.track_id, r.bbox.y2) for r in det] == [
        ("match-a", f // 2, f, 7, 20.0) for f in range(4)]
    assert [(r.batch_idx, r.x, r.field_x) for r in readers.read_positions(spark, root).orderBy("batch_idx").collect()] == [(0, 5.0, None), (1, 5.0, None)]
    assert readers.read_events(spark, root).count() == 0
    speed = readers.throughput(readers.read_chunk_stats(spark, root)).first()
    assert speed.frames_per_second == 40.0 and speed.overall_fps == 40.0
    (folder / "events_batch_0001.json").write_text(json.dumps([{"type": "pass", "frame": 3, "timestamp": 0.1, "team": 1, "from_player": 7, "to_player": 8}]))
    assert [(r.batch_idx, r.type, r.to_player) for r in readers.read_events(spark, root).collect()] == [(1, "pass", 8)]


def test_match_state_document(spark, tmp_path):
    doc = {"match_id": "m1", "fps": 30.0, "status": "completed", "total_frames_processed": 60, "last_batch_idx": 1,
           "last_update": "2026-01-02T03:04:05", "tracker_state": {"active_tracks": {"3": {"id": 3, "team_id": 0}}, "next_id": 4},
           "team_classifier_state": {"player_team_map": {"3": 0, "4": 1, "5": -1}},
           "possession_state": {"current_team": 0, "current_player": 3, "frames_by_team": {"0": 30, "1": 10, "-1": 20}, "passes_by_team": {"0": 2, "1": 1}}}
    (tmp_path / "m1.json").write_text(json.dumps(doc, indent=1))
    state = readers.read_match_state(spark, str(tmp_path))
    row = readers.state_summary(state).first()
    assert (row.percent_0, row.passes, row.players, row.players_1, row.active_tracks, row.total_seconds) == (50.0, 3, 3, 1, 1, 2.0)
    assert {(r.team, r.frames, r.passes) for r in readers.team_counters(state).collect()} == {(0, 30, 2), (1, 10, 1), (-1, 20, 0)}
    assert readers.match_exists(state, "m1") and not readers.match_exists(state, "m2")


def test_state_table(spark, tmp_path):
    path = str(tmp_path / "states")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "match_id string, n int")
    writers.save_state(df, path)
    writers.save_state(spark.createDataFrame([("b", 5)], df.schema), path)
    writers.delete_state(spark, path, spark.createDataFrame([("a",)], "match_id string"))
    assert [(r.match_id, r.n) for r in writers.read_states(spark, path).collect()] == [("b", 5)]


def test_stream_equals_batch_with_restart(spark, tmp_path):
    rows = [(m, f, 0, (f // 7 + m) % 2 if f % 5 else None, f % 3) for m in (1, 2) for f in range(60)]
    src, root = str(tmp_path / "src"), str(tmp_path / "job")
    whole = spark.createDataFrame(rows, live.OBSERVATION)
    seen = []
    hooks = live.Callbacks(on_batch_complete=lambda df, epoch: seen.append(epoch))
    for lo, hi in ((0, 25), (25, 60)):  # second start resumes from the checkpoint
        whole.filter(F.col("frame").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(live.OBSERVATION).parquet(src)
        live.start_job(live.possession_stream(stream, 3), f"{root}/cp", live.publish_stats(root, hooks=hooks)).awaitTermination()
    assert seen == [0, 1]
    frames = possession.possession_frames(whole, 3)
    want = {(r.match_id, r.team): (r.frames, r.passes) for r in
            possession.possession_stats(frames, pass_events=possession.passes(frames)).collect()}
    got = {(r.match_id, r.team): (r.frames, r.passes) for r in live.live_stats(spark, root).collect()}
    assert got == want


def test_late_rows_leave_the_state_alone(spark, tmp_path):
    """Rows come late by up to three micro-batches; with a delay those within it are put in order instead."""
    rows = [(1, f, 0, (f // 4) % 2, f % 3) for f in range(40)]
    arrival = [rows[0:5] + rows[6:10], rows[12:20] + rows[10:11], rows[20:30] + rows[11:12] + rows[5:6], rows[30:40] + [(1, None, None, None, None)]]
    for delay, lost in ((0, {11, 5}), (10, {5})):
        root = str(tmp_path / f"delay{delay}")
        for part in arrival:
            spark.createDataFrame([r if r[1] is not None else (1, 39, None, None, None) for r in part], live.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = live.possession_stream(live.observation_stream(spark, f"{root}/in", files=1), 3, delay)
            live.start_job(stream, f"{root}/cp", live.publish_stats(root)).awaitTermination()
        late = {r.frame for r in spark.read.parquet(f"{root}/late").collect()}
        assert late == lost
        kept = [r for r in rows if r[1] not in late]
        want = possession.possession_frames(spark.createDataFrame(kept, live.OBSERVATION), 3)
        got = {r.frame: r.current_team for r in spark.read.parquet(f"{root}/possession").collect()}
        assert got == {r.frame: r.current_team for r in want.collect()}


def test_errors_reach_the_hook(spark, tmp_path):
    """A failing sink ends the job; the hook gets the message and the checkpoint lets another job go on."""
    import time

    import pytest
    from pyspark.errors import StreamingQueryException

    root, errors, seen = str(tmp_path / "job"), [], []
    spark.createDataFrame([(1, f, 0, 0, 1) for f in range(5)], live.OBSERVATION).coalesce(1).write.parquet(f"{root}/in")
    listener = live.watch(spark, live.Callbacks(on_error=errors.append, on_progress=seen.append))

    def broken(batch, epoch):
        raise RuntimeError("disk is gone")

    try:
        for sink in (broken, live.publish_stats(root)):
            job = live.start_job(live.possession_stream(live.observation_stream(spark, f"{root}/in"), 3), f"{root}/cp", sink)
            if sink is broken:
                with pytest.raises(StreamingQueryException):
                    job.awaitTermination()
            else:
                job.awaitTermination()
        deadline = time.time() + 20
        while not (errors and seen) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert "disk is gone" in errors[0] and seen[-1]["rows"] == 5
    events = spark.read.schema(live.EVENT).parquet(f"{root}/events").collect()
    assert [(r.event, r.match_id, r.epoch, r.rows, r.last_frame) for r in events] == [("batch", 1, 0, 5, 4)]


def test_joined_segments_end_in_real_points(spark):
    """Flat pieces of one line, out of order and turned round, and a steep pair; a far piece stays by itself."""
    rows = [(1, 1, 0, "flat", 12.0, 50.0, 4.0, 51.0), (1, 1, 1, "flat", 10.0, 52.0, 20.0, 53.0), (1, 1, 2, "flat", 0.0, 400.0, 9.0, 401.0),
            (1, 1, 3, "steep", 5.0, 10.0, 6.0, 0.0), (1, 1, 4, "steep", 7.0, 8.0, 6.5, 19.0)]
    df = spark.createDataFrame(rows, "match_id long, frame long, seq long, orientation string, x1 double, y1 double, x2 double, y2 double")
    # a turned piece would tilt the mean angle by half a turn
    df = df.selectExpr("match_id", "frame", "seq", "orientation", *[
        f"if(orientation = 'flat' AND x1 > x2 OR orientation = 'steep' AND y1 > y2, {b}, {a}) AS {a}" for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    got = sorted((r.orientation, r.x1, r.y1, r.x2, r.y2) for r in keypoints.merge_collinear(df).collect())
    assert got == [("flat", 0.0, 400.0, 9.0, 401.0), ("flat", 4.0, 51.0, 20.0, 53.0), ("steep", 6.0, 0.0, 6.5, 19.0)]


def test_partitioned_layout_prunes_and_files_do_not_grow_with_tasks(spark, tmp_path):
    rows = [(m, f // 10, f, f, 100 + f) for m in ("a", "b", "7") for f in range(40)]
    df = spark.createDataFrame(rows, "match_id string, batch_idx long, frame long, seq long, track_id long").repartition(8)
    box = df.withColumns({n: F.lit(1.0) for n in ("x1", "y1", "x2", "y2")} | {"class_id": F.lit(0), "class_name": F.lit("player"), "team_id": F.lit(1)})
    docs, points, chunks = (str(tmp_path / n) for n in ("docs", "points", "chunks"))
    writers.write_detection_documents(box, docs)
    writers.write_batch_documents(box, points, "frame", F.col("track_id").alias("player_id"), F.array("x1", "y1").alias("position"))
    for found, value in ((readers.read_detections(spark, docs, "*.txt"), "track_id"), (readers.read_positions(spark, points, "*.txt"), "player_id")):
        assert sorted((r.match_id, r.batch_idx, r.frame, r[value]) for r in found.collect()) == sorted((r[0], r[1], r[2], r[4]) for r in rows)
        one = found.filter("match_id = '7' AND batch_idx = 2")
        plan = one._jdf.queryExecution().executedPlan().toString()
        part = plan[plan.index("PartitionFilters: ["):].split("]")[0]
        assert "match_id" in part and "batch_idx" in part
        assert sorted(r.frame for r in one.collect()) == list(range(20, 30))
    assert readers.read_events(spark, docs, "*.nothing").collect() == []
    writers.write_chunk_outputs(chunks, detections=df)
    writers.write_chunk_outputs(chunks, detections=df.filter("batch_idx = 1"))
    assert len(list((tmp_path / "chunks").rglob("*.parquet"))) == 3 * 4
    assert spark.read.parquet(f"{chunks}/detections").count() == len(rows)
