"""Readers for stored match outputs. Match and batch come from the path, which may be
`match_id=<match>/batch_idx=7/part-*.txt` or `<match>/detections_batch_0007.json`.

Folders of the first form are partitions: a filter on match_id or batch_idx lists and reads the folders it names only.
In the second form match and batch are cut out of every path. Writers with very many matches or batches pack them
(`writers.BUCKETS`): documents of one kind lie in Parquet files as rows of match_id, batch_idx and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

PLACE = ["match_id", "batch_idx"]


def folders_of(spark: SparkSession, path: str) -> str | None:
    """Column that the folder's first subfolder is named by (`match_id=...`), "" without one, None without a folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    entries = system.listStatusIterator(folder)
    while entries.hasNext():
        entry = entries.next()
        if entry.isDirectory() and not entry.getPath().getName().startswith(("_", ".")):
            column, given, _ = entry.getPath().getName().partition("=")
            return column if given else ""
    return ""


def _documents(spark: SparkSession, path: str, pattern: str, columns: str, form: str = "json", **options) -> DataFrame:
    """The files that match `pattern`, with match_id and batch_idx; `columns` is the schema of a document.

    Outside of partitions a batch number inside a document goes before that of its path. A folder without such files
    reads as an empty table, so absent files are not an error. Packed documents have no files of their own to match.
    """
    layout = folders_of(spark, path)
    if layout == schema.BUCKET:
        docs = spark.read.parquet(path).select(F.col("match_id").cast("string").alias("match_id"), "batch_idx", "value")
        if form == "text":
            return docs
        inner = columns.removeprefix("batch_idx bigint, ")
        return docs.select(*PLACE, F.inline(F.from_json("value", f"array<struct<{inner}>>")))
    reader = spark.read.option("pathGlobFilter", pattern).options(**options).format(form)
    if layout == "match_id":
        inner = columns.removeprefix("batch_idx bigint, ")
        rows = reader.schema(f"{inner}, match_id string, batch_idx bigint").load(path)
        return rows.select(*PLACE, *[c for c in rows.columns if c not in PLACE])
    file = F.col("_metadata.file_path")
    pick = lambda regex: F.nullif(F.regexp_extract(file, regex, 1), F.lit(""))
    match = F.coalesce(pick("match_id=([^/]+)/"), pick("([^/]+)/[^/]+$"))
    batch = F.coalesce(pick("batch_idx=([0-9]+)/"), pick("_batch_([0-9]+)")).cast("long")
    rows = reader.option("recursiveFileLookup", "true").schema(columns).load(path)
    if "batch_idx" in rows.columns:
        rows, batch = rows.withColumnRenamed("batch_idx", "__batch"), F.coalesce("__batch", batch)
    return rows.select(match.alias("match_id"), batch.alias("batch_idx"), *[c for c in rows.columns if c != "__batch"])


def read_detections(spark: SparkSession, path: str, pattern: str = "detections_batch_*") -> DataFrame:
    """Documents `{frame: record}`, one per batch, as a row per object."""
    docs = _documents(spark, path, pattern, "value string", "text", wholetext=True)
    rec = docs.select("match_id", "batch_idx", F.explode(
        F.from_json("value", schema.DETECTION_DOCUMENT)).alias("key", "r"))
    seq = F.posexplode("r.objects").alias("seq", "o")
    rows = rec.select("match_id", "batch_idx", F.col("key").cast("long").alias("frame"),
                      "r.ball_owner", "r.possession_team", seq)
    box = F.struct(*[F.get("o.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.select("match_id", "batch_idx", "frame", F.col("seq").cast("long").alias("seq"), "o.track_id",
                       "o.class_id", "o.class_name", "o.team_id", box.alias("bbox"), "ball_owner", "possession_team")


def read_positions(spark: SparkSession, path: str, pattern: str = "positions_batch_*") -> DataFrame:
    rows = _documents(spark, path, pattern, schema.POSITION, multiLine=True)
    xy = lambda name, i: F.get(name, F.lit(i))
    return rows.withColumns({
        "x": xy("position", 0), "y": xy("position", 1),
        "field_x": xy("field_position", 0), "field_y": xy("field_position", 1)}).drop("position", "field_position")


def read_events(spark: SparkSession, path: str, pattern: str = "events_batch_*") -> DataFrame:
    """Events of all batches; batches without a file had none."""
    return _documents(spark, path, pattern, schema.EVENT, multiLine=True)


def read_chunk_stats(spark: SparkSession, path: str, pattern: str = "stats_batch_*") -> DataFrame:
    rows = _documents(spark, path, pattern, schema.CHUNK_STATS, multiLine=True)
    return rows.select("match_id", "batch_idx", "start_frame", "end_frame", "processing_time_ms", "chunk_stats.*")


def throughput(stats: DataFrame, fps: float = 30.0) -> DataFrame:
    """Frames per second and real-time factor of every batch, with the match's overall figures."""
    speed = lambda frames, ms: F.when(ms > 0, frames * 1000.0 / ms)
    whole = stats.groupBy("match_id").agg(F.sum("frames_processed").alias("f"), F.sum("processing_time_ms").alias("ms"))
    whole = whole.select("match_id", speed(F.col("f"), F.col("ms")).alias("overall_fps"))
    out = stats.withColumn("frames_per_second", speed(F.col("frames_processed"), F.col("processing_time_ms")))
    return out.join(whole, "match_id").withColumns({
        "realtime": F.col("frames_per_second") / fps, "overall_realtime": F.col("overall_fps") / fps})


def read_match_state(spark: SparkSession, path: str) -> DataFrame:
    if folders_of(spark, path) == schema.BUCKET:
        fields = f"struct<{schema.MATCH_STATE}>"
        return spark.read.parquet(path).select(F.from_json("value", fields).alias("s")).select("s.*")
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema(
        schema.MATCH_STATE).json(path, multiLine=True)


def team_counters(state: DataFrame) -> DataFrame:
    """Frames and passes per team; the string keys become numbers."""
    def rows(name: str) -> DataFrame:
        return state.select("match_id", F.explode(f"possession_state.{name}_by_team").alias("k", name)).select(
            "match_id", F.col("k").cast("int").alias("team"), name)
    return rows("frames").join(rows("passes"), ["match_id", "team"], "full").fillna(0)


def state_summary(state: DataFrame) -> DataFrame:
    """One row per match: progress, possession percent of all teams, passes, players, tracks."""
    frames, made = "possession_state.frames_by_team", "possession_state.passes_by_team"
    total = F.aggregate(F.map_values(frames), F.lit(0).cast("long"), lambda a, v: a + v)
    passes = F.aggregate(F.map_values(made), F.lit(0).cast("long"), lambda a, v: a + v)
    share = lambda t: F.when(total > 0, F.coalesce(F.col(frames)[t], F.lit(0)) * 100.0 / total).otherwise(0.0)
    squad = F.map_values("team_classifier_state.player_team_map")
    count = lambda t: F.size(F.filter(squad, lambda v: v == t))
    return state.select(
        "match_id", "status", F.col("total_frames_processed").alias("total_frames"),
        F.when(F.col("fps") > 0, F.col("total_frames_processed") / F.col("fps")).otherwise(0.0).alias("total_seconds"),
        F.col("last_batch_idx").alias("last_batch"), F.to_timestamp("last_update").alias("last_update"),
        "possession_state.current_team", "possession_state.current_player",
        share("0").alias("percent_0"), share("1").alias("percent_1"), passes.alias("passes"),
        F.size(squad).alias("players"), count(0).alias("players_0"), count(1).alias("players_1"),
        F.size("tracker_state.active_tracks").alias("active_tracks"), F.col("tracker_state.next_id").alias("total_ids"))


def read_heatmap_points(spark: SparkSession, path: str) -> DataFrame:
    """Point exports with one list per team, as one table."""
    docs = _documents(spark, path, "*", schema.HEATMAP_POINTS, multiLine=True)
    parts = [docs.select("match_id", F.lit(t).alias("team"), F.inline(f"team_{t}")) for t in (0, 1)]
    return parts[0].unionByName(parts[1]).select(
        "match_id", "team", "frame", "track_id", F.get("position", F.lit(0)).alias("x"),
        F.get("position", F.lit(1)).alias("y"), "method")


def list_matches(table: DataFrame) -> DataFrame:
    return table.select("match_id").distinct()


def match_exists(table: DataFrame, match_id) -> bool:
    return not table.filter(F.col("match_id") == match_id).limit(1).isEmpty()


def remaining(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Batches not processed yet."""
    return batches.join(done.select("match_id", "batch_idx").distinct(), ["match_id", "batch_idx"], "left_anti")
