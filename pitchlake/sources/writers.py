"""Writers. Tables are partitioned by match (and batch), so readers of one match prune the rest, and
rewriting a batch or a match replaces its partition only.

A folder and a file for every match and batch cost a rename and a listing each, so a table that begins with more than
FOLDERS of them is packed: its matches and batches are dealt by hash into BUCKETS folders, with match_id and batch_idx
as columns. Rewriting replaces the same rows there, by writing anew the buckets that hold them; a packed table takes
one writer at a time. A table keeps the form it began with."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from ..session import durable
from .readers import folders_of
from .schema import BUCKET

FOLDERS, BUCKETS = 256, 128


def _packed(df: DataFrame, held: str | None, partitions: tuple[str, ...]) -> bool:
    return held == BUCKET if held else df.select(*partitions).distinct().limit(FOLDERS + 1).count() > FOLDERS


def _bucketed(df: DataFrame, partitions: tuple[str, ...]) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*partitions), F.lit(BUCKETS)).cast("int"))


def _write_packed(rows: DataFrame, path: str, partitions: tuple[str, ...], mode: str) -> None:
    # a bucket is a task, and no smaller one is merged with it
    (rows.repartition(BUCKETS, BUCKET).sortWithinPartitions(BUCKET, *partitions).write.mode("overwrite")
     .option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(path))


def _overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    held = folders_of(df.sparkSession, path)
    if not _packed(df, held, partitions):
        # one task writes all of a partition, or every task would write a file into every partition; a partition is a
        # batch of frames, or a match reduced to cells or a state, so it stays small
        (df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partitions).parquet(path))
        return
    rows = _bucketed(df, partitions)
    if held:
        rows = durable(rows)
        old = df.sparkSession.read.parquet(path)
        new = rows.select(BUCKET, *[F.col(p).alias(f"__{p}") for p in partitions]).distinct()
        kept = old.join(new.select(BUCKET).distinct(), BUCKET, "left_semi")
        kept = kept.join(new.drop(BUCKET), [kept[p].eqNullSafe(F.col(f"__{p}")) for p in partitions], "left_anti")
        rows = durable(kept.unionByName(rows, allowMissingColumns=True))
    _write_packed(rows, path, partitions, "dynamic")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (match_id, batch_idx, value): a text file each, or packed as rows."""
    place = ("match_id", "batch_idx")
    held = folders_of(docs.sparkSession, path)
    whole = docs.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    if not _packed(docs, None if whole else held, place):
        docs.repartition(*place).write.mode("overwrite").partitionBy(*place).text(path)
    elif whole:
        _write_packed(_bucketed(docs, place), path, place, "static")
    else:
        _overwrite(docs, path, *place)


def write_chunk_outputs(root: str, detections: DataFrame | None = None, positions: DataFrame | None = None,
                        events: DataFrame | None = None, stats: DataFrame | None = None) -> None:
    """Outputs of some batches; writing a batch again replaces it. A batch without events leaves no
    event partition. Rows need match_id and batch_idx."""
    for name, df in (("detections", detections), ("positions", positions), ("events", events), ("stats", stats)):
        if df is not None:
            _overwrite(df, f"{root}/{name}", "match_id", "batch_idx")


def write_detection_documents(detections: DataFrame, path: str) -> None:
    """The `{frame: record}` documents, one per match and batch. A batch is a fixed number of frames,
    so a document stays small."""
    obj = F.struct("seq", F.struct("track_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), "class_id",
                                   "class_name", "team_id").alias("o"))
    frames = detections.groupBy("match_id", "batch_idx", "frame").agg(
        F.transform(F.sort_array(F.collect_list(obj)), lambda e: e["o"]).alias("objects"))
    docs = frames.groupBy("match_id", "batch_idx").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("frame").cast("string"), F.struct("frame", "objects"))))).alias("value"))
    write_documents(docs, path)


def write_batch_documents(rows: DataFrame, path: str, *columns) -> None:
    """One JSON array of the rows per match and batch (a batch is a fixed number of frames)."""
    docs = rows.groupBy("match_id", "batch_idx").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    write_documents(docs, path)


def write_match_states(states: DataFrame, path: str) -> None:
    """One JSON document per match, in a folder of its own or packed."""
    if _packed(states, None, ("match_id",)):
        docs = states.select("match_id", F.to_json(F.struct(*states.columns)).alias("value"))
        _write_packed(_bucketed(docs, ("match_id",)), path, ("match_id",), "static")
    else:
        states.withColumn("m", F.col("match_id")).write.partitionBy("m").json(path)


def save_state(states: DataFrame, path: str) -> None:
    """Insert or replace the state of each match in `states`."""
    _overwrite(states.withColumn("deleted", F.lit(False)), path, "match_id")


def delete_state(spark: SparkSession, path: str, match_ids: DataFrame) -> None:
    """Replace a match's partition by a tombstone; `read_states` leaves it out."""
    known = spark.read.parquet(path)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields
             if f.name not in ("match_id", "deleted", BUCKET)]
    _overwrite(match_ids.select("match_id", *blank, F.lit(True).alias("deleted")), path, "match_id")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(~F.col("deleted")).drop("deleted", BUCKET)


def export_heatmaps(positions: DataFrame, zone_frames: DataFrame, root: str, nx: int = spatial.NX, ny: int = spatial.NY,
                    partition: str = "thirds_lanes") -> None:
    """Cells, zone counts with percents, and one metadata row per match."""
    cells = spatial.normalise(spatial.heatmap(positions, nx=nx, ny=ny), "max")
    _overwrite(cells, f"{root}/cells", "match_id")
    _overwrite(zone_frames, f"{root}/zones", "match_id")
    meta = positions.groupBy("match_id").agg(F.count(F.lit(1)).alias("points")).select(
        "match_id", "points", F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(partition).alias("partition_type"))
    _overwrite(meta, f"{root}/metadata", "match_id")


def log_status(spark: SparkSession, path: str, match_ids: DataFrame, status: str, error: str | None = None) -> None:
    """Append a lifecycle record: running, completed or failed."""
    if status not in ("running", "completed", "failed"):
        raise ValueError(f"unknown status {status}")
    now = datetime.now(timezone.utc).isoformat()
    match_ids.select("match_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"),
                     F.lit(now).cast("timestamp").alias("at")).write.mode("append").parquet(path)


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.parquet(path)
    return log.groupBy("match_id").agg(F.max_by(F.struct("status", "error", "at"), "at").alias("s")).select("match_id", "s.*")
