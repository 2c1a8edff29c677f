"""Structured Streaming jobs: possession per match with keyed state, and idempotent sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scan

OBSERVATION = "match_id long, frame long, seq long, team long, player long"
POSSESSION = ("match_id long, frame long, seq long, team long, player long, current_team long, prev_team long, "
              "changed boolean, frames_prev long, frames_first long, pass_from long")


def batch_size(fps: float = 30.0, seconds: float = 3.0) -> int:
    return int(fps * seconds)


def batch_index(size: int, frame: str = "frame") -> Column:
    """Micro-batch number of a frame; the last batch of a match may be short."""
    return scan.block_of(frame, size)


def hysteresis_step(state: dict, rows, n: int) -> tuple[list[tuple], dict]:
    """Possession over ordered (match_id, frame, seq, team, player) rows from a saved state."""
    s, out = dict(state), []
    for match_id, frame, seq, team, player in rows:
        prev, changed, passed_from = s["current"], False, None
        gap = frame - s["frame"] if prev is not None else 0
        s["run"] = s["run"] + 1 if team == s["candidate"] else 1
        s["candidate"] = team
        if team is not None and (prev is None or (team != prev and s["run"] >= n)):
            changed = prev is not None
            s["current"], s["player"] = team, None if changed else player
        elif team is not None and team == prev and player is not None:
            if s["player"] is not None and s["player"] != player:
                passed_from = s["player"]
            s["player"] = player
        s["frame"] = frame
        out.append((match_id, frame, seq, team, player, s["current"], prev, changed, gap,
                    int(prev is None and s["current"] is not None), passed_from))
    return out, s


START = {"current": None, "player": None, "candidate": None, "run": 0, "frame": 0}
LATE_POSSESSION = f"{POSSESSION}, late boolean"


def observation_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Observations from Parquet files as they arrive; `files` caps a micro-batch, so that a backlog is not one batch."""
    reader = spark.readStream.schema(OBSERVATION)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def possession_stream(observations: DataFrame, n: int = 5, delay: int = 0) -> DataFrame:
    """Stateful possession with late rows told apart: POSSESSION columns and `late`, one small state per match.

    The state keeps the newest frame of its match and the rows of the last `delay` frames, which wait there in case
    earlier ones still come. Older rows are folded in order of (frame, seq) and come out. A row that is older than what
    has been folded in an earlier micro-batch can't be folded any more: it comes out at once, flagged late and without
    possession, and leaves the state as it is. With `delay` a row without seq closes its match: what waits comes out.
    """
    names = [c.split()[0] for c in LATE_POSSESSION.split(", ")]
    unknown = (None,) * (len(names) - 6)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"possession": START, "mark": None, "waiting": []}
        mark, waiting, late, closed = held["mark"], held["waiting"], [], False
        none = lambda v: None if pd.isna(v) else int(v)
        newest = max([mark or 0] + [r[1] for r in waiting])
        for pdf in batches:
            rows = [tuple(map(none, r)) for r in zip(pdf["match_id"], pdf["frame"], pdf["seq"], pdf["team"], pdf["player"])]
            closed = closed or any(r[2] is None for r in rows)
            rows = [r for r in rows if r[2] is not None]
            late += [r for r in rows if mark is not None and r[1] < mark]
            waiting += [r for r in rows if mark is None or r[1] >= mark]
            newest = max([newest] + [r[1] for r in rows])
        ready = sorted((tuple(r) for r in waiting if closed or r[1] <= newest - delay), key=lambda r: (r[1], r[2]))
        out, possession = hysteresis_step(held["possession"], ready, n)
        state.update((json.dumps({"possession": possession, "mark": ready[-1][1] if ready else mark,
                                  "waiting": [] if closed else [r for r in waiting if r[1] > newest - delay]}),))
        res = pd.DataFrame([(*r, False) for r in out] + [(*r, *unknown, True) for r in late], columns=names)
        yield res.astype({c: "Int64" for c in names[3:] if c not in ("changed", "late")}).astype({"changed": "boolean"})

    return observations.groupBy("match_id").applyInPandasWithState(
        step, LATE_POSSESSION, "s string", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Callbacks:
    """Hooks of a running job. All run on the driver, per micro-batch."""

    on_batch_complete: Callable[[DataFrame, int], None] | None = None
    on_progress: Callable[[dict], None] | None = None
    on_error: Callable[[str], None] | None = None


EVENT = "event string, match_id long, epoch long, rows long, last_frame long, message string"


def batch_events(batch: DataFrame, epoch: int) -> DataFrame:
    """What a finished micro-batch did, one row per match, as EVENT rows."""
    return batch.groupBy("match_id").agg(F.count("*").alias("rows"), F.max("frame").alias("last_frame")).select(
        F.lit("batch").alias("event"), "match_id", F.lit(epoch).cast("long").alias("epoch"), "rows", "last_frame", F.lit(None).cast("string").alias("message"))


class _Listener(StreamingQueryListener):
    def __init__(self, hooks: Callbacks):
        self.hooks = hooks

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if self.hooks.on_progress:
            self.hooks.on_progress({"batch": event.progress.batchId, "rows": event.progress.numInputRows,
                                    "rows_per_second": event.progress.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception and self.hooks.on_error:
            self.hooks.on_error(event.exception)


def watch(spark: SparkSession, hooks: Callbacks) -> StreamingQueryListener:
    """Call the hooks for progress and errors of every stream of the session, until `spark.streams.removeListener`."""
    listener = _Listener(hooks)
    spark.streams.addListener(listener)
    return listener


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Rows of one micro-batch in a folder of their own: a replay overwrites itself, and an epoch
    without rows still leaves an empty file with the schema."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def publish_stats(root: str, alerts: Callable[[DataFrame, int], DataFrame] | None = None,
                  hooks: Callbacks | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: possession rows, late rows, per-team increments, events and, if asked, alerts, an epoch at a time."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            write_epoch(batch.filter("NOT late").drop("late"), f"{root}/possession", epoch)
            # read back: tasks over the batch itself report the figures of all state partitions to the driver every time
            taken = batch.sparkSession.read.schema(POSSESSION).parquet(f"{root}/possession/epoch={epoch}")
            write_epoch(batch.filter("late").select("match_id", "frame", "seq", "team", "player"), f"{root}/late", epoch)
            credit = F.explode(F.array(
                F.struct(F.col("prev_team").alias("team"), F.col("frames_prev").alias("frames"), F.lit(0).alias("passes")),
                F.struct(F.col("current_team").alias("team"), F.col("frames_first").alias("frames"),
                         F.col("pass_from").isNotNull().cast("int").alias("passes"))))
            steps = taken.select("match_id", credit.alias("c")).filter("c.team is not null").groupBy(
                "match_id", "c.team").agg(F.sum("c.frames").alias("frames"), F.sum("c.passes").alias("passes"))
            write_epoch(steps, f"{root}/live_steps", epoch)
            write_epoch(batch_events(taken, epoch), f"{root}/events", epoch)
            if alerts is not None:
                write_epoch(alerts(taken, epoch), f"{root}/alerts", epoch)
            if hooks and hooks.on_batch_complete:
                hooks.on_batch_complete(taken, epoch)
        finally:
            batch.unpersist()
    return sink


def live_dominance(root: str, limit: float = 60.0) -> Callable[[DataFrame, int], DataFrame]:
    """Alerts for `publish_stats`: teams that hold `limit` percent of the ball so far, for the matches of a micro-batch, at its last frame."""
    def alerts(batch: DataFrame, epoch: int) -> DataFrame:
        steps = batch.sparkSession.read.schema("match_id long, team long, frames long, passes long, epoch int").parquet(f"{root}/live_steps")
        ends = batch.groupBy("match_id").agg(F.max("frame").alias("frame"))
        # a replayed epoch must not count what later ones have written
        total = steps.filter(F.col("epoch") <= epoch).join(ends, "match_id").groupBy("match_id", "frame", "team").agg(F.sum("frames").alias("frames"))
        whole = total.groupBy("match_id").agg(F.sum("frames").alias("all"))
        share = total.join(whole, "match_id").withColumn("percent", F.col("frames") * 100.0 / F.col("all"))
        return share.filter(F.col("percent") >= limit).select("match_id", "frame", "team", "percent")
    return alerts


def live_stats(spark: SparkSession, root: str, fps: float = 30.0) -> DataFrame:
    """Cumulative frames, seconds, passes and share per team, from the increments written so far."""
    total = spark.read.parquet(f"{root}/live_steps").groupBy("match_id", "team").agg(
        F.sum("frames").alias("frames"), F.sum("passes").alias("passes"))
    whole = total.groupBy("match_id").agg(F.sum("frames").alias("all"))
    return total.join(whole, "match_id").select(
        "match_id", "team", "frames", "passes", (F.col("frames") / fps).alias("seconds"),
        (F.col("frames") * 100.0 / F.col("all")).alias("percent"))


def guard_order(root: str, accept: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: rows older than the newest frame already taken of their match go to the
    `late` table, the rest to `accept`. Each epoch writes the marks it leaves behind (one row per
    match), so a replayed epoch reads the same marks again."""
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{root}/marks"
        before = batch.select("match_id", F.col("frame").alias("mark")).limit(0)
        if epoch > 0:
            # one epoch's folder only; the schema is given, so an epoch without rows reads as empty
            before = spark.read.schema(before.schema).parquet(f"{marks}/epoch={epoch - 1}")
        rows = batch.join(before, "match_id", "left")
        late = F.coalesce(F.col("frame") < F.col("mark"), F.lit(False))
        write_epoch(rows.filter(late).drop("mark"), f"{root}/late", epoch)
        fresh = rows.filter(~late).drop("mark")
        accept(fresh, epoch)
        newest = before.unionByName(fresh.select("match_id", F.col("frame").alias("mark")))
        write_epoch(newest.groupBy("match_id").agg(F.max("mark").alias("mark")), marks, epoch)
    return step


def start_job(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None],
              seconds: float | None = None, tasks: int | None = None) -> StreamingQuery:
    """Run a foreachBatch sink; the checkpoint folder is what a restarted job resumes from. Without
    `seconds` it drains what is there and stops.

    `tasks` is the number of state partitions of a new checkpoint, by default twice the cores, 64 at least, and never more
    than the session's shuffle partitions. Every task reports a figure for each of them to the driver, so those reports
    grow with the square of that number; it follows the cluster and not the input.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    wanted = int(conf.get(name))
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    conf.set(name, str(min(wanted, tasks or max(64, 2 * stream.sparkSession.sparkContext.defaultParallelism))))
    try:
        return writer.trigger(**trigger).start()  # the job keeps a copy of the settings
    finally:
        conf.set(name, str(wanted))
