"""Possession with hysteresis and everything read off it.

Input: one row per observation (`match_id, frame, seq, team, player`); team null means nobody
holds the ball. Order inside a match is (frame, seq).

Hysteresis needs no state machine. A team is confirmed on the row where it has been seen `n` times
in a row (null breaks a run), the first team seen is confirmed at once, and the team in possession
is the last confirmed one. `possession_frames` evaluates this in blocks of frames, see `scan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import percent
from . import scan

KEYS = ["match_id"]
ORDER = ["frame", "seq"]
BLOCK_FRAMES = 8192


def possession_frames(obs: DataFrame, n: int = 5, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Adds `current_team, prev_team, prev_frame, changed, frames_prev, frames_first`.

    Rows are shuffled by (match, block), never by match alone. Each block is reduced to one summary
    row (its first and last run, its last confirmation), the summaries are chained per match, and the
    chain state at block entry is joined back on the same partitioning.
    """
    keyed = [*KEYS, scan.BLOCK]
    inside = Window.partitionBy(*keyed).orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = obs.withColumn(scan.BLOCK, scan.block_of("frame", block_frames))
    rows = (rows
            .withColumn("__before", F.lag(F.struct(F.col("team").alias("t"))).over(inside))
            .withColumn("__rn", F.row_number().over(inside).cast("long"))
            .withColumn("__start", F.col("__before").isNull()
                        | ~F.col("__before.t").eqNullSafe(F.col("team"))))
    rows = (rows
            .withColumn("__run", F.sum(F.col("__start").cast("long")).over(so_far))
            .withColumn("__len", F.col("__rn") - F.max(F.when(F.col("__start"), F.col("__rn")))
                        .over(so_far) + 1))

    held = F.when(F.col("team").isNotNull() & (F.col("__len") >= n), F.col("__rn"))
    boxed = F.struct(F.col("team").alias("t"))
    blocks = rows.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("__run").alias("runs"), F.max("frame").alias("last_frame"),
        F.min_by(boxed, "__rn").alias("head"), F.max_by(boxed, "__rn").alias("tail"),
        F.max(F.when(F.col("__run") == 1, F.col("__len"))).alias("head_len"),
        F.max_by("__len", "__rn").alias("tail_len"),
        F.max_by("team", held).alias("confirmed"),
        F.min_by("team", F.when(F.col("team").isNotNull(), F.col("__rn"))).alias("first_team"))

    chain = Window.partitionBy(*KEYS).orderBy(scan.BLOCK)
    upto = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (blocks
              .withColumn("in_tail", F.lag("tail").over(chain))
              .withColumn("linked", F.col("in_tail").isNotNull()
                          & F.col("in_tail.t").eqNullSafe(F.col("head.t")))
              .withColumn("end_pos", F.sum("cnt").over(upto)))
    # where the run open at the end of a block began, as a position in the match
    began = F.when(~F.col("linked") | (F.col("runs") > 1), F.col("end_pos") - F.col("tail_len"))
    blocks = (blocks
              .withColumn("open_len", F.col("end_pos") - F.last(began, ignorenulls=True).over(upto))
              .withColumn("in_len", F.when(F.col("linked"), F.lag("open_len").over(chain))))
    joined_run = F.when(F.col("head.t").isNotNull()
                        & (F.col("head_len") + F.coalesce("in_len", F.lit(0)) >= n), F.col("head.t"))
    blocks = (blocks
              .withColumn("out_team", F.coalesce(
                  F.last(F.coalesce("confirmed", joined_run), ignorenulls=True).over(upto),
                  F.first("first_team", ignorenulls=True).over(upto)))
              .select(*keyed, "in_len",
                      F.lag("out_team").over(chain).alias("in_team"),
                      F.lag("last_frame").over(chain).alias("in_frame")))

    rows = rows.join(blocks, keyed)
    length = F.col("__len") + F.when(F.col("__run") == 1, F.coalesce("in_len", F.lit(0))).otherwise(0)
    confirmed = F.when(F.col("team").isNotNull() & (length >= n), F.col("team"))
    rows = (rows
            .withColumn("current_team", F.coalesce(
                F.last(confirmed, ignorenulls=True).over(so_far), F.col("in_team"),
                F.first("team", ignorenulls=True).over(so_far)))
            .withColumn("prev_team", F.coalesce(F.lag("current_team").over(inside), F.col("in_team")))
            .withColumn("prev_frame", F.coalesce(F.lag("frame").over(inside), F.col("in_frame"))))
    started = F.col("current_team").isNotNull() & F.col("prev_team").isNull()
    return rows.select(
        *obs.columns, "current_team", "prev_team", "prev_frame",
        (F.col("prev_team").isNotNull() & (F.col("prev_team") != F.col("current_team"))).alias("changed"),
        # the gap since the previous observation belongs to the team that held the ball before it
        F.when(F.col("prev_team").isNotNull(), F.col("frame") - F.col("prev_frame"))
        .otherwise(0).alias("frames_prev"),
        started.cast("long").alias("frames_first"))


def attributed_frames(frames: DataFrame) -> DataFrame:
    """Frames credited per row: (match_id, frame, seq, team, frames), zero credits dropped."""
    credit = F.explode(F.array(
        F.struct(F.col("prev_team").alias("team"), F.col("frames_prev").alias("frames")),
        F.struct(F.col("current_team").alias("team"), F.col("frames_first").alias("frames"))))
    return (frames.select(*KEYS, *ORDER, credit.alias("c"))
            .select(*KEYS, *ORDER, F.col("c.team").alias("team"), F.col("c.frames").alias("frames"))
            .filter(F.col("frames") > 0))


def passes(frames: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Same team, other player. A confirmed change forgets the player, so the confirming row does
    not count as a pass origin; the row that opens the match does."""
    matching = F.col("team").isNotNull() & (F.col("team") == F.col("current_team"))
    mark = (F.when(F.col("changed"), F.struct(F.lit(None).cast("long").alias("p")))
            .when(matching & F.col("player").isNotNull(),
                  F.struct(F.col("player").cast("long").alias("p"))))
    seen = scan.prefix_scan(frames, KEYS, ORDER, scan.block_of("frame", block_frames),
                            {"__mark": scan.last_seen(mark, before=True)})
    return (seen.filter(matching & ~F.col("changed") & F.col("player").isNotNull()
                        & F.col("__mark.p").isNotNull() & (F.col("__mark.p") != F.col("player")))
            .select(*KEYS, *ORDER, F.col("current_team").alias("team"),
                    F.col("__mark.p").alias("from_player"), F.col("player").alias("to_player")))


def possession_changes(frames: DataFrame) -> DataFrame:
    return frames.filter("changed").select(
        *KEYS, *ORDER, F.col("prev_team").alias("from_team"), F.col("current_team").alias("to_team"),
        F.col("player").alias("player_id"))


def timeline(frames: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Possession segments (start_frame, end_frame, team); the last one ends at the last frame."""
    opened = frames.filter(F.col("changed") | (F.col("frames_first") == 1)).select(
        *KEYS, "frame", "seq", F.col("current_team").alias("team"),
        (-F.col("frame")).alias("__f"), (-F.col("seq")).alias("__s"))
    # looking ahead is looking back along the reversed order
    segs = scan.prefix_scan(opened, KEYS, ["__f", "__s"], scan.block_of("__f", block_frames),
                            {"__next": scan.previous("frame")})
    last = frames.groupBy(*KEYS).agg(F.max("frame").alias("__last"))
    return segs.join(last, KEYS).select(
        *KEYS, F.col("frame").alias("start_frame"),
        F.coalesce("__next", "__last").alias("end_frame"), "team", "seq")


def possession_stats(frames: DataFrame, teams=(0, 1), fps: float = 30.0,
                     pass_events: DataFrame | None = None) -> DataFrame:
    """Frames, seconds, percent of the last frame id and passes, one row per match and team."""
    credit = attributed_frames(frames).groupBy(*KEYS, "team").agg(F.sum("frames").alias("frames"))
    ends = frames.groupBy(*KEYS).agg(
        F.when(F.count("current_team") > 0, F.max("frame")).otherwise(0).alias("total_frames"))
    grid = ends.withColumn("team", F.explode(F.array(*[F.lit(t).cast("long") for t in teams])))
    out = grid.join(credit, [*KEYS, "team"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    if pass_events is not None:
        out = out.join(passes_by_team(pass_events), [*KEYS, "team"], "left").withColumn(
            "passes", F.coalesce("passes", F.lit(0)))
    return out.withColumns({"seconds": F.col("frames") / F.lit(fps),
                            "percent": percent("frames", "total_frames")})


def passes_by_team(pass_events: DataFrame) -> DataFrame:
    return pass_events.groupBy(*KEYS, "team").agg(F.count(F.lit(1)).alias("passes"))


def final_stats(credits: DataFrame) -> DataFrame:
    """Share over real teams only (ids >= 0)."""
    per_team = (credits.filter(F.col("team") >= 0).groupBy(*KEYS, "team")
                .agg(F.sum("frames").alias("frames")))
    whole = F.sum("frames").over(Window.partitionBy(*KEYS))  # at most one row per team
    return per_team.withColumn("percent", percent("frames", whole))


def match_summary(frames: DataFrame, pass_events: DataFrame, detections: DataFrame,
                  fps: float = 30.0) -> DataFrame:
    """One row per match: progress, possession of all teams, passes, players."""
    credit = attributed_frames(frames).groupBy(*KEYS).agg(
        F.sum("frames").alias("possession_frames"),
        *[F.sum(F.when(F.col("team") == t, F.col("frames")).otherwise(0)).alias(f"frames_{t}")
          for t in (0, 1)])
    ends = frames.groupBy(*KEYS).agg(
        F.max("frame").alias("total_frames"),
        F.max_by("current_team", F.struct(*ORDER)).alias("current_team"))
    made = pass_events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("passes"))
    teams = (detections.groupBy(*KEYS, "track_id").agg(F.max("team_id").alias("team_id"))
             .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("players"),
                                 *[F.sum((F.col("team_id") == t).cast("long")).alias(f"players_{t}")
                                   for t in (0, 1)]))
    out = ends.join(credit, KEYS, "left").join(made, KEYS, "left").join(teams, KEYS, "left")
    zero = ["possession_frames", "frames_0", "frames_1", "passes", "players", "players_0", "players_1"]
    out = out.fillna(0, subset=zero)
    return out.withColumns({
        "total_seconds": F.col("total_frames") / F.lit(fps),
        "percent_0": percent("frames_0", "possession_frames"),
        "percent_1": percent("frames_1", "possession_frames")})


def chunk_stats(frames: DataFrame, pass_events: DataFrame, detections: DataFrame,
                size: int) -> DataFrame:
    """Per micro-batch: frames, detections, events and the state at its end."""
    batch = scan.block_of("frame", size)
    seen = frames.groupBy(*KEYS, batch.alias("batch_idx")).agg(
        F.countDistinct("frame").alias("frames_processed"),
        F.sum(F.col("changed").cast("long")).alias("changes"),
        F.max_by("current_team", F.struct(*ORDER)).alias("possession_team"))
    boxes = detections.groupBy(*KEYS, batch.alias("batch_idx")).agg(
        F.count(F.lit(1)).alias("detections_count"))
    made = pass_events.groupBy(*KEYS, batch.alias("batch_idx")).agg(F.count(F.lit(1)).alias("passes"))
    on = [*KEYS, "batch_idx"]
    return (seen.join(boxes, on, "left").join(made, on, "left")
            .fillna(0, subset=["detections_count", "passes"])
            .withColumn("events_count", F.col("changes") + F.col("passes"))
            .drop("changes", "passes"))


def coverage(frames: DataFrame) -> DataFrame:
    """Credited frames against the last frame id."""
    got = attributed_frames(frames).groupBy(*KEYS).agg(F.sum("frames").alias("assigned"))
    ends = frames.groupBy(*KEYS).agg(F.max("frame").alias("last_frame"))
    return (ends.join(got, KEYS, "left").fillna(0, subset=["assigned"])
            .withColumn("complete", F.col("assigned") == F.col("last_frame")))


def current_state(frames: DataFrame) -> DataFrame:
    """Team, frame and whether tracking has begun, at the last observation."""
    return frames.groupBy(*KEYS).agg(
        F.max_by("current_team", F.struct(*ORDER)).alias("team"), F.max("frame").alias("frame"),
        (F.count("current_team") > 0).alias("initialized"))


def match_events(frames: DataFrame, pass_events: DataFrame, fps: float = 30.0,
                 zone=None) -> DataFrame:
    """Passes, possession changes and the losses they imply, as one table."""
    zone = F.lit(None).cast("string") if zone is None else zone
    none = F.lit(None).cast("long")
    changes = possession_changes(frames)

    def shaped(df, kind, team, from_team=none, to_team=none, origin=none, target=none):
        return df.select(*KEYS, *ORDER, F.lit(kind).alias("type"),
                         (F.col("frame") / F.lit(fps)).alias("timestamp"), team.alias("team"),
                         from_team.alias("from_team"), to_team.alias("to_team"),
                         origin.alias("from_player"), target.alias("to_player"), zone.alias("zone"))

    return (shaped(pass_events, "pass", F.col("team"), origin=F.col("from_player"), target=F.col("to_player"))
            .unionByName(shaped(changes, "possession_change", none, F.col("from_team"), F.col("to_team"),
                                target=F.col("player_id").cast("long")))
            .unionByName(shaped(changes, "possession_loss", F.col("from_team"))))


def recent_passes(pass_events: DataFrame, size: int, n: int = 10) -> DataFrame:
    """Last n passes of each micro-batch. The rank filter lets Spark cut each map task to n rows
    per batch before the shuffle."""
    events = pass_events.withColumn("batch_idx", scan.block_of("frame", size))
    w = Window.partitionBy(*KEYS, "batch_idx").orderBy(F.col("frame").desc(), F.col("seq").desc())
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def timeline_preview(segments: DataFrame, n: int = 3) -> DataFrame:
    """First n and last n segments of a match, each segment once."""
    order = ["start_frame", "seq"]
    head = Window.partitionBy(*KEYS).orderBy(*order)
    tail = Window.partitionBy(*KEYS).orderBy(*[F.col(o).desc() for o in order])
    first = segments.withColumn("__r", F.row_number().over(head)).filter(F.col("__r") <= n).drop("__r")
    last = segments.withColumn("__r", F.row_number().over(tail)).filter(F.col("__r") <= n).drop("__r")
    return first.unionByName(last).dropDuplicates([*KEYS, *order])


def timeline_chart(segments: DataFrame, fps: float = 30.0, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Segment number and duration in seconds, in order."""
    numbered = scan.with_position(segments, KEYS, ["start_frame", "seq"],
                                  scan.block_of("start_frame", block_frames), "segment")
    return numbered.withColumn("duration", (F.col("end_frame") - F.col("start_frame")) / F.lit(fps))


def cumulative_progress(frames: DataFrame, pass_events: DataFrame, size: int,
                        teams=(0, 1)) -> DataFrame:
    """Running frames, passes and changes at the end of each micro-batch, one row per team.

    Rows are reduced to one per (match, batch, team) first; the running sums go over those.
    """
    batch = scan.block_of("frame", size).alias("batch_idx")
    credit = attributed_frames(frames).groupBy(*KEYS, batch, "team").agg(F.sum("frames").alias("df"))
    made = pass_events.groupBy(*KEYS, batch, "team").agg(F.count(F.lit(1)).alias("dp"))
    seen = frames.groupBy(*KEYS, batch).agg(F.sum(F.col("changed").cast("long")).alias("dc"))
    grid = seen.withColumn("team", F.explode(F.array(*[F.lit(t).cast("long") for t in teams])))
    on = [*KEYS, "batch_idx", "team"]
    steps = grid.join(credit, on, "left").join(made, on, "left").fillna(0, subset=["df", "dp"])
    out = scan.prefix_scan(steps, [*KEYS, "team"], ["batch_idx"], scan.block_of("batch_idx", 65536),
                           {"frames": scan.total("df"), "passes": scan.total("dp"),
                            "changes": scan.total("dc")})
    return out.withColumn("frame", (F.col("batch_idx") + 1) * F.lit(size)).drop("df", "dp", "dc")
