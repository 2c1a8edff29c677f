"""Who is at the ball in a frame, and how sure that is over the last frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import box_centre, distance, of_class, valid_team
from . import scan

FRAME = ["match_id", "frame"]
BALL = 1


def first_ball(det: DataFrame) -> DataFrame:
    """First ball of each frame in input order; it carries track id 0."""
    box = F.struct("seq", "x1", "y1", "x2", "y2", "conf")
    return (det.filter(F.col("class_id") == BALL).groupBy(*FRAME)
            .agg(F.min_by(box, "seq").alias("b")).select(*FRAME, "b.*")
            .withColumn("track_id", F.lit(0).cast("long")))


def top_detections(det: DataFrame, min_conf: float, max_det: int) -> DataFrame:
    """Confidence gate and the best `max_det` boxes of each frame."""
    w = Window.partitionBy(*FRAME).orderBy(F.col("conf").desc(), "seq")
    return (det.filter(F.col("conf") >= min_conf)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_det))


def ball_distances(det: DataFrame, classes=(0,), position: tuple[str, str] | None = None) -> DataFrame:
    """Players of a frame with their distance to its ball. One shuffle: the ball reaches the players
    through a window over the frame, which holds a few dozen rows, not through a join."""
    x, y = (F.col(position[0]), F.col(position[1])) if position else box_centre()
    pts = det.withColumns({"__x": x, "__y": y})
    ball = F.min_by(F.struct("__x", "__y"), F.when(F.col("class_id") == BALL, F.col("seq"))).over(
        Window.partitionBy(*FRAME))
    return (pts.withColumn("__ball", ball)
            .filter(of_class("class_id", classes) & F.col("__ball").isNotNull())
            .withColumn("dist", distance("__x", "__y", "__ball.__x", "__ball.__y"))
            .drop("__ball", "__x", "__y"))


def ball_owner(det: DataFrame, limit: float = 60.0, strict: bool = True, classes=(0,),
               position: tuple[str, str] | None = None) -> DataFrame:
    """Nearest player to the ball within `limit`; ties go to the earlier row.

    Use pixels with a strict limit, or pitch coordinates with `limit=3.0, strict=False`.
    """
    near = ball_distances(det, classes, position).groupBy(*FRAME).agg(
        F.min_by(F.struct("track_id", "team_id", "dist"), F.struct("dist", "seq")).alias("o"))
    within = F.col("o.dist") < limit if strict else F.col("o.dist") <= limit
    return near.filter(within).select(
        *FRAME, F.col("o.track_id").alias("owner_player"),
        valid_team("o.team_id").cast("long").alias("owner_team"), F.col("o.dist").alias("dist"))


def observations(det: DataFrame, owners: DataFrame) -> DataFrame:
    """Input of the possession operators: every frame, with its owner or null."""
    every = det.select(*FRAME).distinct()
    return every.join(owners, FRAME, "left").select(
        *FRAME, F.lit(0).cast("long").alias("seq"), F.col("owner_team").alias("team"),
        F.col("owner_player").alias("player"))


def contested_candidates(det: DataFrame, control: float = 140.0, gap: float = 18.0,
                         classes=(0,)) -> DataFrame:
    """Per frame with a ball: `none` beyond control distance, `contested` when the second player is
    nearly as close, else the nearest player."""
    ranked = ball_distances(det, classes).withColumn(
        "__r", F.row_number().over(Window.partitionBy(*FRAME).orderBy("dist", "seq"))).filter("__r <= 2")
    two = ranked.groupBy(*FRAME).agg(
        F.max(F.when(F.col("__r") == 1, F.struct("track_id", "team_id", "dist"))).alias("n"),
        F.max(F.when(F.col("__r") == 2, F.col("dist"))).alias("second"))
    kind = (F.when(F.col("n.dist") > control, "none")
            .when(F.col("second") - F.col("n.dist") <= gap, "contested").otherwise("player"))
    return (two.withColumn("kind", kind)
            .select(*FRAME, "kind",
                    F.when(F.col("kind") == "player", F.col("n.track_id")).alias("player"),
                    F.when(F.col("kind") == "player", F.col("n.team_id")).alias("team")))


def window_dominance(candidates: DataFrame, window: int = 5, threshold: float = 0.6,
                     keys=("match_id",), order=("frame", "seq"), block_frames: int = 8192,
                     halo_size: int = 65536) -> DataFrame:
    """Player seen most in the last `window` rows, if at least `threshold` of them. Adds `dominant`
    and the window as `recent` (kind, player, team per row)."""
    keys = list(keys)
    pos = scan.with_position(candidates, keys, list(order), scan.block_of(order[0], block_frames))
    rows, w = scan.halo_rows(pos, keys, "__pos", window - 1, halo_size)
    recent = F.collect_list(F.struct("kind", "player", "team")).over(w.rowsBetween(1 - window, 0))
    rows = scan.drop_halo(rows.withColumn("recent", recent))
    need = math.ceil(threshold * window)
    rows = rows.withColumn("__seen", F.expr("transform(filter(recent, r -> r.player is not null), r -> r.player)"))
    best = F.expr("array_max(transform(array_distinct(__seen), (p, i) -> "
                  "named_struct('n', size(filter(__seen, q -> q = p)), 'first', -i, 'p', p)))")
    return (rows.withColumn("__best", best)
            .withColumn("dominant", F.when((F.size("recent") == window) & (F.col("__best.n") >= need),
                                           F.col("__best.p")))
            .drop("__seen", "__best", "__pos"))


def vote_share(dominance: DataFrame, current_player: str = "dominant") -> DataFrame:
    """Shares of each outcome over the `recent` rows of `window_dominance`."""
    total = F.size("recent").cast("double")
    count = lambda cond: F.expr(f"size(filter(recent, r -> {cond}))") / total
    return dominance.withColumns({
        "share_0": count("r.team = 0"), "share_1": count("r.team = 1"),
        "share_contested": count("r.kind = 'contested'"), "share_none": count("r.kind = 'none'"),
        "player_share": F.when(F.col(current_player).isNotNull(), count(f"r.player = {current_player}"))})


def rows_since_change(df: DataFrame, state: list[str], keys=("match_id",), order=("frame", "seq"),
                      block_frames: int = 8192) -> DataFrame:
    """Rows since the state columns last changed (0 on the row of the change)."""
    order = list(order)
    return scan.prefix_scan(df, list(keys), order, scan.block_of(order[0], block_frames),
                            {"rows_since_change": scan.run_length(F.struct(*state))})


def attach_owner_position(players: DataFrame, owners: DataFrame) -> DataFrame:
    """Field position and zone stay only on the row of the frame's owner."""
    mark = owners.select(*FRAME, F.col("owner_player").alias("track_id"), F.lit(True).alias("owner"))
    joined = players.join(mark, [*FRAME, "track_id"], "left")
    keep = F.coalesce("owner", F.lit(False))
    return joined.withColumns({c: F.when(keep, F.col(c)) for c in ("field_x", "field_y", "zone_id")}
                              ).withColumn("owner", keep)


def track_team(det: DataFrame, teams: DataFrame) -> DataFrame:
    """Team of each row's track; unknown tracks get -1."""
    return det.join(teams, ["match_id", "track_id"], "left").withColumn(
        "team", F.coalesce("team", F.lit(-1)))
