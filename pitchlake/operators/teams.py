"""Which team a track belongs to, from shirt colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from . import scan

TRACK = ["match_id", "track_id"]
COLOUR = ["L", "a", "b"]


def throttle(samples: DataFrame, every: int = 5, keys=("match_id", "track_id"), order=("seq",),
             block: int = 65536) -> DataFrame:
    """Every n-th observation of a track."""
    pos = scan.with_position(samples, list(keys), list(order), scan.block_of(order[0], block))
    return pos.filter(F.col("__pos") % every == 0).drop("__pos")


def track_medians(samples: DataFrame, last: int = 20, min_samples: int = 2, min_tracks: int = 12,
                  channels=tuple(COLOUR)) -> DataFrame:
    """Median colour of each track's last samples; nothing for matches with too few tracks. The rank
    filter trims map tasks first, so a median never sees more than `last` rows."""
    w = Window.partitionBy(*TRACK).orderBy(F.col("seq").desc())
    tail = samples.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= last)
    med = tail.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("samples"), *[F.percentile(c, 0.5).alias(c) for c in channels]
    ).filter(F.col("samples") >= min_samples)
    enough = med.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_tracks)
    return med.join(enough.select("match_id"), "match_id", "left_semi")


def _square_distance(prefix_a: str, prefix_b: str, channels) -> Column:
    total = F.lit(0.0)
    for c in channels:
        d = F.col(f"{prefix_a}{c}") - F.col(f"{prefix_b}{c}")
        total = total + d * d
    return total


def two_means(samples: DataFrame, order: str, channels=tuple(COLOUR), rounds: int = 10) -> DataFrame:
    """Two-cluster Lloyd iteration for all matches at once: start from the first sample and the one
    farthest from it, stop a match when a cluster runs empty. One row per match with both centres.

    Each round joins the samples with one row per match, salted so that a hot match is spread, and
    aggregates partially before its shuffle. Centres never reach the driver.
    """
    points = samples.select("match_id", order, *channels)
    box = F.struct(*channels)
    seed = points.groupBy("match_id").agg(F.min_by(box, order).alias("p"))
    seed = seed.select("match_id", *[F.col(f"p.{c}").alias(f"c0_{c}") for c in channels])
    far = scan.join_one_per_key(points, seed, ["match_id"], [order]).groupBy("match_id").agg(
        F.max_by(F.struct(*channels, *[f"c0_{c}" for c in channels]),
                 F.struct(_square_distance("", "c0_", channels), -F.col(order))).alias("p"))
    centres = far.select("match_id", *[F.col(f"p.c0_{c}").alias(f"c0_{c}") for c in channels],
                         *[F.col(f"p.{c}").alias(f"c1_{c}") for c in channels], F.lit(False).alias("stopped"))
    names = [f"c{i}_{c}" for i in (0, 1) for c in channels]
    for i in range(rounds):
        near_1 = _square_distance("", "c1_", channels) < _square_distance("", "c0_", channels)
        means = scan.join_one_per_key(points, centres, ["match_id"], [order]).withColumn("one", near_1).groupBy("match_id").agg(
            F.first("stopped").alias("stopped"), F.sum(F.col("one").cast("long")).alias("n1"),
            F.count(F.lit(1)).alias("n"), *[F.first(n).alias(f"old_{n}") for n in names],
            *[F.avg(F.when(F.col("one") == bool(j), F.col(c))).alias(f"new_{j}_{c}")
              for j in (0, 1) for c in channels])
        done = F.col("stopped") | (F.col("n1") == 0) | (F.col("n1") == F.col("n"))
        centres = means.select("match_id", *[
            F.when(done, F.col(f"old_c{j}_{c}")).otherwise(F.col(f"new_{j}_{c}")).alias(f"c{j}_{c}")
            for j in (0, 1) for c in channels], done.alias("stopped"))
        if i % 5 == 4 and i + 1 < rounds:
            centres = durable(centres)
    return centres.drop("stopped")


def match_kmeans(medians: DataFrame, channels=tuple(COLOUR), rounds: int = 10) -> DataFrame:
    """Two-cluster k-means over the track medians of each match: `cluster` 0 or 1 (0 on ties) per track.
    The numbers mean nothing beyond the match; `darker_first` or `side_mapping` turn them into teams."""
    assigned = nearest_centre(medians, two_means(medians, "track_id", channels, rounds), channels)
    return assigned.select(*TRACK, F.col("team").alias("cluster"))


def darker_first(centres: DataFrame, channels=tuple(COLOUR), by: str = "L") -> DataFrame:
    """Swap centres so that the darker one is team 0; equal ones stay."""
    swap = F.col(f"c1_{by}") < F.col(f"c0_{by}")
    return centres.select("match_id", swap.alias("swapped"), *[
        F.when(swap, F.col(f"c{1 - i}_{c}")).otherwise(F.col(f"c{i}_{c}")).alias(f"c{i}_{c}")
        for i in (0, 1) for c in channels])


def side_mapping(assigned: DataFrame, x: str = "cx") -> DataFrame:
    """Cluster with the smaller mean x is team 0 (positional mapping)."""
    mean = lambda k: F.avg(F.when(F.col("cluster") == k, F.col(x)))
    both = assigned.groupBy("match_id").agg(mean(0).alias("x0"), mean(1).alias("x1"))
    return both.withColumn("team_of_0", F.when(F.col("x1") < F.col("x0"), 1).otherwise(0))


def separation(centres: DataFrame, channels=tuple(COLOUR), limit: float = 15.0) -> DataFrame:
    """Distance of the two centres and whether it is enough (15 with lightness, 10 without)."""
    d = F.sqrt(_square_distance("c0_", "c1_", channels))
    return centres.select("match_id", d.alias("distance"), (d >= limit).alias("separated"))


def nearest_centre(samples: DataFrame, centres: DataFrame, channels=tuple(COLOUR),
                   limit: float | None = None) -> DataFrame:
    """Nearer centre of the match (0 on ties), -1 beyond `limit`. Adds `d0`, `d1`, `team`."""
    rows = samples.join(centres, "match_id").withColumns({
        "d0": F.sqrt(_square_distance("", "c0_", channels)), "d1": F.sqrt(_square_distance("", "c1_", channels))})
    team = F.when(F.col("d0") <= F.col("d1"), 0).otherwise(1)
    if limit is not None:
        team = F.when(F.least("d0", "d1") > limit, -1).otherwise(team)
    return rows.withColumn("team", team).drop(*[f"c{i}_{c}" for i in (0, 1) for c in channels])


def vote_majority(votes: DataFrame, history: int = 5, needed: int | None = None, keep_on_tie: bool = True,
                  order=("seq",), block: int = 65536, halo_size: int = 65536) -> DataFrame:
    """Majority of a track's last votes once there are `needed` of them (default: all). A tie keeps
    the previous decision, or goes to team 0 when `keep_on_tie` is off."""
    needed = history if needed is None else needed
    pos = scan.with_position(votes, TRACK, list(order), scan.block_of(order[0], block))
    rows, w = scan.halo_rows(pos, TRACK, "__pos", history - 1, halo_size)
    near = w.rowsBetween(1 - history, 0)
    n = {t: F.sum((F.col("team") == t).cast("long")).over(near) for t in (0, 1)}
    rows = scan.drop_halo(rows.withColumns({"__n0": n[0], "__n1": n[1]}))
    tie = F.lit(None).cast("int") if keep_on_tie else F.lit(0)
    choice = F.when(F.least("__pos", F.lit(history)) >= needed,
                    F.when(F.col("__n0") > F.col("__n1"), 0).when(F.col("__n1") > F.col("__n0"), 1).otherwise(tie))
    decided = scan.prefix_scan(rows.withColumn("__c", choice), TRACK, ["__pos"],
                               scan.block_of("__pos", block), {"confirmed": scan.last_seen("__c")})
    return decided.drop("__c", "__n0", "__n1", "__pos")


def team_distribution(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("players"))
