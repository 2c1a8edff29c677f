"""Alert checks over cumulative statistics. Every check is a filter or a look-back on the table of
check points: one row per match and check, far fewer than frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent
from ..session import durable
from . import machine, scan, tactics

CHECK = ["match_id", "frame"]
ALERT_COLUMNS = ["match_id", "frame", "type", "severity", "alert_key", "team", "title", "message", "data"]


def check_table(cumulative: DataFrame, gate: int, block: int = 65536 * 64) -> DataFrame:
    """Statistics at the check points: frames, passes and percent of both teams, changes, and the
    percentages of the check before. Input: one row per (match, frame, team), see E19."""
    of = lambda name, t: F.sum(F.when(F.col("team") == t, F.col(name)).otherwise(0))
    wide = cumulative.groupBy(*CHECK).agg(
        *[of(n, t).alias(f"{n}_{t}") for n in ("frames", "passes") for t in (0, 1)], F.max("changes").alias("changes"))
    due = machine.check_points(cumulative.select(*CHECK), gate)
    rows = wide.join(due, CHECK)
    rows = rows.withColumn("total_frames", F.col("frames_0") + F.col("frames_1")).filter("total_frames > 0")
    rows = rows.withColumns({f"percent_{t}": percent(f"frames_{t}", "total_frames") for t in (0, 1)})
    return scan.prefix_scan(rows, ["match_id"], ["frame"], scan.block_of("frame", block), {
        "check": scan.total(F.lit(1).cast("long")),
        "prev_percent_0": scan.previous("percent_0"), "prev_percent_1": scan.previous("percent_1")})


def _each_team(checks: DataFrame, **by_team) -> DataFrame:
    """One row per check and team; every keyword names a column prefix to pick per team."""
    side = F.explode(F.array(*[F.struct(F.lit(t).alias("team"), *[
        F.col(f"{prefix}_{t if own else 1 - t}").alias(name) for name, (prefix, own) in by_team.items()]) for t in (0, 1)]))
    return checks.withColumn("__t", side).select(*checks.columns, "__t.*")


def _first_team(rows: DataFrame) -> DataFrame:
    """Keep the lower team where both qualify."""
    both = rows.groupBy(*CHECK).agg(F.min("team").alias("team"))
    return rows.join(both, [*CHECK, "team"], "left_semi")


def dominance(checks: DataFrame, limit: float = 60.0) -> DataFrame:
    rows = _each_team(checks, pct=("percent", True), rival=("percent", False)).filter(F.col("pct") >= limit)
    return _first_team(rows).withColumn("severity", F.when(F.col("pct") >= 75, "warning").otherwise("info")).select(
        *CHECK, "team", "severity", "pct", "rival", (F.col("pct") - F.col("rival")).alias("difference"))


def lookback(checks: DataFrame, columns: list[str], frames: int, block: int = 65536 * 64) -> DataFrame:
    """Values of the latest check at or before `frame - frames`, as `past_<column>`. Past values are
    laid `frames` later on the same axis, so the as-of join is a running last value."""
    asked = checks.select(*CHECK, F.lit(1).alias("__kind"), F.lit(None).cast(
        checks.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__v"))
    given = checks.select("match_id", (F.col("frame") + frames).alias("frame"), F.lit(0).alias("__kind"),
                          F.struct(*columns).alias("__v"))
    both = asked.unionByName(given)
    seen = scan.prefix_scan(both, ["match_id"], ["frame", "__kind"], scan.block_of("frame", block),
                            {"__past": scan.last_seen("__v")})
    past = seen.filter("__kind = 1").select(*CHECK, *[F.col(f"__past.{c}").alias(f"past_{c}") for c in columns])
    return checks.join(past, CHECK)


def pass_drought(checks: DataFrame, fps: float = 30.0, seconds: float = 30.0, minimum: int = 4) -> DataFrame:
    rows = lookback(checks, ["passes_0", "passes_1"], int(seconds * fps)).filter("check >= 2")
    rows = _each_team(rows, now=("passes", True), past=("past_passes", True))
    return rows.withColumn("passes_in_period", F.col("now") - F.col("past")).filter(
        F.col("passes_in_period") < minimum).select(*CHECK, "team", "passes_in_period")


def swings(checks: DataFrame) -> DataFrame:
    """Change of possession share since the previous check, per team."""
    rows = _each_team(checks.filter("check >= 2"), pct=("percent", True), before=("prev_percent", True))
    return rows.select(*CHECK, "team", "pct", "before", (F.col("pct") - F.col("before")).alias("swing"))


def swing(checks: DataFrame, limit: float = 15.0) -> DataFrame:
    return _first_team(swings(checks).filter(F.abs("swing") >= limit))


def intensity(checks: DataFrame, fps: float = 30.0, fast: float = 15.0, slow: float = 4.0) -> DataFrame:
    minutes = F.col("total_frames") / F.lit(fps) / 60.0
    rows = checks.withColumn("minutes", minutes).filter(F.col("minutes") >= 1.0).withColumn(
        "changes_per_minute", F.col("changes") / F.col("minutes"))
    kind = F.when(F.col("changes_per_minute") > fast, "fragmented").when(F.col("changes_per_minute") < slow, "controlled")
    return rows.withColumn("kind", kind).filter("kind is not null").select(*CHECK, "kind", "changes_per_minute", "changes")


def zone_pressure(zone_frames: DataFrame, limit: float = 0.55) -> DataFrame:
    """Rival's share of the time in a team's own cells. Input per (match, frame, team, zone_id)."""
    zone = F.col("zone_id")
    home = F.when(zone.isin(0, 3, 6, 9), 0).when(zone.isin(2, 5, 8, 11), 1)
    per = zone_frames.withColumn("home", home).filter("home is not null").groupBy(*CHECK, "home").agg(
        F.sum("frames").alias("all"), F.sum(F.when(F.col("team") != F.col("home"), F.col("frames")).otherwise(0)).alias("rival"))
    share = F.when(F.col("all") > 0, F.col("rival") / F.col("all"))
    return per.withColumn("rival_share", share).filter(F.col("rival_share") >= limit).select(
        *CHECK, F.col("home").alias("team"), "rival_share")


def zone_concentration(focus: DataFrame, limit: float = 0.60, zones: int = 3) -> DataFrame:
    return focus.filter((F.col("concentration") >= limit) & (F.size("dominant_zones") <= zones)).select(
        *CHECK, "team", "dominant_zones", "concentration", "pattern")


def best_chain(checks: DataFrame, chains: DataFrame, min_length: int = 5, block: int = 65536 * 64) -> DataFrame:
    """Longest chain completed by each check, the first of equals, per team."""
    keys, kind = ["match_id", "team"], F.lit(0).alias("__kind")
    done = chains.filter(F.col("closed_frame").isNotNull() & (F.col("length") >= min_length))
    given = done.select(*keys, F.col("closed_frame").alias("frame"), kind,
                        F.struct("length", (-F.col("chain")).alias("c"), F.array_join("zones", ", ").alias("zones")).alias("__v"))
    asked = checks.select("match_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("team"), "frame",
                          F.lit(1).alias("__kind"), F.lit(None).cast(given.schema["__v"].dataType).alias("__v"))
    both = given.withColumn("team", F.col("team").cast("long")).unionByName(asked)
    seen = scan.prefix_scan(both, keys, ["frame", "__kind"], scan.block_of("frame", block), {"__best": scan.highest("__v")})
    return seen.filter("__kind = 1 AND __best IS NOT NULL").select(
        *CHECK, F.col("team").cast("int").alias("team"), F.col("__best.length").alias("length"), F.col("__best.zones").alias("zones"))


def summary(checks: DataFrame, fps: float = 30.0, every: float = 90.0) -> DataFrame:
    """Summary rows: the first check, then one every `every` seconds of match time; none before
    minute one."""
    rows = checks.join(_after_first(checks, int(every * fps)), CHECK)
    minutes = F.floor(F.col("frame") / F.lit(fps) / 60.0).cast("long")
    gap = F.abs(F.col("percent_0") - F.col("percent_1"))
    lead = F.when(gap < 10, F.lit(None)).when(F.col("percent_0") > F.col("percent_1"), 0).otherwise(1)
    ratio = F.when((F.col("passes_0") > 0) & (F.col("passes_1") > 0), F.col("passes_0") / F.col("passes_1"))
    out = rows.withColumns({"minute": minutes, "leader": lead.cast("int"), "ratio": ratio}).filter("minute >= 1")
    return out.withColumns({
        "control": F.coalesce(F.col("leader").isNotNull() & (F.greatest("percent_0", "percent_1") > 65), F.lit(False)),
        "better_passing": F.when(F.col("ratio") > 2.0, 0).when(F.col("ratio") < 0.5, 1)}).drop("ratio")


def _after_first(checks: DataFrame, gap: int) -> DataFrame:
    """The first check, then each check at least `gap` frames after the last one taken."""
    start = checks.groupBy("match_id").agg(F.min("frame").alias("__f0"))
    shifted = checks.join(start, "match_id").select(
        "match_id", (F.col("frame") - F.col("__f0") + gap).alias("frame"), "__f0")
    due = machine.check_points(shifted.select("match_id", "frame"), gap)
    return due.join(start, "match_id").select("match_id", (F.col("frame") - gap + F.col("__f0")).alias("frame"))


def significant_event(checks: DataFrame, limit: float = 15.0) -> DataFrame:
    move = lambda t: F.abs(F.col(f"percent_{t}") - F.col(f"prev_percent_{t}")) >= limit
    label = (F.when(F.col("check") < 2, "momentum_check").when(move(0), "possession_shift_team_0")
             .when(move(1), "possession_shift_team_1").otherwise("regular_check"))
    return checks.select(*CHECK, label.alias("event"))


def _data(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _alert(rows: DataFrame, kind: str, key: str, severity, title: Column, message: Column, data: Column,
           team: bool = True) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    who = F.col("team").cast("int") if team else F.lit(None).cast("int")
    tag = F.concat(F.lit(f"{key}_"), who.cast("string")) if team else F.lit(key)
    return rows.select(*CHECK, F.lit(kind).alias("type"), sev.alias("severity"), tag.alias("alert_key"),
                       who.alias("team"), title.alias("title"), message.alias("message"), data.alias("data"))


def alert_table(checks: DataFrame, zone_frames: DataFrame | None = None, chains: DataFrame | None = None,
                fps: float = 30.0, min_interval: float = 10.0) -> DataFrame:
    """All checks as one stream of alerts, at most one per kind and team every `min_interval` seconds."""
    say = F.format_string
    dom, dry, swg, amt, sm = (dominance(checks), pass_drought(checks, fps), swing(checks), intensity(checks, fps),
                              summary(checks, fps))
    c = F.col
    parts = [
        _alert(dom, "possession", "dominance", c("severity"), say("Team %d dominates", c("team")),
               say("Team %d holds the ball %.1f%% of the time against %.1f%%.", c("team"), c("pct"), c("rival")),
               _data(percent=c("pct"), rival=c("rival"), difference=c("difference"))),
        _alert(dry, "passing", "drought", "warning", say("Team %d is not passing", c("team")),
               say("Team %d completed %d passes in the last 30 seconds.", c("team"), c("passes_in_period")),
               _data(passes=c("passes_in_period"))),
        _alert(swg, "tactical", "swing", "info", say("Momentum of team %d", c("team")),
               say("Team %d moved by %.1f points of possession since the last check.", c("team"), c("swing")),
               _data(swing=c("swing"), percent=c("pct"), previous=c("before"))),
        _alert(amt, "tactical", "intensity", "info", say("Play is %s", c("kind")),
               say("%.1f changes of possession per minute.", c("changes_per_minute")),
               _data(changes_per_minute=c("changes_per_minute"), changes=c("changes")), team=False),
        _alert(sm, "tactical", "summary", "info", say("Minute %d", c("minute")),
               say("Possession %.1f%% to %.1f%%, passes %d to %d.", c("percent_0"), c("percent_1"), c("passes_0"), c("passes_1")),
               _data(minute=c("minute"), percent_0=c("percent_0"), percent_1=c("percent_1"),
                     passes_0=c("passes_0"), passes_1=c("passes_1")), team=False)]
    if zone_frames is not None:
        at = zone_frames.join(checks.select(*CHECK), CHECK, "left_semi")
        focus = durable(tactics.zone_focus(at, keys=(*CHECK, "team")))
        press, conc = zone_pressure(at), zone_concentration(focus)
        moved = tactics.zone_shift(focus).filter("shifted")
        parts += [
            _alert(press, "zone", "pressure", "warning", say("Team %d under pressure", c("team")),
                   say("The rival holds %.0f%% of the time in the defence of team %d.", c("rival_share") * 100, c("team")),
                   _data(rival_share=c("rival_share"))),
            _alert(conc, "zone", "concentration", "info", say("Team %d plays in few zones", c("team")),
                   F.concat(F.array_join("dominant_zones", ", "), say(" (%.0f%%)", c("concentration") * 100)),
                   _data(concentration=c("concentration"), pattern=c("pattern"))),
            _alert(moved, "tactical", "shift", "info", say("Team %d changes its zones", c("team")), tactics.shift_text(),
                   _data(new=F.array_join("new_zones", ","), lost=F.array_join("lost_zones", ",")))]
    if chains is not None:
        best = best_chain(checks, chains)
        parts.append(_alert(best, "passing", "chain", "info", say("Passing chain of team %d", c("team")),
                            say("%d passes through %s.", c("length"), c("zones")), _data(length=c("length"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    stamped = durable(every.withColumns({"timestamp": c("frame") / F.lit(fps), "seq": F.lit(0).cast("long")}))
    sent = machine.rate_limit(stamped, min_interval)
    return sent.withColumn("id", F.concat_ws("_", F.lit("alert"), "match_id", "frame", "alert_key")).drop("seq")


def alert_summary(alerts: DataFrame, checks: DataFrame) -> DataFrame:
    """Per match: alerts, checks, frame of the last check."""
    made = alerts.groupBy("match_id").agg(F.count(F.lit(1)).alias("total_alerts"))
    done = checks.groupBy("match_id").agg(F.count(F.lit(1)).alias("checks"), F.max("frame").alias("last_check_frame"))
    return done.join(made, "match_id", "left").fillna(0, subset=["total_alerts"])


def alert_feed(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Latest alerts first."""
    return alerts.orderBy(F.col("frame").desc(), "match_id", "alert_key").limit(n)
