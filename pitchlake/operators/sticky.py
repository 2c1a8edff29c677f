"""Possession with a sticky hold (ST2) and its shares (A37).

Only one thing feeds back: whoever holds the ball stays its candidate while it is near the place where they were last
seen. So the work is split in three.

* Before it, columns: players by distance to the ball, the nearest one as candidate unless the second is about as near,
  frames without a ball in a row.
* The feedback itself, in blocks (`machine.run_blocks`): candidate, majority, and one step of the table `NEXT`. The state is
  the current possession, the last few candidates and where the holder was last seen.
* After it, columns: steps and changes, frames credited while the ball is hidden, the team a frame is assigned to.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import machine, scan

# fixed values: names of the states
OWNED = ("team_A_possession", "team_B_possession")
CONTESTED, DEAD, NOBODY = "contested", "dead_ball", "no_possession"

#: evidence of a frame -> state; evidence that is missing here keeps the state
NEXT = {"dead": DEAD, "empty": NOBODY, "undecided": NOBODY, "tied": CONTESTED}
DISPUTED = -1  # candidate of a frame in which two players are about as near

START = {"state": NOBODY, "team": None, "player": None, "last": [], "spot": None}
STEPS = "match_id long, frame long, evidence string, state string, team long, player long, lean long"


def ranked(frames: DataFrame, gap: float, control: float, dead_after: int, block_frames: int) -> DataFrame:
    """One row per frame: `ball` (hidden, dead, empty or seen), players by distance, and the nearest as `candidate`."""
    apart = lambda p: F.sqrt(F.pow(p["x"] - F.col("ball_x"), F.lit(2)) + F.pow(p["y"] - F.col("ball_y"), F.lit(2)))
    entry = lambda p, i: F.struct(apart(p).alias("d"), i.alias("i"), p["track_id"].cast("long").alias("id"),
                                  p["team"].cast("long").alias("team"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    seen = F.col("ball_x").isNotNull() & ~F.isnan("ball_x")
    numbered = scan.with_position(frames, ["match_id"], ["frame"], scan.block_of("frame", block_frames))
    spread, order = scan.halo_rows(numbered, ["match_id"], "__pos", dead_after - 1)
    recent = order.rowsBetween(1 - dead_after, 0)
    gone = (F.count(F.lit(1)).over(recent) == dead_after) & ~F.max(seen).over(recent)
    cut = scan.drop_halo(spread.withColumns({"__gone": gone, "near": F.when(
        seen, F.array_sort(F.transform(F.coalesce("players", F.array().cast(spread.schema["players"].dataType)), entry)))}))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    candidate = F.when(first["d"] <= control, F.when(second["d"] - first["d"] <= gap, F.lit(DISPUTED)).otherwise(first["id"]))
    ball = F.when(F.col("__gone"), "dead").when(~seen, "hidden").when(F.size("near") == 0, "empty").otherwise("seen")
    return cut.select("match_id", "frame", ball.alias("ball"), "ball_x", "ball_y", candidate.alias("candidate"), *[
        F.col(f"near.{name}").alias(f"near_{name}") for name in ("i", "id", "team", "x", "y")])


def majority(values: Sequence, share: float, size: int):
    """The most frequent value (ties: the one met first) if it has `share` of `size` places."""
    best = max(dict.fromkeys(values), key=values.count, default=None)
    return best if best is not None and values.count(best) >= math.ceil(share * size) else None


def hold_step(window: int = 5, dominance: float = 0.6, confirm: int = 5, agreement: float = 0.6, hold_frames: int = 6,
              hold_distance: float = 60.0) -> machine.Step:
    """The feedback of possession over the rows of `ranked`; see `sticky_possession`."""
    memory = max(window, confirm)

    def weigh(ids, teams, last) -> tuple[str, int | None, int | None]:
        """Evidence of a frame with players, and the owner and team it speaks for."""
        places = [who for who, _ in last[-window:]]
        if len(places) < window:
            return "undecided", None, None
        owner = majority([who for who in places if who is not None and who != DISPUTED], dominance, window)
        if owner is None:
            return ("tied" if places.count(DISPUTED) == window else "undecided"), None, None
        team = teams[ids.index(owner)] if owner in ids else None
        if team is None:
            return "undecided", None, None
        backed = [t for _, t in last[-confirm:]].count(team) >= math.ceil(agreement * confirm)
        return ("confirmed" if backed else "unconfirmed"), owner, team

    def place(row, ids, who) -> list:
        """Where a player is, and since how many frames: of several with this id the last of the frame."""
        at = max((k for k, i in enumerate(ids) if i == who), key=lambda k: row.near_i[k])
        return [float(row.near_x[at]), float(row.near_y[at]), 0]

    def step(state, pdf):
        now, last, spot, out = (state["state"], state["team"], state["player"]), state["last"], state["spot"], []
        for row in pdf.itertuples(index=False):
            evidence, choice, owner, team = row.ball, (None, None), None, None
            if spot is not None:
                spot = [*spot[:2], spot[2] + 1] if spot[2] < hold_frames else None
            if evidence == "seen":
                ids = [int(i) for i in row.near_id]
                teams = [None if pd.isna(t) else int(t) for t in row.near_team]
                if now[2] in ids:
                    spot = place(row, ids, now[2])
                if now[0] in OWNED and spot and math.dist(spot[:2], (row.ball_x, row.ball_y)) <= hold_distance:
                    choice = now[2], now[1]
                elif not pd.isna(row.candidate):
                    who = int(row.candidate)
                    choice = who, None if who == DISPUTED else teams[0]
                last = [*last, list(choice)][-memory:]
                evidence, owner, team = weigh(ids, teams, last)
            else:
                last = [*last, list(choice)][-memory:]
            if evidence == "confirmed":
                now = OWNED[0 if team == 0 else 1], 0 if team == 0 else 1, owner
            elif evidence == "unconfirmed":
                now = now[0], now[1], owner
            elif evidence in NEXT:
                now = NEXT[evidence], None, None
            elif now[0] not in OWNED:  # hidden, and nobody held it
                now = NOBODY, None, None
            if owner is not None:
                spot = place(row, ids, owner)
            elif now[2] is None:
                spot = None
            recent = [t for _, t in last[-window:]]
            ahead = recent.count(1) - recent.count(0)
            lean = None if ahead == 0 else int(ahead > 0)
            out.append((row.match_id, row.frame, evidence, *now, lean))
        steps = pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
        return steps.astype({c: "Int64" for c in ("team", "player", "lean")}), {
            "state": now[0], "team": now[1], "player": now[2], "last": last, "spot": spot}

    return step


def credited(steps: DataFrame, hold_frames: int, block: Column) -> DataFrame:
    """Steps, changes, credits and assigned team of each frame, from the states alone.

    A stretch of hidden frames lasts until a frame settles an owner or the ball is dead; frames with a ball but without
    an owner do not end it. Its first `hold_frames` hidden frames count for the team in possession. If that
    was none, and the owner who ends it had the ball before it began, all of them count afterwards.
    """
    keys, order = ["match_id"], ["frame"]
    settled = F.col("evidence").isin("confirmed", "unconfirmed")
    hidden = F.col("evidence").isin("hidden", "dead")
    ends = settled | (F.col("evidence") == "dead")
    kept = (F.col("evidence") == "unconfirmed") | ((F.col("evidence") == "hidden") & F.col("state").isin(*OWNED))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    one = scan.prefix_scan(steps.withColumn("entered", ~kept), keys, order, block, {
        "__was": scan.previous(F.struct("state", "team", "player")), "__hidden": scan.total(number(hidden)),
        "__stretch": scan.total(number(ends), before=True), "__entered": scan.total(number(F.col("entered")))})
    differs = (F.coalesce("__was.state", F.lit(NOBODY)) != F.col("state")) | ~F.col("__was.team").eqNullSafe(F.col("team"))
    two = scan.prefix_scan(one.withColumn("changed", differs), keys, order, block, {
        "__before": scan.last_seen(F.when(ends, F.col("__hidden")), before=True),
        "__changed": scan.last_seen(F.when(F.col("changed"), F.col("__entered")))})
    waiting = F.col("__hidden") - F.coalesce("__before", F.lit(0))
    while_hidden = hidden & F.col("__was.team").isNotNull() & (F.col("__wait") <= hold_frames)
    three = scan.prefix_scan(two.withColumn("__wait", waiting).withColumn("__paid", while_hidden), keys, order, block, {
        "__paid_in": scan.last_seen(F.when(F.col("__paid"), F.col("__stretch"))),
        "__lost_by": scan.last_seen(F.when(hidden & (F.col("__wait") == 1), F.struct(F.col("__was.team").alias("team"), F.col("__was.player").alias("player")))),
        "__assigned": scan.last_seen(F.when(settled, F.coalesce("team", "lean")))})
    again = F.col("__lost_by.player").isNotNull() & (
        (F.col("player") == F.col("__lost_by.player")) | (F.col("team") == F.col("__lost_by.team")))
    late = (F.col("__wait") > 0) & F.coalesce(again, F.lit(False)) & ~F.col("__paid_in").eqNullSafe(F.col("__stretch"))
    amount = F.when(settled, 1 + F.when(late, F.col("__wait")).otherwise(0)).when(F.col("__paid"), 1).otherwise(0)
    team = F.when(settled, F.col("team")).otherwise(F.col("__was.team"))
    return three.select(
        "match_id", "frame", "state", "team", "player", "entered", "changed", F.when(settled, F.col("__assigned")).alias("assigned_team"),
        *[F.when(team == t, amount).otherwise(0).cast("long").alias(f"credit_{t}") for t in (0, 1)],
        (F.col("__entered") - F.coalesce("__changed", F.lit(0))).alias("since_change"))


def sticky_possession(frames: DataFrame, window: int = 5, dominance: float = 0.6, confirm: int = 5, agreement: float = 0.6, gap: float = 18.0,
                      control: float = 140.0, hold_frames: int = 6, hold_distance: float = 60.0, dead_after: int = 7,
                      block_rows: int = 50_000, block_frames: int = 8192) -> DataFrame:
    """State per frame (one of five), with the frames credited to each team on it and the steps since it changed.

    Rows: match_id, frame, ball_x, ball_y (null = no ball) and players, an array of (track_id, x, y, team), null or empty
    where there are none. The candidate of a frame is the nearest player within `control`, disputed if the second
    is less than `gap` further away; the holder remains it while the ball is within `hold_distance` of where they
    were in the last `hold_frames` frames. `dominance` of `window` candidates make an owner, `agreement` of `confirm` a
    team in possession. Equal distances go to the earlier player; of players with one id in a frame
    the last is the one remembered.
    """
    steps = machine.run_blocks(ranked(frames, gap, control, dead_after, block_frames), ["match_id"], ["frame"],
                               hold_step(window, dominance, confirm, agreement, hold_frames, hold_distance), STEPS, START, block_rows)
    return credited(durable(steps), hold_frames, scan.block_of("frame", block_frames))


def assigned_share(states: DataFrame) -> DataFrame:
    """Frames assigned to each team as share of both teams' and of all frames, per match."""
    count = lambda t: F.sum((F.coalesce("assigned_team", F.lit(-1)) == t).cast("long"))
    last = states.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"), *[count(t).alias(f"assigned_{t}") for t in (0, 1)],
        *[F.sum(f"credit_{t}").alias(f"possession_{t}") for t in (0, 1)])
    both = F.col("assigned_0") + F.col("assigned_1")
    share = lambda n, d: F.when(d > 0, F.col(n) / d).otherwise(0.0)
    return last.withColumns({
        f"{name}_{t}": share(f"assigned_{t}", d) for t in (0, 1)
        for name, d in (("of_assigned", both), ("of_frames", F.col("frames")))})
