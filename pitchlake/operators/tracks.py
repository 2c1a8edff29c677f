"""Per-track operators: trajectories, smoothing, validation, lifecycle and re-identification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from . import scan

TRACK = ["match_id", "track_id"]
ORDER = ["frame", "seq"]
BLOCK_FRAMES = 8192


def trajectory_tail(rows: DataFrame, n: int = 300) -> DataFrame:
    """Last n centres of each track, oldest first. The rank filter trims each map task to n rows per
    track before the shuffle, and the list is bounded by n."""
    w = Window.partitionBy(*TRACK).orderBy(F.col("frame").desc(), F.col("seq").desc())
    tail = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return tail.groupBy(*TRACK).agg(
        F.sort_array(F.collect_list(F.struct("frame", "seq", "x", "y"))).alias("trajectory"))


def gap_fill(seen: DataFrame, wanted: DataFrame, decay: float = 0.95, floor: float = 0.1,
             max_gap: int | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Last known position of a track at every wanted row: confidence 1 where it was seen, losing 5%
    per missing frame down to a floor. `wanted` has track_id, frame, seq; `seen` adds x, y."""
    rows = wanted.join(seen.withColumnsRenamed({"x": "__x", "y": "__y"}), [*TRACK, *ORDER], "left")
    held = F.when(F.col("__x").isNotNull(), F.struct(F.col("frame").alias("f"), "__x", "__y"))
    out = scan.prefix_scan(rows.withColumn("__h", held), TRACK, ORDER, scan.block_of("frame", block_frames),
                           {"__last": scan.last_seen("__h")})
    gap = F.col("frame") - F.col("__last.f")
    kept = F.col("__last").isNotNull() if max_gap is None else (gap <= max_gap)
    return out.select(*wanted.columns, F.when(kept, F.col("__last.__x")).alias("x"),
                      F.when(kept, F.col("__last.__y")).alias("y"),
                      F.when(kept, F.greatest(F.lit(floor), F.pow(F.lit(decay), gap))).alias("flow_conf"))


def lifecycle(rows: DataFrame, fps: float = 30.0, max_age_seconds: float = 5.0, max_lost: float = 120.0,
              block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Stretches of a track's life: `active` from a sighting, `lost` once unseen for `max_age_seconds`,
    `expired` after `max_lost`. One row per stretch, in seconds; the end of the match closes the last."""
    rev = rows.select(*TRACK, "frame", "seq", (-F.col("frame")).alias("__f"), (-F.col("seq")).alias("__s"))
    ahead = scan.prefix_scan(rev, TRACK, ["__f", "__s"], scan.block_of("__f", block_frames),
                             {"__next": scan.previous("frame")})
    end = rows.groupBy("match_id").agg(F.max("frame").alias("__end"))
    gaps = ahead.join(end, "match_id").select(
        *TRACK, (F.col("frame") / fps).alias("t"), (F.coalesce("__next", "__end") / fps).alias("until"),
        F.col("__next").isNull().alias("final"))
    open_gap = gaps.filter(F.col("until") - F.col("t") > max_age_seconds)
    stretch = F.explode(F.array_compact(F.array(
        F.struct(F.lit("lost").alias("state"), (F.col("t") + max_age_seconds).alias("start"),
                 F.least(F.col("until"), F.col("t") + max_lost).alias("stop")),
        F.when(F.col("until") - F.col("t") > max_lost, F.struct(
            F.lit("expired").alias("state"), (F.col("t") + max_lost).alias("start"), F.col("until").alias("stop"))))))
    return open_gap.select(*TRACK, stretch.alias("s")).select(*TRACK, "s.state", "s.start", "s.stop")


def track_counts(rows: DataFrame, fps: float = 30.0, max_age_seconds: float = 5.0,
                 max_lost: float = 120.0) -> DataFrame:
    """Active, lost and all ids of a match as of its last frame."""
    last = rows.groupBy(*TRACK).agg((F.max("frame") / fps).alias("t"))
    end = rows.groupBy("match_id").agg((F.max("frame") / fps).alias("end"))
    idle = F.col("end") - F.col("t")
    return last.join(end, "match_id").groupBy("match_id").agg(
        F.sum((idle <= max_age_seconds).cast("long")).alias("active"),
        F.sum(((idle > max_age_seconds) & (idle <= max_lost)).cast("long")).alias("lost"),
        F.count(F.lit(1)).alias("total_ids"))


def smoothing_stats(rows: DataFrame, n: int = 30) -> DataFrame:
    """Average and largest velocity, average and smallest confidence over a track's last n rows."""
    w = Window.partitionBy(*TRACK).orderBy(F.col("frame").desc(), F.col("seq").desc())
    tail = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return tail.groupBy(*TRACK).agg(
        F.avg("velocity").alias("avg_velocity"), F.max("velocity").alias("max_velocity"),
        F.avg("conf").alias("avg_conf"), F.min("conf").alias("min_conf"))


# ---- Kalman smoothing ------------------------------------------------------------------------

STACK = 1 << 20  # numbers per measurement column that a task holds at a time


def _stacks(batches, columns: list[str]):
    """Blocks of Arrow batches, each row of which is a block with arrays, as matrices with a row per measurement.

    Blocks of similar length are stacked side by side and padded, up to `STACK` numbers a matrix (or one block). Yields
    the rows, their lengths and a matrix per column: time runs down, blocks run across.
    """
    for pdf in batches:
        pdf = pdf.iloc[np.argsort(pdf["conf"].map(len).to_numpy(), kind="stable")].reset_index(drop=True)
        size, start = pdf["conf"].map(len).to_numpy(), 0
        while start < len(pdf):
            stop = start + 1
            while stop < len(pdf) and (stop + 1 - start) * size[stop] <= STACK:
                stop += 1
            part, length = pdf.iloc[start:stop], size[start:stop]
            grid = {}
            for name in columns:
                grid[name] = np.zeros((length[-1], stop - start))
                for i, values in enumerate(part[name]):
                    grid[name][:len(values), i] = values
            yield part, length, grid
            start = stop


def _noise(conf: np.ndarray, r: float, single_update: bool) -> list[np.ndarray]:
    """Noise of the updates of each measurement."""
    second = np.where(conf < 1.0, r / (conf + 0.1), r)
    return [second] if single_update else [np.full_like(second, r), second]


def _advance(state: np.ndarray, p: np.ndarray, z: np.ndarray, noise: list[np.ndarray], row: int, live: np.ndarray, q: float):
    """One measurement of all blocks: `state` is (position and velocity, sequence, block); blocks that are over stay as they are."""
    for level in noise:
        gain = (p + q) / (p + q + level[row])
        ahead = state[0] + state[1]
        miss = gain * (z - ahead)
        state = np.where(live, np.stack([ahead + miss, state[1] + miss]), state)
        p = np.where(live, (1.0 - gain) * (p + q), p)
    return state, p


#: The error after a block is (a p + b) / (c p + d); summaries of blocks compose as 2 x 2 matrices, scaled to stay finite.
_ERROR_BEFORE = """aggregate(collect_list(struct(a, b, c, d)) OVER (PARTITION BY match_id, track_id ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    1.0D, (p, m) -> (m.a * p + m.b) / (m.c * p + m.d))"""
#: (position, velocity) after a block is linear in the state before it.
_STATE_BEFORE = """aggregate(collect_list(struct(pp, pv, vp, vv, ox, ux, oy, uy)) OVER (PARTITION BY match_id, track_id ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    named_struct('px', x0, 'vx', 0.0D, 'py', y0, 'vy', 0.0D), (s, m) -> named_struct(
    'px', m.pp * s.px + m.pv * s.vx + m.ox, 'vx', m.vp * s.px + m.vv * s.vx + m.ux,
    'py', m.pp * s.py + m.pv * s.vy + m.oy, 'vy', m.vp * s.py + m.vv * s.vy + m.uy))"""


def kalman_smooth(rows: DataFrame, q: float = 0.01, r: float = 1.0, single_update: bool = False,
                  block_rows: int = 32768, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Smoothed x, y and velocities per track row (match_id, track_id, frame, seq, x, y, conf).

    Per axis the state is (position, velocity) with one scalar error shared by both axes. Each
    measurement is applied twice, the second time with noise r / (conf + 0.1) where conf < 1;
    `single_update` keeps the second only. Tracks are cut into blocks of `block_rows` rows. The error
    after a block is a fractional linear function of the error before it, and given the gains the
    state after it is a linear function of the state before it: one row per block carries either
    across blocks, so the blocks of a track are filtered side by side and exactly.
    """
    pos = scan.with_position(rows.select(*TRACK, *ORDER, "x", "y", "conf"), TRACK, ORDER,
                             scan.block_of("frame", block_frames))
    block = [*TRACK, scan.BLOCK]
    cut = scan.spread_tasks(pos.withColumn(scan.BLOCK, F.floor((F.col("__pos") - 1) / block_rows)), block)
    point = F.struct("__pos", *ORDER, *[F.col(n).cast("double").alias(n) for n in ("x", "y", "conf")])
    # a row per block; its arrays hold at most block_rows values
    packed = durable(cut.groupBy(*block).agg(F.array_sort(F.collect_list(point)).alias("e")).select(
        *block, *[F.col(f"e.{n}").alias(n) for n in (*ORDER, "x", "y", "conf")]))
    keys = f"match_id long, track_id long, {scan.BLOCK} long"

    def error_summary(batches):
        for part, length, grid in _stacks(batches, ["conf"]):
            m = np.stack([np.ones(len(part)), np.zeros(len(part)), np.zeros(len(part)), np.ones(len(part))])
            noise = _noise(grid["conf"], r, single_update)
            for row in range(length[-1]):
                for level in (n[row] for n in noise):  # p -> level (p + q) / (p + q + level)
                    a, b, c, d = m
                    after = np.stack([level * (a + q * c), level * (b + q * d), a + (q + level) * c, b + (q + level) * d])
                    m = np.where(row < length, after / (after[2] + after[3]), m)
            yield part[block].assign(a=m[0], b=m[1], c=m[2], d=m[3], x0=part["x"].map(lambda v: v[0]), y0=part["y"].map(lambda v: v[0]))

    def state_summary(batches):
        # x and y from rest, and the two unit states without measurements
        for part, length, grid in _stacks(batches, ["x", "y", "conf"]):
            n, noise, p = len(part), _noise(grid["conf"], r, single_update), part["p"].to_numpy()
            state = np.zeros((2, 4, n))
            state[0, 2] = state[1, 3] = 1.0
            for row in range(length[-1]):
                z = np.stack([grid["x"][row], grid["y"][row], np.zeros(n), np.zeros(n)])
                state, p = _advance(state, p, z, noise, row, row < length, q)
            (ox, oy, pp, pv), (ux, uy, vp, vv) = state
            yield part[block].assign(pp=pp, pv=pv, vp=vp, vv=vv, ox=ox, ux=ux, oy=oy, uy=uy)

    def smooth(batches):
        for part, length, grid in _stacks(batches, ["x", "y", "conf"]):
            noise, p = _noise(grid["conf"], r, single_update), part["p"].to_numpy()
            state = np.array([[part["px"], part["py"]], [part["vx"], part["vy"]]])
            out = np.empty((length[-1], 4, len(part)))
            for row in range(length[-1]):
                state, p = _advance(state, p, np.stack([grid["x"][row], grid["y"][row]]), noise, row, row < length, q)
                out[row] = state.reshape(4, -1)
            names = ("smooth_x", "smooth_y", "vel_x", "vel_y")
            yield part[[*TRACK, *ORDER]].assign(**{name: [out[:k, j, i] for i, k in enumerate(length)] for j, name in enumerate(names)})

    errors = packed.mapInPandas(error_summary, f"{keys}, a double, b double, c double, d double, x0 double, y0 double")
    first = Window.partitionBy(*TRACK).orderBy(scan.BLOCK)  # one row per block
    errors = durable(errors.select(*block, F.expr(_ERROR_BEFORE).alias("p"), F.first("x0").over(first).alias("x0"), F.first("y0").over(first).alias("y0")))
    states = packed.join(errors.select(*block, "p"), block).mapInPandas(
        state_summary, f"{keys}, pp double, pv double, vp double, vv double, ox double, ux double, oy double, uy double")
    entries = durable(states.join(errors, block).select(*block, "p", F.expr(_STATE_BEFORE).alias("s")).select(*block, "p", "s.*"))
    names = ("smooth_x", "smooth_y", "vel_x", "vel_y")
    done = packed.join(entries, block).mapInPandas(
        smooth, f"match_id long, track_id long, frame array<long>, seq array<long>, {', '.join(f'{n} array<double>' for n in names)}")
    return done.select(*TRACK, F.inline(F.arrays_zip(*ORDER, *names)))


# ---- re-identification -----------------------------------------------------------------------

def salted(asked: DataFrame, held: DataFrame, keys: list[str], by: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column `salt` to join on too: a key with more than `cell` rows in `asked` is dealt into
    cells of about that many by `by`, and the rows of `held` with that key are repeated for each of its cells."""
    hot = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > cell)
    hot = hot.select(*keys, F.ceil(F.col("__n") / cell).cast("int").alias("__cells"))
    cells = F.coalesce("__cells", F.lit(1))
    dealt = asked.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), cells).cast("int"))
    repeated = held.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), cells - 1)))
    return dealt.drop("__cells"), repeated.drop("__cells")


def recover_tracks(new: DataFrame, lost: DataFrame, threshold: float = 0.5, max_lost: float = 120.0, cell: int = 50_000) -> DataFrame:
    """Best lost track for each new detection: same match, seen at most `max_lost` seconds before,
    highest cosine above the threshold (ties to the lower id).

    Time is cut into buckets of `max_lost`, so a detection meets the tracks of its own and the
    previous bucket only; a bucket with more than `cell` detections is cut into cells of about that many. Candidates are
    compared inside the join's stage and reduced to the best one per detection before the next shuffle.
    `new`: match_id, det_id, t, vec. `lost`: match_id, track_id, last_seen, vec.
    """
    bucket = lambda col: F.floor(F.col(col) / max_lost).cast("long")
    unit = lambda c: F.expr(f"named_struct('v', transform({c}, x -> CAST(x AS DOUBLE)), 'n', sqrt(aggregate({c}, 0D, (s, x) -> s + x * x)))")
    held = lost.select("match_id", "track_id", "last_seen", unit("vec").alias("old"),
                       F.explode(F.array(bucket("last_seen"), bucket("last_seen") + 1)).alias("bucket"))
    asked = new.withColumn("vec", unit("vec")).withColumn("bucket", bucket("t"))
    asked, held = salted(asked, held, ["match_id", "bucket"], "det_id", cell)
    near = asked.join(held, ["match_id", "bucket", "salt"]).filter(
        (F.col("t") >= F.col("last_seen")) & (F.col("t") - F.col("last_seen") <= max_lost))
    scored = near.withColumn("similarity", F.expr(
        "aggregate(zip_with(vec.v, old.v, (a, b) -> a * b), 0D, (s, x) -> s + x) / (vec.n * old.n + 1e-6D)")).filter(F.col("similarity") > threshold)
    return scored.groupBy("match_id", "det_id").agg(
        F.max_by(F.struct("track_id", "similarity"), F.struct("similarity", -F.col("track_id"))).alias("b")
    ).select("match_id", "det_id", "b.track_id", "b.similarity")
