"""Rules that feed back into themselves, run in blocks.

Some rules (possession with a sticky hold, greedy track matching, rate limits) decide each row from
the state the previous rows left behind, so no window expresses them. `run_blocks` still never puts
a whole key into one task. Rows of a key are cut into blocks of consecutive rows, and

* rules that forget their past run all blocks at once from a guessed entry state; a block whose true
  entry (the exit of the block before) differs from the guess runs again. The first block is always
  right. Every round joins COARSER blocks to one, up to MOST_ROWS rows, so a rule that forgets slowly
  (a moving average, whose last digits keep the past for some hundred rows) does not take a round
  for every small block: the rounds grow with the logarithm of the rows it remembers. Each round
  settles at least one block more per key, so the result is exact;
* rules that never forget (`forgets=False`, running ids) advance one block per key and round, all
  keys side by side; the blocks are stored by their number, so a round reads those due only.

A run of a block yields its output and its exit state together. States must leave out running
totals: those are summed afterwards.

A rule that gives every row some values of its own (`RowRule`) gets the columns of a block as lists; the other columns of
its rows stay in Arrow, so a small block costs little more than its rows. Other rules get a frame of pandas per block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType
from pyspark.sql.window import Window

from ..session import durable, scratch_path
from . import chains, scan

Step = Callable[[dict, pd.DataFrame], tuple[pd.DataFrame, dict]]
RANK, ENTRY, EXIT = "__rank", "__entry", "__exit"
COARSER, MOST_ROWS = 8, 50_000
ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass(frozen=True)
class RowRule:
    """`step(state, *columns read) -> (columns given, next state)` over the rows of a block, all columns as lists.

    A missing number is None where numbers are whole and NaN where they are not.
    """

    reads: tuple[str, ...]
    gives: tuple[str, ...]
    step: Callable[..., tuple[Sequence[list], dict]]


def dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks; a row with an entry state begins a block."""
    held = []  # what has come of the last block, which may go on in the next batch
    for batch in batches:
        starts = np.flatnonzero(batch.column(ENTRY).is_valid())
        if not len(starts):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
        if len(whole):
            yield whole
        held = [batch.slice(starts[-1])]
    if held and len(whole := pa.Table.from_batches(held)):
        yield whole


def rows_of(rule: RowRule, whole: pa.Table, out: dict[str, str], block: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Output of whole blocks, `out` giving the type of each column; a block's first row takes its exit state."""
    listed = lambda c: c.to_numpy().tolist() if pa.types.is_floating(c.type) else c.to_pylist()
    read, given = [listed(whole[c]) for c in rule.reads], whole[ENTRY].to_pylist()
    edges = [*np.flatnonzero(whole[ENTRY].is_valid()).tolist(), len(whole)]
    found, exits = [[] for _ in rule.gives], []
    for begin, end in zip(edges, edges[1:]):
        values, state = rule.step(json.loads(given[begin]), *[c[begin + 1:end] for c in read])
        for f, value in zip(found, values):
            f.append(None)
            f += value
        exits.append(dump(state))
        exits += [None] * (end - begin - 1)
    new = dict(zip(rule.gives, found))
    columns = {c: pa.array(new[c], ARROW[kind]) if c in new else whole[c].cast(ARROW[kind]) for c, kind in out.items()}
    columns |= {f"__of_{b}": whole[b] for b in block} | {ENTRY: whole[ENTRY], EXIT: pa.array(exits, pa.string())}
    yield from pa.table(columns).combine_chunks().to_batches()


def run_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step | RowRule, out_schema: str,
               start: dict, block_rows: int = 50_000, block_frames: int = 8192, forgets: bool = True,
               whole_frames: int | None = None) -> DataFrame:
    """Apply `step(state, ordered rows) -> (output rows, next state)` along each key.

    `out_schema` lists the output columns; states must survive JSON. `whole_frames` cuts blocks every
    so many frames instead of rows, for rules that need all rows of a frame together.
    """
    keys = list(keys)
    block = [*keys, scan.BLOCK]
    pos = scan.with_position(rows, keys, list(order), scan.block_of(order[0], block_frames))
    where = scan.block_of(order[0], whole_frames) if whole_frames else scan.block_of("__pos", block_rows)
    cut = durable(pos.withColumn(scan.BLOCK, where))
    first = dump(start)
    chain = Window.partitionBy(*keys).orderBy(scan.BLOCK)  # one row per block
    names = durable(cut.select(*block).distinct().withColumn(RANK, F.row_number().over(chain)))
    marks = [f"__of_{b}" for b in block]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = f"{out_schema}, {', '.join(f'{m} {kinds[b]}' for m, b in zip(marks, block))}, {ENTRY} string, {EXIT} string"
    out = dict(c.split() for c in out_schema.split(", "))
    columns = list(out)
    # a row in front of each block brings its entry state; whole numbers and flags must not become floats for its sake
    blank = {f.name: F.lit(0).cast(f.dataType) if isinstance(f.dataType, (IntegralType, BooleanType)) else F.lit(None).cast(f.dataType)
             for f in cut.schema.fields if f.name not in block}

    def run_rows(batches):
        for whole in whole_blocks(batches):
            yield from rows_of(step, whole, out, block)

    def run(batches):
        held = []  # what has come of the last block, which may go on in the next batch
        for pdf in batches:
            starts = np.flatnonzero(pdf[ENTRY].notna())
            if not len(starts):
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf.iloc[:starts[-1]]], ignore_index=True)
            if len(whole):
                yield blocks_of(whole)
            held = [pdf.iloc[starts[-1]:]]
        whole = pd.concat(held, ignore_index=True) if held else ()
        if len(whole):
            yield blocks_of(whole)

    def blocks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Output of whole blocks and, per block, a row with its entry and exit."""
        # objects and None throughout: a missing value of a map or array column must not become a float
        found = {c: [] for c in (*columns, *marks, ENTRY, EXIT)}
        edges = [*np.flatnonzero(pdf[ENTRY].notna()), len(pdf)]
        keyed = [pdf[b].tolist() for b in block]
        given = pdf[ENTRY].tolist()
        bare = pdf.drop(columns=ENTRY)
        for begin, end in zip(edges, edges[1:]):
            out, state = step(json.loads(given[begin]), bare.iloc[begin + 1:end].reset_index(drop=True))
            for c in columns:
                found[c] += [*out[c].tolist(), None]
            for m, k in zip(marks, keyed):
                found[m] += [k[begin]] * (len(out) + 1)
            found[ENTRY] += [None] * len(out) + [given[begin]]
            found[EXIT] += [None] * len(out) + [dump(state)]
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in found.items()})

    def evaluate(source: DataFrame, entries: DataFrame, every: bool = False) -> DataFrame:
        """Output rows, and a row with entry and exit per block; `entries`: block columns and entry, of `every` block or some."""
        some = source if every else source.join(entries.select(*block), block, "left_semi")
        wanted = some.select(*cut.columns).withColumn(ENTRY, F.lit(None).cast("string"))
        given = entries.select(*[blank[c].alias(c) if c in blank else F.col(c).cast(kinds[c]).alias(c) for c in cut.columns], ENTRY)
        parts = scan.spread_tasks(wanted.unionByName(given), block)
        ordered = parts.sortWithinPartitions(*block, F.col(ENTRY).isNull(), "__pos")
        return durable(ordered.mapInArrow(run_rows, schema) if isinstance(step, RowRule) else ordered.mapInPandas(run, schema))

    def exits(done: DataFrame) -> DataFrame:
        return done.filter(F.col(EXIT).isNotNull()).select(*[F.col(m).alias(b) for b, m in zip(block, marks)], ENTRY, EXIT)

    def output(done: DataFrame) -> DataFrame:
        return done.filter(F.col(EXIT).isNull()).select(*columns)

    if forgets:
        done, size = evaluate(cut, names.select(*block, F.lit(first).alias(ENTRY)), every=True), block_rows
        while True:
            states = names.join(exits(done), block)
            before = states.select(*keys, (F.col(RANK) + 1).alias(RANK), F.col(EXIT).alias("__true"))
            due = durable(states.join(before, [*keys, RANK], "left").withColumn("__true", F.coalesce("__true", F.lit(first))))
            stale = due.filter(F.col("__true") != F.col(ENTRY))
            if stale.isEmpty():
                return output(done)
            by = 1 if whole_frames else max(1, min(COARSER, MOST_ROWS // size))
            size, joined = size * by, F.floor(F.col(scan.BLOCK) / by).cast("long")
            # blocks that hold a stale one run again from the true entry of their first part, the others keep their rows
            parts = due.withColumn(scan.BLOCK, joined).join(stale.select(*keys, joined.alias(scan.BLOCK)).distinct(), block, "left_semi")
            entries = durable(parts.groupBy(*block).agg(F.min_by("__true", RANK).alias(ENTRY)))
            whole = due.withColumn(scan.BLOCK, joined).groupBy(*block).agg(F.min_by(ENTRY, RANK).alias(ENTRY), F.max_by(EXIT, RANK).alias(EXIT))
            cut = cut.withColumn(scan.BLOCK, joined)
            names = durable(names.select(*keys, joined.alias(scan.BLOCK)).distinct().withColumn(RANK, F.row_number().over(chain)))
            old = entries.select(*[F.col(b).alias(m) for b, m in zip(block, marks)])
            kept = done.filter(F.col(EXIT).isNull()).withColumn(marks[-1], F.floor(F.col(marks[-1]) / by).cast("long"))
            ends = whole.select(*[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in columns], *[F.col(b).alias(m) for b, m in zip(block, marks)], ENTRY, EXIT)
            done = durable(kept.unionByName(ends).join(old, marks, "left_anti").select(*done.columns).unionByName(evaluate(cut, entries)))

    path = scratch_path(rows.sparkSession, "blocks")
    ranked = cut.join(names, block)
    ranked.repartition(*block).write.partitionBy(RANK).parquet(path)
    stored = rows.sparkSession.read.schema(ranked.schema).parquet(path)
    last = names.agg(F.max(RANK).alias("n")).first()["n"] or 0
    entries, results = names.filter(F.col(RANK) == 1).select(*block, F.lit(first).alias(ENTRY)), None
    for rank in range(1, last + 1):
        done = evaluate(stored.filter(F.col(RANK) == rank), entries)
        results = output(done) if results is None else results.unionByName(output(done))
        entries = names.filter(F.col(RANK) == rank + 1).join(exits(done).select(*keys, F.col(EXIT).alias(ENTRY)), keys).select(*block, ENTRY)
    return output(evaluate(cut, entries)) if results is None else results


# ---- trajectory validation -------------------------------------------------------------------

def validity_step(fps: float = 30.0, max_speed: float = 10.0, max_accel: float = 5.0) -> RowRule:
    """Compare with the last accepted point; too fast or too sudden is rejected and not remembered."""
    def step(state, xs, ys, frames):
        trail = state["trail"]  # last two accepted (x, y, frame)
        verdicts = []
        for x, y, frame in zip(xs, ys, frames):
            reason = None
            if trail:
                ax, ay, at = trail[-1]
                dt = (frame - at) / fps
                speed = math.hypot(x - ax, y - ay) / dt if dt > 0 else None
                if speed is not None and speed > max_speed:
                    reason = "velocity"
                elif speed is not None and len(trail) == 2:
                    bx, by, bt = trail[0]
                    gap = (at - bt) / fps
                    if gap > 0 and abs(speed - math.hypot(ax - bx, ay - by) / gap) / dt > max_accel:
                        reason = "acceleration"
            if reason is None:
                trail = [*trail[-1:], [float(x), float(y), int(frame)]]
            verdicts.append(reason)
        return ([v is None for v in verdicts], verdicts), {"trail": trail}
    return RowRule(("x", "y", "frame"), ("valid", "reason"), step)


def validate_trajectories(rows: DataFrame, fps: float = 30.0, max_speed: float = 10.0, max_accel: float = 5.0,
                          block_rows: int = 50_000) -> DataFrame:
    return run_blocks(rows.select("match_id", "track_id", "frame", "seq", "x", "y"), ["match_id", "track_id"],
                      ["frame", "seq"], validity_step(fps, max_speed, max_accel),
                      "match_id long, track_id long, frame long, seq long, valid boolean, reason string",
                      {"trail": []}, block_rows)


# ---- rate limits and gates -------------------------------------------------------------------

def rate_limit(alerts: DataFrame, seconds: float = 10.0, keys=("match_id", "alert_key"), block: int = 1 << 32) -> DataFrame:
    """At most one alert per key every `seconds` of event time, counted from the last one sent.

    Event time counts to the microsecond; of alerts at the same time the first by (frame, seq) may go. Alerts without
    a timestamp are not sent.
    """
    keys = list(keys)
    timed = alerts.withColumn("__at", F.round(F.col("timestamp") * 1_000_000).cast("long")).filter("__at IS NOT NULL")
    first = timed.groupBy(*keys, "__at").agg(F.min_by(F.struct(*alerts.columns), F.struct("frame", "seq")).alias("__row"))
    gap = round(seconds * 1_000_000)
    if gap > 0:
        sent = chains.taken(first.select(*keys, F.col("__at").alias("at")), keys, gap, block=block)
        first = first.join(sent.withColumnRenamed("at", "__at"), [*keys, "__at"], "left_semi")
    return first.select("__row.*")


def check_points(batch_ends: DataFrame, gate: int, block: int = 65536 * 64) -> DataFrame:
    """Batch ends at which a check is due: the first at least `gate` frames after the last check, or after the start."""
    ends = batch_ends.select("match_id", F.col("frame").alias("at")).distinct()
    return chains.taken(ends, ["match_id"], gate, F.col("at") >= gate, block).withColumnRenamed("at", "frame")


# ---- team assignment -------------------------------------------------------------------------

def hold_team(rows: DataFrame, hold: int = 12, factor: float = 0.85, block_rows: int = 50_000) -> DataFrame:
    """Confirmed team per track. Within `hold` frames of the last confirmation another team must be
    closer by `factor`; a vote of -1 (no team) changes nothing. Rows: match_id, track_id, frame, seq, team (majority), d0, d1."""
    def step(state, frames, votes, *distances):
        team, since, out = state["team"], state["since"], []
        for frame, vote, d0, d1 in zip(frames, votes, *distances):
            dist = (d0, d1)
            free = team is None or since is None or frame - since >= hold
            if vote in (0, 1) and vote != team and (free or dist[vote] < factor * dist[team]):
                team, since = int(vote), int(frame)
            out.append(team)
        if since is not None and frames and frames[-1] - since >= hold:
            since = None  # the hold is over, when it began no longer matters
        return (out,), {"team": team, "since": since}

    rule = RowRule(("frame", "team", "d0", "d1"), ("held_team",), step)
    return run_blocks(rows, ["match_id", "track_id"], ["frame", "seq"], rule,
                      "match_id long, track_id long, frame long, seq long, held_team long",
                      {"team": None, "since": None}, block_rows)


def drifting_centroids(rows: DataFrame, start: tuple, alpha: float = 0.2, limit: float = 25.0,
                       block_rows: int = 50_000) -> DataFrame:
    """Nearest of two colour centroids within `limit` (else -1); the winner moves by `alpha`.
    `start` holds the two initial (L, a, b)."""
    def step(state, *channels):
        pair, out = [list(p) for p in state["pair"]], []
        for sample in zip(*channels):
            dist = [math.dist(sample, p) for p in pair]
            best = 0 if dist[0] <= dist[1] else 1
            if dist[best] > limit:
                best = -1
            else:
                pair[best] = [(1 - alpha) * p + alpha * float(s) for p, s in zip(pair[best], sample)]
            out.append(best)
        return (out,), {"pair": pair}

    return run_blocks(rows, ["match_id"], ["seq"], RowRule(("L", "a", "b"), ("team",), step), "match_id long, seq long, team long",
                      {"pair": [list(p) for p in start]}, block_rows)


# ---- greedy track matching -------------------------------------------------------------------

def similarities(vectors: np.ndarray, tracks: Sequence[dict]) -> np.ndarray:
    """Largest cosine of each vector with the remembered vectors of each track."""
    if not len(tracks):
        return np.zeros((len(vectors), 0))
    seen = np.array([v for t in tracks for v in t["vecs"]])
    lengths = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(seen, axis=1)
    starts = np.concatenate([[0], np.cumsum([len(t["vecs"]) for t in tracks])[:-1]])
    return np.maximum.reduceat(vectors @ seen.T / (lengths + 1e-6), starts, axis=1)


def overlaps(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of each box with each other box."""
    a, b = boxes[:, None, :], others[None, :, :]
    shared = np.prod(np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0.0), axis=-1)
    area = lambda r: np.prod(r[..., 2:] - r[..., :2], axis=-1)
    return shared / (area(a) + area(b) - shared + 1e-6)


def first_come(scores: np.ndarray, floor: float) -> dict[int, int]:
    """Row -> column: rows in order take their best column above `floor` among those left, ties to the first."""
    left, taken = scores.copy(), {}
    for i in range(len(left) if left.shape[1] else 0):
        best = int(np.argmax(left[i]))
        if left[i, best] > floor:
            taken[i] = best
            left[:, best] = -np.inf
    return taken


def greedy_step(max_age: float = 5.0, max_lost: float = 120.0, history: int = 20, recover: float = 0.5,
                accept: float = 0.4, fps: float = 30.0) -> Step:
    """Per frame: lost tracks go to the first detection whose best lost track they are; the other
    detections in order take the best free active track by 0.8 similarity + 0.2 overlap; whatever is
    left opens a new id. Every detection gets an id. Ties go to the lower id."""
    def step(state, pdf):
        tracks = {int(k): t for k, t in state["tracks"].items()}
        next_id, ids = state["next_id"], []
        for frame, group in pdf.groupby("frame", sort=True):
            now = float(frame) / fps
            boxes, vectors = group[["x1", "y1", "x2", "y2"]].to_numpy(float), np.stack(group["vec"]).astype(float)
            tracks = {k: t for k, t in tracks.items() if not t["lost"] or now - t["seen"] <= max_lost}
            gone = sorted(k for k, t in tracks.items() if t["lost"])
            wish = similarities(vectors, [tracks[k] for k in gone])
            owner: dict[int, int] = {}
            if gone:
                best = wish.argmax(axis=1)
                for i in np.flatnonzero(wish.max(axis=1) > recover):
                    if gone[best[i]] not in owner.values():
                        owner[int(i)] = gone[best[i]]
            free = sorted(k for k, t in tracks.items() if not t["lost"])
            rest = [i for i in range(len(group)) if i not in owner]
            if free and rest:
                known = [tracks[k] for k in free]
                score = 0.8 * similarities(vectors[rest], known) + 0.2 * overlaps(boxes[rest], np.array([t["box"] for t in known]))
                owner |= {rest[i]: free[j] for i, j in first_come(score, accept).items()}
            for i in range(len(group)):
                if i not in owner:
                    owner[i], next_id = next_id, next_id + 1
                past = tracks.get(owner[i], {"vecs": []})["vecs"]
                tracks[owner[i]] = {"box": boxes[i].tolist(), "seen": now, "vecs": [*past, vectors[i].tolist()][-history:], "lost": False}
            for k, t in tracks.items():
                t["lost"] = t["lost"] or now - t["seen"] > max_age
            ids += [owner[i] for i in range(len(group))]
        ordered = pdf.sort_values("frame", kind="stable")
        out = ordered[["match_id", "frame", "seq"]].assign(track_id=ids)
        return out, {"tracks": tracks, "next_id": next_id}

    return step


def greedy_match(detections: DataFrame, block_rows: int = 50_000, block_frames: int = 1800, **rules) -> DataFrame:
    """Track ids per detection (match_id, frame, seq, x1..y2, vec). Ids run on, so this never forgets."""
    return run_blocks(detections, ["match_id"], ["frame", "seq"], greedy_step(**rules),
                      "match_id long, frame long, seq long, track_id long",
                      {"tracks": {}, "next_id": 1}, block_rows, forgets=False,
                      whole_frames=block_frames)
