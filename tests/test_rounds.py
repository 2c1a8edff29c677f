"""Rules in blocks: rounds do not grow with the number of blocks."""

import math
import random
import time

import pyarrow as pa
import pytest

from pitchlake.operators import machine


def drift_by_hand(rows, start, alpha, limit):
    pair, out = [list(p) for p in start], {}
    for seq, *sample in rows:
        dist = [math.dist(sample, p) for p in pair]
        best = 0 if dist[0] <= dist[1] else 1
        if dist[best] > limit:
            best = -1
        else:
            pair[best] = [(1 - alpha) * p + alpha * s for p, s in zip(pair[best], sample)]
        out[seq] = best
    return out


def test_rounds_of_a_rule_that_forgets_slowly(spark, monkeypatch):
    """A moving average keeps the past in its last digits for more rows than a block has."""
    rng = random.Random(4)
    rows = {m: [(i, *(rng.gauss(100 + 20 * rng.randrange(2), 12) for _ in range(3))) for i in range(n)] for m, n in ((1, 1200), (2, 300), (3, 7))}
    start = ((90.0, 120.0, 120.0), (110.0, 135.0, 135.0))
    df = spark.createDataFrame([(m, *r) for m, some in rows.items() for r in some], "match_id long, seq long, L double, a double, b double")
    written = []
    monkeypatch.setattr(machine, "durable", lambda df, f=machine.durable: written.append(1) or f(df))
    got = {(r.match_id, r.seq): r.team for r in machine.drifting_centroids(df, start, limit=60.0, block_rows=10).collect()}
    assert got == {(m, s): t for m, some in rows.items() for s, t in drift_by_hand(some, start, 0.2, 60.0).items()}
    assert len(written) < 40  # 120 blocks; before, a round for each block or two


def test_rounds_of_many_short_tracks(spark, monkeypatch):
    """After one point the rest lies far off and is rejected, which no block can tell from its own rows."""
    rows = [(1, t, f, f, 0.0 if f == 0 else 1e6 + t, 0.0) for t in range(40) for f in range(24)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, frame long, seq long, x double, y double")
    written = []
    monkeypatch.setattr(machine, "durable", lambda df, f=machine.durable: written.append(1) or f(df))
    got = {(r.track_id, r.seq): (r.valid, r.reason) for r in machine.validate_trajectories(df, block_rows=3).collect()}
    assert got == {(t, f): (True, None) if f == 0 else (False, "velocity") for t in range(40) for f in range(24)}
    assert len(written) < 20  # before, a round for each of the 9 blocks of a track


def test_very_many_small_blocks_cost_little_more_than_their_rows(spark):
    """Two steps a track, the second too fast, in blocks of one row: a frame of pandas for each took over two milliseconds."""
    tracks = 40_000
    rows = spark.range(2 * tracks, numPartitions=8).selectExpr(
        "CAST(1 AS LONG) AS match_id", "id div 2 AS track_id", "id % 2 AS frame", "id AS seq", "CAST(100 * (id % 2) AS DOUBLE) AS x", "0D AS y")
    machine.validate_trajectories(rows.limit(64)).collect()  # starts the workers
    start = time.monotonic()
    got = machine.validate_trajectories(rows, block_rows=1)
    spent = time.monotonic() - start  # the rounds run before the result is read
    assert {(r.frame, r.valid, r.reason, r["count"]) for r in got.groupBy("frame", "valid", "reason").count().collect()} == {
        (0, True, None, tracks), (1, False, "velocity", tracks)}
    assert spent < 25


@pytest.mark.parametrize("cut", [1, 3, 7, 100])
def test_blocks_across_batches(cut):
    """A block may go on in the next Arrow batch; its rows keep their columns and its first row takes the exit state."""
    rule = machine.RowRule(("n", "w"), ("total",), lambda state, ns, ws: (([sum(ns[:i + 1]) + state["s"] for i in range(len(ns))],), {"s": state["s"] + len([w for w in ws if w != w])}))
    sizes, lines = [2, 0, 5, 1], []
    for b, size in enumerate(sizes):
        lines.append((b, 0, None, '{"s": %d}' % (100 * b)))
        lines += [(b, n, None if n % 2 else float(n), None) for n in range(1, size + 1)]
    table = pa.table({c: pa.array(values, kind) for c, values, kind in zip(
        ("key", "n", "w", machine.ENTRY), zip(*lines), (pa.int64(), pa.int32(), pa.float64(), pa.string()))})
    out = {"n": "long", "total": "long"}
    got = [r for whole in machine.whole_blocks(table.to_batches(max_chunksize=cut)) for batch in machine.rows_of(rule, whole, out, ["key"]) for r in batch.to_pylist()]
    assert [(r["__of_key"], r["n"], r["total"]) for r in got if r[machine.EXIT] is None] == [
        (b, n, 100 * b + n * (n + 1) // 2) for b, size in enumerate(sizes) for n in range(1, size + 1)]
    assert [(r["__of_key"], r[machine.ENTRY], r[machine.EXIT]) for r in got if r[machine.EXIT] is not None] == [
        (b, '{"s": %d}' % (100 * b), '{"s": %d}' % (100 * b + (size + 1) // 2)) for b, size in enumerate(sizes)]
