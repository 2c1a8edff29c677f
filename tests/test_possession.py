import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import possession as po
from pitchlake.operators import scan
from tests import restated

SCHEMA = "match_id long, frame long, seq long, team long, player long"


def random_match(rng, match_id, rows):
    frame, out, team = rng.randint(0, 3), [], None
    for seq in range(rows):
        if rng.random() < 0.35:
            team = rng.choice([None, 0, 1, 2])
        out.append((match_id, frame, seq, team, rng.choice([None, 1, 2, 3]) if team is not None else None))
        frame += rng.choice([0, 1, 1, 2, 9])
    return out


@pytest.mark.parametrize("n,block", [(1, 3), (2, 4), (3, 7), (5, 8192)])
def test_matches_restatement_across_blocks(spark, n, block):
    rng = random.Random(n * 100 + block)
    matches = {m: random_match(rng, m, rng.randint(1, 60)) for m in range(25)}
    df = spark.createDataFrame([r for rows in matches.values() for r in rows], SCHEMA)
    frames = po.possession_frames(df, n, block).persist()
    credit = {(r.match_id, r.team): r.f for r in po.attributed_frames(frames).groupBy("match_id", "team")
              .agg(F.sum("frames").alias("f")).collect()}
    passes = {m: [] for m in matches}
    for r in sorted(po.passes(frames, block).collect(), key=lambda r: (r.frame, r.seq)):
        passes[r.match_id].append((r.frame, r.team, r.from_player, r.to_player))
    lines = {m: [] for m in matches}
    for r in sorted(po.timeline(frames, block).collect(), key=lambda r: (r.start_frame, r.seq)):
        lines[r.match_id].append((r.start_frame, r.end_frame, r.team))
    for m, rows in matches.items():
        want, made, segments = restated.possession([(f, t, p) for _, f, _, t, p in rows], n)
        assert {t: f for (mm, t), f in credit.items() if mm == m} == {t: f for t, f in want.items() if f}
        assert passes[m] == made
        assert lines[m] == segments


def test_worked_example(spark):
    team = [0] * 10 + [None] * 5 + [1] * 10 + [None] * 5 + [0] * 10
    df = spark.createDataFrame([(1, i + 1, 0, t, None) for i, t in enumerate(team)], SCHEMA)
    frames = po.possession_frames(df, 5, 8).persist()
    stats = {r.team: r for r in po.possession_stats(frames).collect()}
    assert (stats[0].frames, stats[1].frames) == (25, 15)
    assert (stats[0].percent, stats[1].percent) == (62.5, 37.5)
    line = sorted((r.start_frame, r.end_frame, r.team) for r in po.timeline(frames).collect())
    assert line == [(1, 20, 0), (20, 35, 1), (35, 40, 0)]
    assert po.passes(frames).count() == 0
    assert po.coverage(frames).first().complete


def test_no_owner_at_all(spark):
    df = spark.createDataFrame([(1, i, 0, None, None) for i in range(5)], SCHEMA)
    frames = po.possession_frames(df, 3, 2)
    assert {(r.team, r.frames, r.percent) for r in po.possession_stats(frames).collect()} == {(0, 0, 0.0), (1, 0, 0.0)}
    assert not po.current_state(frames).first().initialized


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_rows_since_marks_and_changes_across_blocks(spark, block):
    rng = random.Random(block)
    rows = [(m, f, s, rng.choice([None, 0, 1]) if rng.random() < 0.3 else 0, rng.random() < 0.15) for m in range(3) for f in range(60) for s in range(rng.randrange(0, 3))]
    rows += [(9, f, 0, None, False) for f in range(20)]
    df = spark.createDataFrame(rows, "match_id long, frame long, seq long, state int, mark boolean").repartition(4)
    got = scan.prefix_scan(df, ["match_id"], ["frame", "seq"], scan.block_of("frame", block),
                           {"run": scan.run_length("state"), "ago": scan.since("mark"), "n": scan.total(F.lit(1))})
    want, run, ago, n = {}, {}, {}, {}
    for i, (m, f, s, state, mark) in enumerate(sorted(rows, key=lambda r: r[:3])):
        before = want.get((m, "state"), "none")
        run[m] = run[m] + 1 if before == ("is", state) else 0
        want[m, "state"] = ("is", state)
        ago[m] = 0 if mark else None if ago.get(m) is None else ago[m] + 1
        n[m] = n.get(m, 0) + 1
        want[m, f, s] = (run[m], ago[m], n[m])
    assert {(r.match_id, r.frame, r.seq): (r.run, r.ago, r.n) for r in got.collect()} == {k: v for k, v in want.items() if len(k) == 3}
    assert got.columns == [*df.columns, "run", "ago", "n"]
