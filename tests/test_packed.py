"""Tables of very many matches or batches take a bounded number of files, with the rows they had as folders."""

from pyspark.sql import functions as F

from pitchlake.plans import registry
from pitchlake.plans.views import Views
from pitchlake.sources import readers, writers

ROWS = [(m, b, 10 * b + f, f % 2, m + f) for m in range(60) for b in range(10) for f in range(2)]


def files(path):
    return [*path.rglob("*.txt"), *path.rglob("*.parquet"), *path.rglob("*.json")]


def test_many_documents_are_packed_and_read_alike(spark, tmp_path):
    events = spark.createDataFrame(ROWS, "match_id long, batch_idx long, frame long, team int, from_player long").withColumn("type", F.lit("pass"))
    few, many = tmp_path / "few", tmp_path / "many"
    writers.write_batch_documents(events, str(many), "type", "frame", "team", "from_player")
    writers.write_batch_documents(events.filter("match_id < 5"), str(few), "type", "frame", "team", "from_player")
    assert len(files(many)) <= writers.BUCKETS < 600 and len(files(few)) == 50
    read = lambda path: sorted((r.match_id, r.batch_idx, r.frame, r.team, r.from_player, r.type, r.to_player) for r in readers.read_events(spark, str(path), "*.txt").collect())
    assert read(many) == sorted((str(m), b, f, t, p, "pass", None) for m, b, f, t, p in ROWS)
    assert read(few) == [r for r in read(many) if int(r[0]) < 5]
    writers.write_batch_documents(events.filter("match_id = 7 AND batch_idx = 3").withColumn("frame", F.lit(-1)), str(many), "type", "frame", "team", "from_player")
    again = read(many)  # a replay replaces its batch only
    assert len(again) == len(ROWS) and [r[2] for r in again if r[:2] == ("7", 3)] == [-1, -1] and sum(r[2] < 0 for r in again) == 2


def test_many_states_are_packed_replaced_and_deleted(spark, tmp_path):
    path = tmp_path / "states"
    states = spark.range(700).select(F.when(F.col("id") < 699, F.col("id")).alias("match_id"), F.col("id").alias("n"))  # one match is null
    writers.save_state(states, str(path))
    assert len(files(path)) <= writers.BUCKETS
    writers.save_state(states.filter("match_id % 2 = 0 OR match_id IS NULL").withColumn("n", -F.col("n")), str(path))
    writers.delete_state(spark, str(path), states.filter("match_id % 5 = 3").select("match_id"))
    assert len(files(path)) <= writers.BUCKETS
    left = {r.match_id: r.n for r in writers.read_states(spark, str(path)).collect()}
    assert left == {None: -699} | {m: -m if m % 2 == 0 else m for m in range(699) if m % 5 != 3}


def test_many_match_documents_and_chunks(spark, tmp_path):
    docs, chunks = tmp_path / "docs", tmp_path / "chunks"
    counters = F.create_map(F.lit("0"), F.col("id"))
    writers.write_match_states(spark.range(300).select(F.col("id").alias("match_id"), F.struct(
        counters.alias("frames_by_team"), counters.alias("passes_by_team")).alias("possession_state")), str(docs))
    assert len(files(docs)) <= writers.BUCKETS
    rows = readers.team_counters(readers.read_match_state(spark, str(docs))).collect()
    assert sorted((int(r.match_id), r.team, r.frames, r.passes) for r in rows) == [(m, 0, m, m) for m in range(300)]
    df = spark.createDataFrame(ROWS, "match_id long, batch_idx long, frame long, team int, from_player long")
    writers.write_chunk_outputs(str(chunks), detections=df)
    writers.write_chunk_outputs(str(chunks), detections=df.filter("batch_idx = 1").withColumn("frame", F.lit(-1)))
    assert len(files(chunks)) <= writers.BUCKETS
    back = spark.read.parquet(f"{chunks}/detections").select("match_id", "batch_idx", "frame", "team", "from_player").collect()
    assert sorted(map(tuple, back)) == sorted((m, b, -1 if b == 1 else f, t, p) for m, b, f, t, p in ROWS)


def test_upserts_and_tombstones_read_the_observations_once(spark, tmp_path):
    """Every save and delete works on the states of the matches, not on the rows they come from."""
    registry.load()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(m, f) for m in range(400) for f in range(1 + m % 4)]
    v = Views(spark, str(tmp_path))
    v.__dict__["obs"] = spark.createDataFrame(rows, "match_id long, frame long").mapInArrow(counted, "match_id long, frame long")
    got = sorted(map(tuple, registry.QUERIES["S8_upsert_delete_state"](v).collect()))
    assert got == [(m, m % 4 + (m % 2 == 0)) for m in range(400) if m % 5 != 3]
    assert read.value == len(rows)  # before, four times
