"""What a stream reports to the driver follows the cluster, not the session's shuffle partitions."""

import json
from pathlib import Path

from pitchlake.streaming import live


def test_state_partitions_are_bounded(spark, tmp_path):
    root = str(tmp_path)
    rows = [(m, f, 100 * m + f, f // 5 % 2, f % 3) for m in range(4) for f in range(20)]
    spark.createDataFrame(rows, live.OBSERVATION).write.parquet(f"{root}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        stream = live.possession_stream(live.observation_stream(spark, f"{root}/in"), 3)
        live.start_job(stream, f"{root}/checkpoint", live.publish_stats(root, live.live_dominance(root, 10.0)), tasks=3).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "300"
        live.start_job(stream, f"{root}/other", lambda batch, epoch: batch.write.mode("overwrite").format("noop").save()).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    used = [json.loads((Path(root) / f / "offsets" / "0").read_text().splitlines()[1])["conf"]["spark.sql.shuffle.partitions"] for f in ("checkpoint", "other")]
    assert used == ["3", "64"]
    got = spark.read.parquet(f"{root}/possession").select("match_id", "frame", "seq", "team", "player").collect()
    assert sorted(map(tuple, got)) == rows
    events = spark.read.parquet(f"{root}/events").collect()
    assert sorted((r.match_id, r.rows, r.last_frame) for r in events) == [(m, 20, 19) for m in range(4)]
