"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pitchlake.plans import registry
from pitchlake.session import build_session

HEADLINE = (
    "E1_possession_hysteresis", "E3_pass_detection", "A1_possession_stats", "E5_timeline", "J1_ball_owner",
    "E6_window_dominance", "A6_zone_time", "A8_heatmap_counts_lineitem", "A14_gaussian_smooth", "A25_keypoint_mean",
    "G3_triangulate", "J6_reid_recover", "J10_line_crossings", "ST3_kalman_smooth", "ST5_passing_chains",
    "E19_cumulative_progress", "AL1_dominance", "E8_weighted_homography", "G1_fit_homography", "G5_greedy_match",
    "ST2_possession_v1", "ST13_live_stats", "S1_read_detections", "AL12_alert_table")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, timings = registry.queries(share=False), {}
    # start the engine and its Python workers, so that the first query timed doesn't pay for them
    for name in ("J1_ball_owner", "ST14_team_hold"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        # every call starts from the tables; the no-op sink evaluates all columns of all rows
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
