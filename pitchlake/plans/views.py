"""Tracking-shaped views over the driver tables, as DataFrames and as DuckDB CTEs.

The driver supplies no tracking data, so each view derives one from `events` or `embeddings`; every
row of the source table yields a row. Both forms are kept side by side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pitch
from ..operators import possession as po
from ..session import durable

POINT_NAMES = list(pitch.DETECTED_POINTS)
BATCH = 720  # frames per micro-batch of `obs`
HYSTERESIS = 3  # runs of five are rare in the driver's random events


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}
        self.folders: dict[str, str] = {}  # what jobs left on storage

    def once(self, name: str, build) -> DataFrame:
        """A result several queries read, written once to the shared folder."""
        if name not in self._written:
            self._written[name] = durable(build())
        return self._written[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        # props is always {"k": n}. Views over `k` are pushed into filters, which repeats this
        # expression, so it is cut out as text instead of parsed as JSON.
        k = F.substring_index(F.substring_index("props", ":", -1), "}", 1).cast("long")
        return self.table("events").select(
            F.expr("user_id div 15").alias("match_id"),
            F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("minute"),
            F.col("event_id").alias("seq"), "user_id", "event_type", "value", k.alias("k"))

    @cached_property
    def obs(self) -> DataFrame:
        team = F.when(F.col("event_type") != "error", F.col("user_id") % 2)
        return self.base.select("match_id", F.col("minute").alias("frame"), "seq",
                                F.col("user_id").alias("player"), team.alias("team"), "k", "value")

    @property
    def frames(self) -> DataFrame:
        return self.once("frames", lambda: po.possession_frames(self.obs.drop("k", "value"), n=HYSTERESIS))

    @property
    def passed(self) -> DataFrame:
        return self.once("passed", lambda: po.passes(self.frames))

    @property
    def progress(self) -> DataFrame:
        return self.once("progress", lambda: po.cumulative_progress(self.frames, self.passed, BATCH))

    @cached_property
    def det(self) -> DataFrame:
        kind = (F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2)
                .when(F.col("event_type") == "purchase", 3).otherwise(0))
        base = self.base.withColumns({
            "class_id": kind, "X": 105.0 * F.col("k") / 99.0,
            "Y": F.col("value") - 68.0 * F.floor(F.col("value") / 68.0),
            "w": 10.0 + F.col("k") % 30, "h": 20.0 + F.col("k") % 50})
        return base.select(
            "match_id", F.expr("minute div 240").alias("frame"), "seq",
            F.col("user_id").alias("track_id"), "class_id",
            F.when(F.col("class_id").isin(1, 2), -1).otherwise(F.col("user_id") % 2).alias("team_id"),
            (12.0 * F.col("X") - F.col("w") / 2.0).alias("x1"), (10.0 * F.col("Y") - F.col("h") / 2.0).alias("y1"),
            (12.0 * F.col("X") + F.col("w") / 2.0).alias("x2"), (10.0 * F.col("Y") + F.col("h") / 2.0).alias("y2"),
            ((F.col("k") + 1) / 100.0).alias("conf"), "X", "Y")

    @cached_property
    def players(self) -> DataFrame:
        return self.det.filter("class_id IN (0, 3)")

    @cached_property
    def kp(self) -> DataFrame:
        """Pitch points seen through a fixed camera: one homography plus a jitter below a pixel."""
        idx = (F.col("k") % 16).cast("int")
        coords = [pitch.DETECTED_POINTS[n] for n in POINT_NAMES]
        base = self.base.select(
            "match_id", F.expr("minute div 720").alias("frame"), "seq",
            pitch.name_lookup(POINT_NAMES, idx).alias("name"),
            pitch.name_lookup([p[0] for p in coords], idx).alias("PX"),
            pitch.name_lookup([p[1] for p in coords], idx).alias("PY"),
            ((F.col("value") - F.floor(F.col("value"))) * 0.5).alias("j"),
            ((F.col("k") + 1) / 100.0).alias("conf"))
        depth = 1.0 + 0.002 * F.col("PY")
        return base.select(
            "match_id", "frame", "seq", "name",
            ((11.0 * F.col("PX") + 1.5 * F.col("PY") + 40.0) / depth + F.col("j")).alias("x"),
            ((0.4 * F.col("PX") - 9.0 * F.col("PY") + 700.0) / depth - F.col("j")).alias("y"), "conf")

    @cached_property
    def seen(self) -> DataFrame:
        """One observation per named point and frame: the most trusted, then the first."""
        rank = F.struct(-F.col("conf"), F.col("seq"))
        return self.kp.groupBy("match_id", "frame", "name").agg(
            F.min_by(F.struct("x", "y", "conf"), rank).alias("p")).select(
            "match_id", "frame", "name", "p.x", "p.y", "p.conf")

    @cached_property
    def colour(self) -> DataFrame:
        e = lambda i: F.col("embedding")[i].cast("double")
        return self.table("embeddings").select(
            F.expr("(vec_id div 5) % 4").alias("match_id"), F.expr("vec_id div 5").alias("track_id"),
            F.col("vec_id").alias("seq"), (100.0 + 300.0 * e(0)).alias("L"),
            (128.0 + 200.0 * e(1)).alias("a"), (128.0 + 200.0 * e(2)).alias("b"),
            (90.0 + 300.0 * e(3)).alias("H"), (128.0 + 500.0 * e(4)).alias("S"),
            (100.0 + 400.0 * e(5)).alias("V"), (F.col("vec_id") % 4).alias("class_id"),
            (0.001 * (F.col("vec_id") % 7)).alias("area_ratio"))

    @cached_property
    def feat(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("label").cast("long").alias("match_id"), "vec_id",
            F.col("embedding").alias("vec"), F.expr("vec_id % 2").alias("side"))

    @cached_property
    def lines(self) -> DataFrame:
        """Straight segments, alternating near-horizontal and near-vertical."""
        flat = F.col("k") % 2 == 0
        cx, cy = 12.0 * (105.0 * F.col("k") / 99.0), 10.0 * (F.col("value") - 68.0 * F.floor(F.col("value") / 68.0))
        half, tilt = 20.0 + 4.0 * (F.col("seq") % 50), 0.5 * (F.col("seq") % 9) - 2.0
        return self.base.select(
            "match_id", F.expr("minute div 240").alias("frame"), "seq",
            (cx - F.when(flat, half).otherwise(tilt)).alias("x1"), (cy - F.when(flat, tilt).otherwise(half)).alias("y1"),
            (cx + F.when(flat, half).otherwise(tilt)).alias("x2"), (cy + F.when(flat, tilt).otherwise(half)).alias("y2"))


_names = "[" + ", ".join(f"'{n}'" for n in POINT_NAMES) + "]"
_px = "[" + ", ".join(f"{pitch.DETECTED_POINTS[n][0]!r}::DOUBLE" for n in POINT_NAMES) + "]"
_py = "[" + ", ".join(f"{pitch.DETECTED_POINTS[n][1]!r}::DOUBLE" for n in POINT_NAMES) + "]"

CTES: dict[str, str] = {
    "base": """SELECT user_id // 15 AS match_id,
        CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / 60) AS BIGINT) AS minute,
        event_id AS seq, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "obs": """SELECT match_id, minute AS frame, seq, user_id AS player,
        CASE WHEN event_type <> 'error' THEN user_id % 2 END AS team, k, value FROM base""",
    "det0": """SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS class_id,
        105.0::DOUBLE * k / 99.0::DOUBLE AS X, value - 68.0::DOUBLE * floor(value / 68.0::DOUBLE) AS Y,
        10.0::DOUBLE + k % 30 AS w, 20.0::DOUBLE + k % 50 AS h FROM base""",
    "det": """SELECT match_id, minute // 240 AS frame, seq, user_id AS track_id, class_id,
        CASE WHEN class_id IN (1, 2) THEN -1 ELSE user_id % 2 END AS team_id,
        12.0::DOUBLE * X - w / 2 AS x1, 10.0::DOUBLE * Y - h / 2 AS y1,
        12.0::DOUBLE * X + w / 2 AS x2, 10.0::DOUBLE * Y + h / 2 AS y2,
        (k + 1) / 100.0::DOUBLE AS conf, X, Y FROM det0""",
    "players": "SELECT * FROM det WHERE class_id IN (0, 3)",
    "kp0": f"""SELECT match_id, minute // 720 AS frame, seq, ({_names})[k % 16 + 1] AS name,
        ({_px})[k % 16 + 1] AS PX, ({_py})[k % 16 + 1] AS PY,
        (value - floor(value)) * 0.5::DOUBLE AS j, (k + 1) / 100.0::DOUBLE AS conf FROM base""",
    "kp": """SELECT match_id, frame, seq, name,
        (11.0::DOUBLE * PX + 1.5::DOUBLE * PY + 40.0::DOUBLE) / (1.0::DOUBLE + 0.002::DOUBLE * PY) + j AS x,
        (0.4::DOUBLE * PX - 9.0::DOUBLE * PY + 700.0::DOUBLE) / (1.0::DOUBLE + 0.002::DOUBLE * PY) - j AS y, conf FROM kp0""",
    "seen": """SELECT match_id, frame, name, x, y, conf FROM kp
        QUALIFY row_number() OVER (PARTITION BY match_id, frame, name ORDER BY conf DESC, seq) = 1""",
    "points": "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', {x!r}::DOUBLE, {y!r}::DOUBLE, {str(n in pitch.HALFWAY_POINTS).lower()}, {pitch.POINT_PRIORITY.get(n, 50)})"
        for n, (x, y) in pitch.DETECTED_POINTS.items()) + ") t(name, PX, PY, unambiguous, priority)",
    "excl": "SELECT * FROM (VALUES " + ", ".join(
        f"({x!r}::DOUBLE, {y!r}::DOUBLE)" for x, y in pitch.exclusion_points()) + ") t(ex, ey)",
    "model": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{n}', {str(n in pitch.CRITICAL_POINTS).lower()})"
        for i, n in enumerate(pitch.calibration_points())) + ") t(model_order, name, critical)",
    "colour": """SELECT (vec_id // 5) % 4 AS match_id, vec_id // 5 AS track_id, vec_id AS seq,
        100.0::DOUBLE + 300.0::DOUBLE * embedding[1]::DOUBLE AS L,
        128.0::DOUBLE + 200.0::DOUBLE * embedding[2]::DOUBLE AS a,
        128.0::DOUBLE + 200.0::DOUBLE * embedding[3]::DOUBLE AS b,
        90.0::DOUBLE + 300.0::DOUBLE * embedding[4]::DOUBLE AS H,
        128.0::DOUBLE + 500.0::DOUBLE * embedding[5]::DOUBLE AS S,
        100.0::DOUBLE + 400.0::DOUBLE * embedding[6]::DOUBLE AS V, vec_id % 4 AS class_id,
        0.001::DOUBLE * (vec_id % 7) AS area_ratio FROM embeddings""",
    "feat": "SELECT label::BIGINT AS match_id, vec_id, embedding::DOUBLE[] AS vec, vec_id % 2 AS side FROM embeddings",
    "lines0": """SELECT match_id, minute // 240 AS frame, seq, k % 2 = 0 AS flat,
        12.0::DOUBLE * (105.0::DOUBLE * k / 99.0::DOUBLE) AS cx,
        10.0::DOUBLE * (value - 68.0::DOUBLE * floor(value / 68.0::DOUBLE)) AS cy,
        20.0::DOUBLE + 4.0::DOUBLE * (seq % 50) AS half, 0.5::DOUBLE * (seq % 9) - 2.0::DOUBLE AS tilt FROM base""",
    "lines": """SELECT match_id, frame, seq,
        cx - CASE WHEN flat THEN half ELSE tilt END AS x1, cy - CASE WHEN flat THEN tilt ELSE half END AS y1,
        cx + CASE WHEN flat THEN half ELSE tilt END AS x2, cy + CASE WHEN flat THEN tilt ELSE half END AS y2 FROM lines0""",
}


def with_ctes(sql: str) -> str:
    """Put the CTEs a statement names in front of it, in dependency order."""
    needed: list[str] = []

    def visit(text: str, seen: frozenset):
        for name in CTES:
            if name in seen or name in needed:
                continue
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) or re.search(rf",\s*{name}\b\s+\w*\b(?=\s|,|$)", text) and False:
                visit(CTES[name], seen | {name})
                if name not in needed:
                    needed.append(name)

    visit(sql, frozenset())
    body = sql.strip()
    if not needed:
        return body
    heads = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, flags=re.I)
    rest = f",\n{body[match.end():]}" if match else f"\n{body}"
    return f"WITH RECURSIVE {heads}{rest}"
