"""Pitch model: sizes, named points, lines, zones and name tables.

All coordinates are metres with the origin in a corner unless `origin="centre"` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard pitch sizes in metres.
LENGTH, WIDTH = 105.0, 68.0
BIG_BOX_DEPTH, BIG_BOX_WIDTH = 16.5, 40.3
SMALL_BOX_DEPTH, SMALL_BOX_WIDTH = 5.5, 18.3
PENALTY_SPOT, CIRCLE_RADIUS = 11.0, 9.15

# Margins and exclusion radius of the heatmap filters, metres.
GOAL_LINE_MARGIN, SIDELINE_MARGIN, POINT_RADIUS = 2.0, 0.4, 1.2

_MID_X, _MID_Y = LENGTH / 2, WIDTH / 2
_BIG_LOW, _BIG_HIGH = (WIDTH - BIG_BOX_WIDTH) / 2, (WIDTH + BIG_BOX_WIDTH) / 2
_SMALL_LOW, _SMALL_HIGH = (WIDTH - SMALL_BOX_WIDTH) / 2, (WIDTH + SMALL_BOX_WIDTH) / 2

# The 16 point classes of the keypoint detector. Points off the halfway line are
# given for the goal at x = 0; `flip` mirrors them.
DETECTED_POINTS: dict[str, tuple[float, float]] = {
    "midline_top_intersection": (_MID_X, WIDTH),
    "midline_bottom_intersection": (_MID_X, 0.0),
    "halfcircle_top": (_MID_X, _MID_Y + CIRCLE_RADIUS),
    "halfcircle_bottom": (_MID_X, _MID_Y - CIRCLE_RADIUS),
    "center": (_MID_X, _MID_Y),
    "bigarea_top_inner": (BIG_BOX_DEPTH, _BIG_HIGH),
    "bigarea_bottom_inner": (BIG_BOX_DEPTH, _BIG_LOW),
    "bigarea_top_outter": (0.0, _BIG_HIGH),
    "bigarea_bottom_outter": (0.0, _BIG_LOW),
    "smallarea_top_inner": (SMALL_BOX_DEPTH, _SMALL_HIGH),
    "smallarea_bottom_inner": (SMALL_BOX_DEPTH, _SMALL_LOW),
    "smallarea_top_outter": (0.0, _SMALL_HIGH),
    "smallarea_bottom_outter": (0.0, _SMALL_LOW),
    "top_arc_area_intersection": (PENALTY_SPOT, _MID_Y + CIRCLE_RADIUS),
    "bottom_arc_area_intersection": (PENALTY_SPOT, _MID_Y - CIRCLE_RADIUS),
    "corner": (0.0, 0.0),
}
# On the halfway line the mirror image is the point itself.
HALFWAY_POINTS = tuple(n for n, (x, _) in DETECTED_POINTS.items() if x == _MID_X)

# How far each detected class is trusted; classes not listed get the default.
POINT_PRIORITY = {
    "midline_top_intersection": 100, "midline_bottom_intersection": 100,
    "halfcircle_top": 95, "halfcircle_bottom": 95,
    "top_arc_area_intersection": 90, "bottom_arc_area_intersection": 90,
    "bigarea_top_inner": 80, "bigarea_bottom_inner": 80,
    "bigarea_top_outter": 75, "bigarea_bottom_outter": 75,
    "smallarea_top_inner": 70, "smallarea_bottom_inner": 70,
    "smallarea_top_outter": 65, "smallarea_bottom_outter": 65,
    "corner": 40,
}
DEFAULT_PRIORITY = 50


# The same for detectors whose classes name the side of the pitch.
SIDE_POINT_PRIORITY = {
    "midline_top_intersection": 100, "midline_bottom_intersection": 100,
    "halfcircle_top": 95, "halfcircle_bottom": 95,
    "left_penalty_arc_intersection_top": 90, "left_penalty_arc_intersection_bottom": 90,
    "left_bigbox_top_inner": 80, "left_bigbox_bottom_inner": 80,
    "left_bigbox_top_outer": 75, "left_bigbox_bottom_outer": 75,
    "left_smallbox_top_inner": 70, "left_smallbox_bottom_inner": 70,
    "left_smallbox_top_outer": 65, "left_smallbox_bottom_outer": 65,
    "corner_left_top": 40, "corner_left_bottom": 40,
    "right_penalty_arc_intersection_top": 90, "right_penalty_arc_intersection_bottom": 90,
    "right_bigbox_top_inner": 80, "right_bigbox_bottom_inner": 80,
    "right_bigbox_top_outer": 75, "right_bigbox_bottom_outer": 75,
    "right_smallbox_top_inner": 70, "right_smallbox_bottom_inner": 70,
    "right_smallbox_top_outer": 65, "right_smallbox_bottom_outer": 65,
    "corner_right_top": 40, "corner_right_bottom": 40,
}


def calibration_points() -> dict[str, tuple[float, float]]:
    """The larger point set used to match detector names, in its fixed search order."""
    far_x = LENGTH
    arc_low, arc_high = _MID_Y - CIRCLE_RADIUS, _MID_Y + CIRCLE_RADIUS
    big_r, small_r, spot_r = far_x - BIG_BOX_DEPTH, far_x - SMALL_BOX_DEPTH, far_x - PENALTY_SPOT
    # Names and order.
    return {
        "corner_bottom_left": (0.0, 0.0), "corner_bottom_right": (far_x, 0.0),
        "corner_top_left": (0.0, WIDTH), "corner_top_right": (far_x, WIDTH),
        "corner_1": (0.0, 0.0), "corner_2": (far_x, 0.0),
        "corner_3": (far_x, WIDTH), "corner_4": (0.0, WIDTH),
        "big_area_left_bottom": (BIG_BOX_DEPTH, _BIG_LOW), "big_area_left_top": (BIG_BOX_DEPTH, _BIG_HIGH),
        "big_area_right_bottom": (big_r, _BIG_LOW), "big_area_right_top": (big_r, _BIG_HIGH),
        "big_area_left_corner_bottom": (0.0, _BIG_LOW), "big_area_left_corner_top": (0.0, _BIG_HIGH),
        "big_area_right_corner_bottom": (far_x, _BIG_LOW), "big_area_right_corner_top": (far_x, _BIG_HIGH),
        "small_area_left_bottom": (SMALL_BOX_DEPTH, _SMALL_LOW), "small_area_left_top": (SMALL_BOX_DEPTH, _SMALL_HIGH),
        "small_area_right_bottom": (small_r, _SMALL_LOW), "small_area_right_top": (small_r, _SMALL_HIGH),
        "left_penalty_arc_top": (PENALTY_SPOT, arc_high), "left_penalty_arc_bottom": (PENALTY_SPOT, arc_low),
        "right_penalty_arc_top": (spot_r, arc_high), "right_penalty_arc_bottom": (spot_r, arc_low),
        "top_arc_area_intersection": (_MID_X, arc_high), "bottom_arc_area_intersection": (_MID_X, arc_low),
        "bigarea_top_inner": (_MID_X, _BIG_HIGH), "bigarea_bottom_inner": (_MID_X, _BIG_LOW),
        "bigarea_top_outter": (0.0, _BIG_HIGH), "bigarea_bottom_outter": (0.0, _BIG_LOW),
        "smallarea_top_inner": (_MID_X, _SMALL_HIGH), "smallarea_bottom_inner": (_MID_X, _SMALL_LOW),
        "smallarea_top_outter": (0.0, _SMALL_HIGH), "smallarea_bottom_outter": (0.0, _SMALL_LOW),
        "penalty_left": (PENALTY_SPOT, _MID_Y), "penalty_right": (spot_r, _MID_Y),
        "center": (_MID_X, _MID_Y), "center_circle_center": (_MID_X, _MID_Y),
        "circle_top": (_MID_X, arc_high), "circle_bottom": (_MID_X, arc_low),
        "circle_left": (_MID_X - CIRCLE_RADIUS, _MID_Y), "circle_right": (_MID_X + CIRCLE_RADIUS, _MID_Y),
        "halfcircle_top": (_MID_X, arc_high), "halfcircle_bottom": (_MID_X, arc_low),
        "midfield_top": (_MID_X, WIDTH), "midfield_bottom": (_MID_X, 0.0),
        "midline_top_intersection": (_MID_X, WIDTH), "midline_bottom_intersection": (_MID_X, 0.0),
    }


# Class numbers some detectors emit instead of names.
NUMBERED_POINTS = dict(zip(map(str, range(1, 26)), (
    "corner_1", "corner_2", "corner_3", "corner_4",
    "big_area_left_bottom", "big_area_left_top", "big_area_right_bottom", "big_area_right_top",
    "small_area_left_bottom", "small_area_left_top", "small_area_right_bottom", "small_area_right_top",
    "penalty_left", "penalty_right", "center",
    "circle_top", "circle_bottom", "circle_left", "circle_right", "midfield_top", "midfield_bottom",
    "big_area_left_corner_bottom", "big_area_left_corner_top",
    "big_area_right_corner_bottom", "big_area_right_corner_top")))

# Points that fix a homography best.
CRITICAL_POINTS = (
    "corner_bottom_left", "corner_bottom_right", "corner_top_left", "corner_top_right",
    "corner_1", "corner_2", "corner_3", "corner_4",
    "big_area_left_bottom", "big_area_left_top", "big_area_right_bottom", "big_area_right_top",
    "penalty_left", "penalty_right", "center", "circle_top", "circle_bottom",
    "small_area_left_bottom", "small_area_left_top", "small_area_right_bottom", "small_area_right_top")

# Detector classes and zone names.
CLASS_NAMES = ("player", "ball", "referee", "goalkeeper")
ZONE_NAMES = {
    "thirds": ("defensive", "middle", "offensive"),
    "thirds_lanes": ("def_left", "def_center", "def_right", "mid_left", "mid_center", "mid_right",
                     "off_left", "off_center", "off_right"),
}
DISPLAY_ZONES = tuple(f"{third} {lane}" for third in ("Defensive", "Midfield", "Offensive")
                      for lane in ("Left", "Center", "Right"))


def zone_count(partition: str, nx: int = 6, ny: int = 4) -> int:
    return nx * ny if partition == "grid" else len(ZONE_NAMES[partition])


def exclusion_points() -> list[tuple[float, float]]:
    """Detected points and their mirror images, without repeats."""
    both = [(x, y) for x, y in DETECTED_POINTS.values()]
    both += [(LENGTH - x, y) for x, y in DETECTED_POINTS.values()]
    return sorted(set(both))


def field_points(spark: SparkSession) -> DataFrame:
    """16 rows: name, px, py (metres), unambiguous, priority."""
    rows = [(n, x, y, n in HALFWAY_POINTS, POINT_PRIORITY.get(n, DEFAULT_PRIORITY))
            for n, (x, y) in DETECTED_POINTS.items()]
    return spark.createDataFrame(rows, "name string, px double, py double, unambiguous boolean, priority int")


def model_points(spark: SparkSession) -> DataFrame:
    """Calibration points in search order."""
    rows = [(i, n, x, y, n in CRITICAL_POINTS)
            for i, (n, (x, y)) in enumerate(calibration_points().items())]
    return spark.createDataFrame(rows, "model_order int, name string, px double, py double, critical boolean")


def outline() -> list[tuple[str, str, int, float, float]]:
    """Box corners, spots and the ends of the 11 field lines (kind, name, part, x, y), origin in the centre."""
    half_l, half_w = LENGTH / 2, WIDTH / 2
    rows: list[tuple] = []

    def point(name, x, y):
        rows.append(("point", name, 0, float(x), float(y)))

    def line(name, start, end):
        rows.extend(("line", name, i, float(x), float(y)) for i, (x, y) in enumerate((start, end)))

    corner = {"t": half_w, "b": -half_w}
    for v, y in corner.items():
        for h, x in (("l", -half_l), ("r", half_l)):
            point(f"corner_{v}{h}", x, y)
    point("center", 0, 0)
    for side, goal_x, inward in (("left", -half_l, 1), ("right", half_l, -1)):
        point(f"penalty_{side}", goal_x + inward * PENALTY_SPOT, 0)
        for box, depth, width in (("penalty_area", BIG_BOX_DEPTH, BIG_BOX_WIDTH),
                                  ("goal_area", SMALL_BOX_DEPTH, SMALL_BOX_WIDTH)):
            for v, y in (("t", width / 2), ("b", -width / 2)):
                point(f"{box}_{side}_{v}l", goal_x, y)
                point(f"{box}_{side}_{v}r", goal_x + inward * depth, y)
        front, reach = goal_x + inward * BIG_BOX_DEPTH, BIG_BOX_WIDTH / 2
        line(f"penalty_area_{side}_top", (goal_x, reach), (front, reach))
        line(f"penalty_area_{side}_bottom", (goal_x, -reach), (front, -reach))
        line(f"penalty_area_{side}_front", (front, -reach), (front, reach))
        line(f"goal_line_{side}", (goal_x, -half_w), (goal_x, half_w))
    line("sideline_top", (-half_l, half_w), (half_l, half_w))
    line("sideline_bottom", (-half_l, -half_w), (half_l, -half_w))
    line("halfway_line", (0, -half_w), (0, half_w))
    return rows


def pitch_lines() -> dict[str, tuple[float, float, float, float]]:
    """Field lines as (x0, y0, x1, y1), origin in a corner, ends in ascending order. All are parallel to a side."""
    ends: dict[str, list[tuple[float, float]]] = {}
    for kind, name, _, x, y in outline():
        if kind == "line":
            ends.setdefault(name, []).append((x + LENGTH / 2, y + WIDTH / 2))
    return {name: (*min(pair), *max(pair)) for name, pair in ends.items()}


def pitch_outline(spark: SparkSession, origin: str = "centre", scaled: bool = False) -> DataFrame:
    """The outline as `kind, name, part, x, y`."""
    half_l, half_w = LENGTH / 2, WIDTH / 2
    df = spark.createDataFrame(outline(), "kind string, name string, part int, x double, y double")
    if origin == "corner" or scaled:
        df = df.withColumns({"x": F.col("x") + half_l, "y": F.col("y") + half_w})
    if scaled:
        df = df.withColumns({"x": F.col("x") / LENGTH, "y": F.col("y") / WIDTH})
    return df


def zones(spark: SparkSession, partition: str = "thirds_lanes", nx: int = 6, ny: int = 4) -> DataFrame:
    """zone_id, zone_name and, for the grid, its rectangle (corner origin)."""
    rows = []
    for z in range(zone_count(partition, nx, ny)):
        if partition == "grid":
            ix, iy = z % nx, z // nx
            rows.append((z, f"zone_{z}", ix * LENGTH / nx, iy * WIDTH / ny,
                         (ix + 1) * LENGTH / nx, (iy + 1) * WIDTH / ny))
        else:
            rows.append((z, ZONE_NAMES[partition][z], None, None, None, None))
    return spark.createDataFrame(
        rows, "zone_id int, zone_name string, x_min double, y_min double, x_max double, y_max double")


def name_lookup(names, index: Column, default: str | None = None) -> Column:
    """Constant list indexed by a column; outside the list the default."""
    table = F.array(*[F.lit(n) for n in names])
    hit = F.when((index >= 0) & (index < len(names)), F.element_at(table, index.cast("int") + 1))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def value_lookup(table: dict, key: Column, default=None) -> Column:
    """Constant dictionary as one map expression."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    hit = F.element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))
