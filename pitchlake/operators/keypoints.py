"""Keypoints, homographies and projection.

A frame shows each named point at most once and there are 16 names, so the points of a frame are
held as one bounded array per row (`frame_points`). Nearest references, pair geometry and robust
fits then run inside that row: no pair of rows is ever produced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.columns import H_COLUMNS, flip_x, inside_pitch, project
from ..session import durable
from . import scan

FRAME = ["match_id", "frame"]
ORDER = ["frame"]


# ---- points ----------------------------------------------------------------------------------

def correspondences(keypoints: DataFrame, min_conf: float = 0.4) -> DataFrame:
    """Confident keypoints with their pitch coordinates (`px`, `py`). The pitch table has 16 rows."""
    points = pitch.field_points(keypoints.sparkSession).select("name", "px", "py", "unambiguous")
    return keypoints.filter(F.col("conf") >= min_conf).join(F.broadcast(points), "name")


def frame_points(pairs: DataFrame) -> DataFrame:
    """One row per frame with its points as an array (at most one entry per name, sorted by name)."""
    one = pairs.groupBy(*FRAME, "name").agg(
        F.max_by(F.struct("x", "y", "px", "py", "unambiguous"), "conf").alias("v"))
    return one.groupBy(*FRAME).agg(
        F.sort_array(F.collect_list(F.struct("name", "v.x", "v.y", "v.px", "v.py", "v.unambiguous"))).alias("points"))


def match_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Detector names -> model names: numbers first, then the normalised name itself, then the first
    model name (in model order) that contains or is contained in it or shares half its tokens.
    The model list is a constant array, so this is a projection."""
    model = F.array(*[F.lit(n) for n in pitch.calibration_points()])
    norm = F.regexp_replace(F.lower(F.col(column)), "[ -]", "_")
    tokens = F.array_distinct(F.split(norm, "_"))
    need = F.greatest(F.lit(1), F.floor(F.size(tokens) / 2))

    def similar(m: Column) -> Column:
        return (F.contains(m, norm) | F.contains(norm, m)
                | (F.size(F.array_intersect(tokens, F.split(m, "_"))) >= need))

    fuzzy = F.get(F.filter(model, similar), F.lit(0))
    exact = F.when(F.array_contains(model, norm), norm)
    return names.withColumn("model_name", F.coalesce(
        pitch.value_lookup(pitch.NUMBERED_POINTS, F.col(column)), exact, fuzzy))


def critical_only(matched: DataFrame, minimum: int = 4) -> DataFrame:
    """Critical points alone where a frame shows at least `minimum` of them, else all its points.
    Expects `model_name`, one row per frame and name."""
    flag = F.col("model_name").isin(*pitch.CRITICAL_POINTS)
    found = F.sum(flag.cast("long")).over(Window.partitionBy(*FRAME))  # a frame has some 16 points
    return matched.withColumn("__n", found).filter(flag | (F.col("__n") < minimum)).drop("__n")


def last_valid_points(frames: DataFrame, points: DataFrame, block_frames: int = 8192) -> DataFrame:
    """Frames without a detection reuse the match's latest points. Adds `points`, `points_frame`."""
    rows = frames.join(points.withColumn("__f", F.col("frame")), FRAME, "left")
    held = F.when(F.col("points").isNotNull(), F.struct("__f", "points"))
    out = scan.prefix_scan(rows, ["match_id"], ORDER, scan.block_of("frame", block_frames),
                           {"__held": scan.last_seen(held)})
    return out.select(*frames.columns, F.col("__held.points").alias("points"),
                      F.col("__held.__f").alias("points_frame"))


def keypoint_mean(keypoints: DataFrame, frames: int = 300, size: int = 8192) -> DataFrame:
    """Mean position of each name over the last `frames` frames."""
    rows, w = scan.halo_range(keypoints, ["match_id", "name"], "frame", frames, size)
    near = w.rangeBetween(-frames, 0)
    rows = rows.withColumns({"mean_x": F.avg("x").over(near), "mean_y": F.avg("y").over(near)})
    return scan.drop_halo(rows)


def keypoint_memory(keypoints: DataFrame, names: list[str], max_age: int = 299,
                    block_frames: int = 8192) -> DataFrame:
    """State after every update: each name last seen at most `max_age` updates ago, with its age.

    The grid is updates x names, and the names are fixed, so it grows with the updates only.
    """
    per_frame = keypoints.groupBy(*FRAME).agg(F.collect_set(F.struct("name", "x", "y")).alias("seen"))
    block = scan.block_of("frame", block_frames)
    numbered = durable(scan.with_position(per_frame, ["match_id"], ORDER, block, "update"))
    grid = numbered.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    hit = F.get(
        F.filter("seen", lambda s: s["name"] == F.col("name")), F.lit(0))
    value = F.when(hit.isNotNull(), F.struct(F.col("update").alias("u"), hit["x"].alias("x"), hit["y"].alias("y")))
    rows = grid.withColumn("__v", value).drop("seen")
    kept = scan.prefix_scan(rows, ["match_id", "name"], ORDER, block, {"__last": scan.last_seen("__v")})
    age = F.col("update") - F.col("__last.u")
    return kept.withColumn("age", age).filter(F.col("age") <= max_age).select(
        *FRAME, "name", F.col("__last.x").alias("x"), F.col("__last.y").alias("y"), "age")


def orientation_votes(points: DataFrame) -> DataFrame:
    """Is the view mirrored? Votes compare pixel order of points whose order on the pitch is known."""
    def px(name: str) -> Column:
        return F.get(F.filter("points", lambda p: p["name"] == name), F.lit(0))["x"]

    order = [(f"smallarea_{v}_inner", f"bigarea_{v}_inner") for v in ("top", "bottom")]
    order += [(near, f"midline_{v}_intersection") for v in ("top", "bottom")
              for near in (f"bigarea_{v}_inner", f"{v}_arc_area_intersection")]
    votes = F.array_compact(F.array(*[px(left) > px(right) for left, right in order]))
    return points.withColumn("__votes", votes).withColumns({
        "votes": F.size("__votes"),
        "flip_votes": F.size(F.filter("__votes", lambda x: x)),
    }).withColumn("flip", F.col("flip_votes") > F.col("votes") / 2).drop("__votes")


# ---- nearest references and triangulation ----------------------------------------------------

def nearest_references(players: DataFrame, points: DataFrame, k: int = 4,
                       x: str = "x", y: str = "y", keep: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest keypoints of the player's frame as an ordered array `refs` with weights.
    `keep` names further per-frame columns of `points` to carry along."""
    joined = players.join(points.select(*FRAME, "points", *keep), FRAME)
    px, py = F.col(x), F.col(y)

    def ref(p):
        dx, dy = px - p["x"], py - p["y"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("dist"), p["name"].alias("name"),
                        p["x"].alias("x"), p["y"].alias("y"), p["px"].alias("px"), p["py"].alias("py"))

    refs = F.slice(F.array_sort(F.transform("points", ref)), 1, k)
    weight = lambda r: 1.0 / F.pow(F.greatest(F.lit(1.0), r["dist"]), 2)
    return (joined.withColumn("refs", refs).withColumn("weights", F.transform("refs", weight)).drop("points"))


def local_scale(refs: DataFrame, default: float = 10.0, min_gap: float = 2.0) -> DataFrame:
    """Median pixels per metre over neighbouring references more than `min_gap` metres apart."""
    ratios = F.expr(
        "filter(flatten(transform(refs, (a, i) -> transform(slice(refs, i + 2, 2), b -> "
        "CASE WHEN sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py)) > " + repr(min_gap) + " THEN "
        "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / "
        "sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py)) END))), r -> r IS NOT NULL)")
    out = refs.withColumn("__r", F.sort_array(ratios)).withColumn("__n", F.size("__r"))
    middle = F.expr("(get(__r, int((__n - 1) div 2)) + get(__r, int(__n div 2))) / 2")
    return out.withColumn("scale", F.when(F.col("__n") > 0, middle).otherwise(default)).drop("__r", "__n")


def triangulate(scaled: DataFrame, x: str = "x", y: str = "y", min_refs: int = 2,
                flip: Column | None = None) -> DataFrame:
    """Nearest reference plus the pixel offset in metres (image y points down), kept on the pitch."""
    first = F.get("refs", F.lit(0))
    base_x = first["px"] if flip is None else F.when(flip, flip_x(first["px"])).otherwise(first["px"])
    ok = (F.size("refs") >= min_refs) & (F.col("scale") > 0)
    gx = base_x + (F.col(x) - first["x"]) / F.col("scale")
    gy = first["py"] - (F.col(y) - first["y"]) / F.col("scale")
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(top), v))
    return scaled.withColumns({"field_x": F.when(ok, clip(gx, pitch.LENGTH)),
                               "field_y": F.when(ok, clip(gy, pitch.WIDTH))})


# ---- homography quality ----------------------------------------------------------------------

def pair_geometry(points: DataFrame, min_points: int = 3) -> DataFrame:
    """Mean relative error of pitch distances under the frame's homography (`h00..h22` columns);
    infinity below three points. At most 120 pairs, inside the row."""
    h = {n: F.col(n) for n in H_COLUMNS}
    proj = F.transform("points", lambda p: F.struct(
        ((h["h00"] * p["x"] + h["h01"] * p["y"] + h["h02"]) / (h["h20"] * p["x"] + h["h21"] * p["y"] + h["h22"])).alias("u"),
        ((h["h10"] * p["x"] + h["h11"] * p["y"] + h["h12"]) / (h["h20"] * p["x"] + h["h21"] * p["y"] + h["h22"])).alias("v"),
        p["px"].alias("px"), p["py"].alias("py")))
    out = points.withColumn("__p", proj)
    errors = F.expr(
        "filter(flatten(transform(__p, (a, i) -> transform(slice(__p, i + 2, 16), b -> "
        "CASE WHEN (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) > 0 THEN "
        "abs(sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v)) / "
        "sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py)) - 1) END))), e -> e IS NOT NULL)")
    out = out.withColumn("__e", errors)
    mean = F.expr("aggregate(__e, 0D, (s, e) -> s + e) / size(__e)")
    return out.withColumn("geom_error", F.when((F.size("points") >= min_points) & (F.size("__e") > 0), mean)
                          .otherwise(F.lit(float("inf")))).drop("__p", "__e")


def reprojection_error(points: DataFrame, reject: float = 20.0, inlier: float = 5.0) -> DataFrame:
    """Mean distance of the projected inliers to their pitch points, per frame; `ok` unless above
    `reject` or without inliers. Long input: x, y, px, py and homography columns."""
    u, v = project("x", "y")
    d = F.sqrt((u - F.col("px")) * (u - F.col("px")) + (v - F.col("py")) * (v - F.col("py")))
    near = points.withColumn("__d", d)
    inside = F.when(F.col("__d") <= inlier, F.col("__d"))
    return near.groupBy(*FRAME).agg(
        F.count(inside).alias("inliers"), F.count(F.lit(1)).alias("points"), F.avg(inside).alias("error")
    ).withColumn("ok", F.coalesce(F.col("error") <= reject, F.lit(False)))


def homography_rate(frames: DataFrame) -> DataFrame:
    """Frames, successes, flips and success rate. Input: match_id, ok, flip per frame."""
    out = frames.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("ok").cast("long")).alias("successes"),
        F.sum(F.col("flip").cast("long")).alias("flips"))
    return out.withColumn("success_rate", F.col("successes") / F.col("frames"))


# ---- homographies over time ------------------------------------------------------------------

def weighted_homography(estimates: DataFrame, window: int = 5, min_conf: float = 0.6,
                        block_frames: int = 8192, halo_size: int = 65536) -> DataFrame:
    """Confidence-weighted mean of the last accepted estimates, scaled to h22 = 1; a lone estimate
    is used as it is, and frames without a new one carry the last."""
    good = estimates.filter(F.col("conf") >= min_conf)
    block = scan.block_of("frame", block_frames)
    pos = scan.with_position(good, ["match_id"], ORDER, block)
    rows, w = scan.halo_rows(pos, ["match_id"], "__pos", window - 1, halo_size)
    near = w.rowsBetween(1 - window, 0)
    weight = F.sum("conf").over(near)
    sums = {n: F.sum(F.col("conf") * F.col(n)).over(near) / weight for n in H_COLUMNS}
    rows = scan.drop_halo(rows.withColumns({f"m_{n}": s for n, s in sums.items()}))
    smooth = [F.when(F.col("__pos") == 1, F.col(n)).otherwise(F.col(f"m_{n}") / F.col("m_h22")).alias(n)
              for n in H_COLUMNS]
    return carry_homography(estimates.select(*FRAME), rows.select(*FRAME, *smooth), block_frames)


def mean_homography(accepted: DataFrame, window: int = 5, block_frames: int = 8192,
                    halo_size: int = 65536) -> DataFrame:
    """Plain mean of the last accepted homographies."""
    pos = scan.with_position(accepted, ["match_id"], ORDER, scan.block_of("frame", block_frames))
    rows, w = scan.halo_rows(pos, ["match_id"], "__pos", window - 1, halo_size)
    near = w.rowsBetween(1 - window, 0)
    rows = rows.withColumns({f"m_{n}": F.avg(n).over(near) for n in H_COLUMNS})
    return scan.drop_halo(rows).select(*FRAME, *[F.col(f"m_{n}").alias(n) for n in H_COLUMNS])


def carry_homography(frames: DataFrame, homographies: DataFrame, block_frames: int = 8192) -> DataFrame:
    """Every frame with the latest homography at or before it."""
    rows = frames.join(homographies.withColumn("__f", F.col("frame")), FRAME, "left")
    held = F.when(F.col("__f").isNotNull(), F.struct("__f", *H_COLUMNS))
    rows = durable(rows.select(*frames.columns, held.alias("__h")))  # read twice by the scan
    out = scan.prefix_scan(rows, ["match_id"], ORDER,
                           scan.block_of("frame", block_frames), {"__held": scan.last_seen("__h")})
    return out.select(*frames.columns, *[F.col(f"__held.{n}").alias(n) for n in H_COLUMNS],
                      F.col("__held.__f").alias("h_frame"))


def best_of_batch(estimates: DataFrame, size: int = 90) -> DataFrame:
    """As of each frame: the estimate of its batch with most keypoints so far, the first on ties.
    A batch is `size` frames, so its window is bounded."""
    rows = estimates.withColumn("batch_idx", scan.block_of("frame", size))
    w = Window.partitionBy("match_id", "batch_idx").orderBy("frame").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    best = F.max_by(F.struct(F.col("frame").alias("f"), *H_COLUMNS),
                    F.when(F.col("h00").isNotNull(), F.struct("num_keypoints", -F.col("frame")))).over(w)
    rows = rows.withColumn("__b", best)
    return rows.select(*FRAME, "batch_idx", F.col("__b.f").alias("best_frame"),
                       *[F.col(f"__b.{n}").alias(n) for n in H_COLUMNS])


def consistent_motion(flags: DataFrame, window: int = 5, share: float = 0.7, keys=("match_id",),
                      order=("frame", "seq"), block_frames: int = 8192, halo_size: int = 65536) -> DataFrame:
    """At least `share` of the last `window` motion flags are true; false before `window` rows."""
    keys = list(keys)
    pos = scan.with_position(flags, keys, list(order), scan.block_of(order[0], block_frames))
    rows, w = scan.halo_rows(pos, keys, "__pos", window - 1, halo_size)
    near = w.rowsBetween(1 - window, 0)
    moving = F.sum(F.col("moving").cast("long")).over(near)
    full = F.col("__pos") >= window
    return scan.drop_halo(rows.withColumn("consistent", full & (moving >= window * share))).drop("__pos")


# ---- projection ------------------------------------------------------------------------------

def project_rows(rows: DataFrame, homographies: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Field coordinates under the frame's homography, null without one."""
    joined = rows.join(homographies.select(*FRAME, *H_COLUMNS), FRAME, "left")
    u, v = project(x, y)
    return joined.withColumns({"field_x": u, "field_y": v}).drop(*H_COLUMNS)


def with_fallback(projected: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Projection inside the pitch counts fully, else the fallback position (`fb_x`, `fb_y`) at 0.8."""
    rows = projected.join(fallback, keys, "left")
    ok = F.coalesce(inside_pitch("field_x", "field_y"), F.lit(False))
    spare = F.col("fb_x").isNotNull()
    return rows.withColumns({
        "conf_out": F.when(ok, 1.0).when(spare, 0.8).otherwise(0.0),
        "out_x": F.when(ok, F.col("field_x")).otherwise(F.col("fb_x")),
        "out_y": F.when(ok, F.col("field_y")).otherwise(F.col("fb_y"))})


def by_priority(rows: DataFrame, sources: list[tuple[DataFrame, float | Column]], keys: list[str]) -> DataFrame:
    """First source with a position on the pitch wins: `out_x, out_y, out_conf`. Each source brings
    `keys, field_x, field_y`; its confidence is a number or a column of it."""
    out, picks = rows, []
    for i, (source, conf) in enumerate(sources):
        level = conf if isinstance(conf, Column) else F.lit(float(conf))
        inside = F.coalesce(inside_pitch("field_x", "field_y"), F.lit(False))
        # a flag, not a filter: a filter would be pushed down and repeat the projection's arithmetic
        hit = source.select(*keys, F.when(inside, F.struct(
            F.col("field_x").alias("x"), F.col("field_y").alias("y"), level.alias("c"))).alias(f"__s{i}"))
        out = out.join(hit, keys, "left")
        picks.append(F.col(f"__s{i}"))
    best = F.coalesce(*picks)
    return out.withColumns({"out_x": best["x"], "out_y": best["y"], "out_conf": best["c"]}).drop(
        *[f"__s{i}" for i in range(len(sources))])


# ---- robust homography fit -------------------------------------------------------------------

def _solve(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact homographies (h22 = 1) of a stack of four-point sets; singular sets are flagged."""
    x, y = src[..., 0], src[..., 1]
    u, v = dst[..., 0], dst[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1),
                        np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], -2)
    b = np.concatenate([u, v], -1)
    size = np.abs(a).max(axis=2, keepdims=True)
    fine = np.abs(np.linalg.det(a / np.where(size > 0, size, 1.0))) > 1e-13
    h = np.full((len(a), 9), np.nan)
    if fine.any():
        h[fine, :8] = np.linalg.solve(a[fine], b[fine][..., None])[..., 0]
        h[fine, 8] = 1.0
    return h.reshape(-1, 3, 3), fine


def _refit(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares homography over all given points, with both sides centred and scaled."""
    def frame_of(p):
        mid = p.mean(axis=0)
        size = np.sqrt(((p - mid) ** 2).sum(axis=1)).mean() or 1.0
        return np.array([[1 / size, 0, -mid[0] / size], [0, 1 / size, -mid[1] / size], [0, 0, 1]])

    ts, td = frame_of(src), frame_of(dst)
    s = (np.c_[src, np.ones(len(src))] @ ts.T)
    d = (np.c_[dst, np.ones(len(dst))] @ td.T)
    z = np.zeros_like(s)
    rows = np.vstack([np.hstack([s, z, -d[:, :1] * s]), np.hstack([z, s, -d[:, 1:2] * s])])
    h = np.linalg.inv(td) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ts
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ np.swapaxes(h, -1, -2)
    with np.errstate(all="ignore"):
        q = p[..., :2] / p[..., 2:3]
        return np.nan_to_num(np.linalg.norm(q - dst, axis=-1), nan=np.inf)


def robust_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 5.0, min_points: int = 4,
                      min_share: float = 0.5):
    """Best of all four-point subsets (at most C(16, 4) = 1820), refitted on its inliers. A fit of
    all points that leaves every one an inlier cannot be beaten, so it is tried first.

    Returns (H, inlier mask, mean inlier error), or None.
    """
    n = len(src)
    if n < max(4, min_points):
        return None
    full = _refit(src, dst)
    if full is not None:
        errors = _errors(full, src, dst)
        if (errors <= threshold).all():
            return full, np.ones(n, dtype=bool), float(errors.mean())
    subsets = np.array(list(combinations(range(n), 4)))
    models, fine = _solve(src[subsets], dst[subsets])
    if not fine.any():
        return None
    models = models[fine]
    errors = _errors(models, src, dst)
    inliers = errors <= threshold
    counts = inliers.sum(axis=1)
    spread = np.where(inliers, errors, 0.0).sum(axis=1)
    best = np.lexsort((spread, -counts))[0]
    mask = inliers[best]
    if counts[best] < min_points or counts[best] / n < min_share:
        return None
    h = _refit(src[mask], dst[mask])
    if h is None or _errors(h, src[mask], dst[mask]).mean() > errors[best][mask].mean() + 1e-9:
        h = models[best]
    return h, mask, float(_errors(h, src[mask], dst[mask]).mean())


_FIT_SCHEMA = ("match_id long, frame long, flip boolean, num_points int, inliers int, conf double, error double, "
               "used array<string>, " + ", ".join(f"{n} double" for n in H_COLUMNS))
_FIT_ARROW = pa.schema([("match_id", pa.int64()), ("frame", pa.int64()), ("flip", pa.bool_()), ("num_points", pa.int32()),
                        ("inliers", pa.int32()), ("conf", pa.float64()), ("error", pa.float64()), ("used", pa.list_(pa.string())),
                        *[(n, pa.float64()) for n in H_COLUMNS]])
#: Frames whose points are Python objects at a time; a batch of Arrow has some thousands, which would take a gigabyte in a few tasks.
FIT_FRAMES = 256


def _fit_frame(match_id, frame, flip, pts, threshold, min_points, min_share) -> tuple:
    src = np.array([[p["x"], p["y"]] for p in pts])
    dst = np.array([[pitch.LENGTH - p["px"] if flip else p["px"], p["py"]] for p in pts])
    central = np.array([bool(p["unambiguous"]) for p in pts])
    names = [p["name"] for p in pts]
    got = robust_homography(src, dst, threshold, min_points, min_share)
    total = len(pts)
    if got is None and central.sum() >= min_points:
        got = robust_homography(src[central], dst[central], threshold, min_points, min_share)
        names = [n for n, keep in zip(names, central) if keep]
        total = int(central.sum())
    if got is None:
        return (match_id, frame, flip, len(pts), 0, 0.0, None, None, *[None] * 9)
    h, mask, error = got
    used = [n for n, keep in zip(names, mask) if keep]
    return (match_id, frame, flip, len(pts), int(mask.sum()), float(mask.sum()) / total, error, used, *h.ravel().tolist())


def fit_batches(batches, threshold: float, min_points: int, min_share: float):
    """Arrow batches of (match_id, frame, flip, points) -> fits; of a batch, FIT_FRAMES frames at a time are Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, FIT_FRAMES):
            part = batch.slice(start, FIT_FRAMES).to_pydict()
            out = [_fit_frame(*row, threshold, min_points, min_share) for row in zip(part["match_id"], part["frame"], part["flip"], part["points"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(zip(*out), _FIT_ARROW.types)], schema=_FIT_ARROW)


def fit_homographies(points: DataFrame, threshold: float = 5.0, min_points: int = 4,
                     min_share: float = 0.5, resolve_flip: bool = True) -> DataFrame:
    """Image -> pitch homography per frame; null matrix where none is good enough.

    Orientation comes from pixel order; a frame that fails is retried on halfway-line points alone.
    """
    ready = orientation_votes(points) if resolve_flip else points.withColumn("flip", F.lit(False))
    ready = scan.spread_tasks(ready.select(*FRAME, "flip", "points"), FRAME)
    return ready.mapInArrow(lambda batches: fit_batches(batches, threshold, min_points, min_share), _FIT_SCHEMA)


def calibration_info(fits: DataFrame) -> DataFrame:
    """Per frame: whether a calibration exists, which points it used, inliers and error."""
    return fits.select(*FRAME, F.col("h00").isNotNull().alias("valid"),
                       F.coalesce(F.size("used"), F.lit(0)).alias("num_keypoints"),
                       F.col("used").alias("keypoint_names"), "inliers", "error")


# ---- field lines -----------------------------------------------------------------------------

_DEN = "((a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2))"
_ALONG_H = f"((a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2)) / {_DEN}"
_ALONG_V = f"-((a.x1 - a.x2) * (a.y1 - b.y1) - (a.y1 - a.y2) * (a.x1 - b.x1)) / {_DEN}"
_BOXES_MEET = " AND ".join(f"least({p}.{k}1, {p}.{k}2) <= greatest({q}.{k}1, {q}.{k}2)" for k in "xy" for p, q in ("ab", "ba"))


def line_crossings(segments: DataFrame) -> DataFrame:
    """Where horizontal and vertical segments of a frame cross.

    The segments of a frame, those of one image, are two arrays in one row; they are crossed inside
    the row, pairs whose bounding boxes are apart left out first.
    """
    part = F.struct("seq", "x1", "y1", "x2", "y2")
    one = lambda kind: F.collect_list(F.when(F.col("orientation") == kind, part))
    images = segments.filter(F.col("orientation").isin("horizontal", "vertical")).groupBy(*FRAME).agg(
        one("horizontal").alias("h"), one("vertical").alias("v")).filter("size(h) > 0 AND size(v) > 0")
    met = F.expr(f"""flatten(transform(h, a -> transform(filter(v, b -> {_BOXES_MEET} AND abs({_DEN}) >= 1e-10), b -> named_struct(
        'h_seq', a.seq, 'v_seq', b.seq, 't', {_ALONG_H}, 'u', {_ALONG_V}, 'a', a))))""")
    rows = images.select(*FRAME, F.explode(met).alias("c")).filter("c.t BETWEEN 0 AND 1 AND c.u BETWEEN 0 AND 1")
    return rows.select(*FRAME, "c.h_seq", "c.v_seq", F.expr("c.a.x1 - c.t * (c.a.x1 - c.a.x2)").alias("x"),
                       F.expr("c.a.y1 - c.t * (c.a.y1 - c.a.y2)").alias("y"))


def merge_collinear(segments: DataFrame, gap: float = 10.0, key: str = "orientation") -> DataFrame:
    """Join neighbouring segments of one orientation in a frame, in order of their midpoints along
    the main axis, while midpoints are closer than twice the gap. A joined segment runs between the two
    end points that lie furthest apart along its main axis (x if it is flat, else y): both are end
    points of segments that went into it. The fold runs inside one row per (frame, orientation),
    which holds the line segments of a single image."""
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    rows = segments.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2,
                                 "angle": angle})
    groups = rows.groupBy(*FRAME, key).agg(
        F.collect_list(F.struct("mx", "my", "seq", "x1", "y1", "x2", "y2")).alias("s"), F.avg("angle").alias("a"))
    along_y = F.abs("a") < np.pi / 4
    ordered = F.sort_array(F.transform("s", lambda p: F.struct(
        F.when(along_y, p["my"]).otherwise(p["mx"]).alias("k"), p["seq"].alias("seq"),
        p["x1"].alias("x1"), p["y1"].alias("y1"), p["x2"].alias("x2"), p["y2"].alias("y2"))))
    groups = groups.withColumn("s", ordered)
    ends = "array(" + ", ".join(f"named_struct('along', if(abs(a) < {np.pi / 4}D, {p}.x{i}, {p}.y{i}), 'x', {p}.x{i}, 'y', {p}.y{i})"
                                for p in ("acc.cur", "n") for i in (1, 2)) + ")"
    fold = F.expr(f"""aggregate(slice(s, 2, size(s)),
        named_struct('done', cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>),
                     'cur', named_struct('x1', s[0].x1, 'y1', s[0].y1, 'x2', s[0].x2, 'y2', s[0].y2)),
        (acc, n) -> CASE WHEN
            pow((acc.cur.x1 + acc.cur.x2 - n.x1 - n.x2) / 2, 2) + pow((acc.cur.y1 + acc.cur.y2 - n.y1 - n.y2) / 2, 2) < pow({2 * gap}D, 2)
          THEN named_struct('done', acc.done, 'cur', named_struct('x1', array_min({ends}).x, 'y1', array_min({ends}).y,
                                                                  'x2', array_max({ends}).x, 'y2', array_max({ends}).y))
          ELSE named_struct('done', array_append(acc.done, acc.cur),
                            'cur', named_struct('x1', n.x1, 'y1', n.y1, 'x2', n.x2, 'y2', n.y2)) END,
        acc -> array_append(acc.done, acc.cur))""")
    return (groups.select(*FRAME, key, F.posexplode(fold).alias("part", "m"))
            .select(*FRAME, key, "part", "m.x1", "m.y1", "m.x2", "m.y2"))
