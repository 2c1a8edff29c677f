"""Robust fits hold a bounded number of frames as Python objects, however many a batch has."""

import tracemalloc

import pyarrow as pa

from pitchlake.functions import pitch
from pitchlake.operators import keypoints

NAMES = sorted(pitch.DETECTED_POINTS)


def batch(frames):
    points = [{"name": n, "x": 11.0 * x + 1.5 * y + 40.0, "y": 700.0 - 9.0 * y + 0.4 * x, "px": x, "py": y, "unambiguous": True}
              for n, (x, y) in sorted(pitch.DETECTED_POINTS.items())]
    kind = pa.list_(pa.struct([("name", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "px", "py")], ("unambiguous", pa.bool_())]))
    one = pa.array([points], kind)
    rows = pa.concat_arrays([one] * (frames - 1) + [pa.array([points[:3]], kind)])
    return pa.record_batch([pa.array([1] * frames), pa.array(range(frames)), pa.array([False] * frames), rows], ["match_id", "frame", "flip", "points"])


def test_fits_of_a_large_batch(monkeypatch):
    fitted = {}
    peaks = []
    for frames in (600, 6000):
        given = batch(frames)
        with monkeypatch.context() as m:
            m.setattr(keypoints, "robust_homography", lambda src, dst, *a: None)  # memory is about the points, not about the fits
            tracemalloc.start()
            assert sum(b.num_rows for b in keypoints.fit_batches([given], 5.0, 4, 0.5)) == frames
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
    for b in keypoints.fit_batches([batch(300)], 5.0, 4, 0.5):
        fitted |= {r["frame"]: r for r in b.to_pylist()}
    assert sorted(fitted) == list(range(300)) and fitted[299]["h00"] is None and fitted[299]["num_points"] == 3
    assert all(fitted[f]["inliers"] == len(NAMES) and fitted[f]["error"] < 1e-6 and fitted[f]["used"] == NAMES for f in range(299))
