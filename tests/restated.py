"""Plain-Python restatements the Spark jobs are compared with."""

import math


def possession(rows, n):
    """rows: (frame, team, player) -> frames per team, passes, timeline."""
    cur = player = pending = None
    run, last, start = 0, 0, None
    frames, passes, segments = {}, [], []
    for frame, team, who in rows:
        if cur is not None:
            frames[cur] = frames.get(cur, 0) + frame - last
        last = frame
        if cur is None:
            if team is not None:
                cur, player, start = team, who, frame
                frames[cur] = frames.get(cur, 0) + 1
            continue
        if team is None:
            pending, run = None, 0
        elif team == cur:
            pending, run = None, 0
            if who is not None:
                if player is not None and who != player:
                    passes.append((frame, cur, player, who))
                player = who
        else:
            run = run + 1 if pending == team else 1
            pending = team
            if run >= n:
                segments.append((start, frame, cur))
                cur, player, start, pending, run = team, None, frame, None, 0
    if cur is not None:
        segments.append((start, last, cur))
    return frames, passes, segments


def kalman(values, confs, q=0.01, r=1.0):
    pos, vel, p, out = values[0], 0.0, 1.0, []
    for z, conf in zip(values, confs):
        for noise in (r, r / (conf + 0.1) if conf < 1 else r):
            guess, err = pos + vel, p + q
            k = err / (err + noise)
            pos, vel, p = guess + k * (z - guess), vel + k * (z - guess), (1 - k) * err
        out.append(pos)
    return out


def accepted(points, fps, vmax, amax):
    kept, flags = [], []
    for x, y, f in points:
        ok = True
        if kept:
            dt = (f - kept[-1][2]) / fps
            if dt > 0:
                v = math.dist((x, y), kept[-1][:2]) / dt
                ok = v <= vmax
                if ok and len(kept) > 1:
                    dt0 = (kept[-1][2] - kept[-2][2]) / fps
                    if dt0 > 0:
                        ok = abs(v - math.dist(kept[-1][:2], kept[-2][:2]) / dt0) / dt <= amax
        if ok:
            kept.append((x, y, f))
        flags.append(ok)
    return flags


def limited(times, gap):
    last, out = None, []
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out


def cosine_of(a, b):
    return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) + 1e-6)


def box_overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + 1e-6)


def greedy_ids(detections, max_age, max_lost, fps, recover=0.5, accept=0.4, history=20):
    """detections: (frame, seq, box, vector), by frame and seq -> {(frame, seq): id}. Everyone gets an id."""
    book, ids, fresh = {}, {}, 1  # id -> [box, last seen, vectors, lost]
    for frame in sorted({d[0] for d in detections}):
        now, here = frame / fps, [d for d in detections if d[0] == frame]
        book = {i: t for i, t in book.items() if not (t[3] and now - t[1] > max_lost)}
        lost = sorted(i for i, t in book.items() if t[3])
        active = sorted(i for i, t in book.items() if not t[3])
        chosen = {}
        for d in here:
            likes = [(max(cosine_of(d[3], v) for v in book[i][2]), i) for i in lost]
            top = max((s for s, _ in likes), default=0.0)
            first = min((i for s, i in likes if s == top), default=None)
            if top > recover and first not in chosen.values():
                chosen[d[1]] = first
        for d in here:
            if d[1] in chosen:
                continue
            best = None
            for i in active:
                if i not in chosen.values():
                    s = 0.8 * max(cosine_of(d[3], v) for v in book[i][2]) + 0.2 * box_overlap(d[2], book[i][0])
                    if s > accept and (best is None or s > best[0]):
                        best = (s, i)
            if best:
                chosen[d[1]] = best[1]
        for d in here:
            if d[1] not in chosen:
                chosen[d[1]], fresh = fresh, fresh + 1
            past = book[chosen[d[1]]][2] if chosen[d[1]] in book else []
            book[chosen[d[1]]] = [d[2], now, [*past, d[3]][-history:], False]
            ids[frame, d[1]] = chosen[d[1]]
        for t in book.values():
            t[3] = t[3] or now - t[1] > max_age
    return ids


def held_teams(rows, hold=12, factor=0.85):
    """rows: (frame, vote, d0, d1) -> team after each row."""
    team = since = None
    out = []
    for frame, vote, *d in rows:
        if vote >= 0 and vote != team and (team is None or frame - since >= hold or d[vote] < factor * d[team]):
            team, since = vote, frame
        out.append(team)
    return out


def drifted(samples, start, alpha, limit):
    pair, out = [list(p) for p in start], []
    for s in samples:
        d = [math.dist(s, p) for p in pair]
        pick = -1 if min(d) > limit else d.index(min(d))
        if pick >= 0:
            pair[pick] = [(1 - alpha) * p + alpha * x for p, x in zip(pair[pick], s)]
        out.append(pick)
    return out
