"""Lines that keep given vertices, against plain recursion."""

import math
import random

import numpy as np

from fleetlens.functions import lines
from fleetlens.operators import sequence as S

T0 = 1_700_000_000_000


def plain(points, anchors, eps):
    def off(p, a, b):
        x, y = b[1] - a[1], b[0] - a[0]
        n = math.sqrt(x * x + y * y)
        return math.sqrt((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) if n < 1e-12 else abs((p[1] - a[1]) * y - (p[0] - a[0]) * x) / n

    def between(lo, hi):
        far = max(range(lo + 1, hi), key=lambda i: (off(points[i], points[lo], points[hi]), -i), default=None)
        if far is None or off(points[far], points[lo], points[hi]) <= eps:
            return []
        return [*between(lo, far), far, *between(far, hi)]

    cuts = sorted({0, len(points) - 1, *anchors})
    out = [cuts[0]]
    for a, b in zip(cuts, cuts[1:]):
        out += [*between(a, b), b]
    return out


def test_rounds_equal_recursion():
    rng = random.Random(6)
    for n in (1, 2, 3, 10, 60, 400):
        for _ in range(20):
            step = rng.choice([0.00001, 0.0005])
            la, lo = np.cumsum([rng.choice([0, 1, -1]) * step for _ in range(n)]), np.cumsum([rng.choice([0, 0, 1]) * step for _ in range(n)])
            anchors = [rng.randrange(n) for _ in range(rng.choice([0, 3]))]
            assert lines.thinned(la, lo, np.array(anchors, int), 0.00002).tolist() == plain(list(zip(la, lo)), anchors, 0.00002)


def test_a_corner_stays_a_straight_goes():
    la, lo = np.r_[np.zeros(50), np.arange(50) * 1e-4], np.r_[np.arange(50) * 1e-4, np.full(50, 49e-4)]
    assert lines.thinned(la, lo, np.array([], int)).tolist() == [0, 49, 99]
    assert lines.thinned(la, lo, np.array([20])).tolist() == [0, 20, 49, 99]


def test_every_stop_keeps_a_vertex(spark):
    path = [dict(lat=41.3, lon=-72.9 + 1e-4 * i) for i in range(40)]
    stops = [dict(lat=41.3001, lon=-72.9 + 1e-4 * i) for i in (7, 8, 30)]
    d = spark.createDataFrame([(1, path, stops), (2, path, None), (3, None, stops), (4, path[:1], stops), (5, [], [])],
                              "id int, path array<struct<lat:double,lon:double>>, ring array<struct<lat:double,lon:double>>")
    got = {r.id: None if r.path is None else [round((v.lon + 72.9) * 1e4) for v in r.path] for r in lines.simplified(d).collect()}
    assert got == {1: [0, 7, 8, 30, 39], 2: [0, 39], 3: None, 4: [0], 5: []}


def lap(spark, per_side, start=0):
    """Round a square of four stops, about 560 m a side, with fixes along it."""
    corners = [(41.30, -72.93), (41.305, -72.93), (41.305, -72.923), (41.30, -72.923), (41.30, -72.93)]
    rows, t = [], start
    for (a, b), (c, e) in zip(corners, corners[1:]):
        for k in range(per_side):
            f = k / per_side
            # A detour of some twenty metres on each side.
            bend = 0.0002 * math.sin(math.pi * f) if 4 <= k < 9 and k % 2 == 0 else 0.0
            rows.append((1, 7, T0 + t * 1000, t, a + (c - a) * f + bend, b + (e - b) * f + bend))
            t += 5
    rows.append((1, 7, T0 + t * 1000, t, *corners[0]))
    pos = spark.createDataFrame(rows, "route_id long, bus_id long, collected_at long, ingest_seq long, lat double, lon double")
    ring = spark.createDataFrame([(1, i, i + 1, la, lo) for i, (la, lo) in enumerate(corners[:4])], "route_id long, stop_index long, stop_id long, lat double, lon double")
    return pos, ring, rows


def test_a_lap_becomes_a_thinned_line(spark):
    pos, ring, rows = lap(spark, 20)
    r = S.derive_paths(pos, ring).collect()
    assert len(r) == 1 and r[0].p90_m <= 60 and 2000 < r[0].length_m < 4000

    def metres(p, q):
        return 111_320 * math.hypot(p[0] - q[0], (p[1] - q[1]) * math.cos(math.radians((p[0] + q[0]) / 2)))

    points, stops = [(x[4], x[5]) for x in rows], [(s.lat, s.lon) for s in ring.collect()]
    covers = lambda i, j: all(any(metres(p, s) <= 60 for p in points[i : j + 1]) for s in stops)
    length, a, b = min((j - i, i, j) for i in range(len(points)) for j in range(i, len(points)) if covers(i, j))
    end = next(i for i in range(b + 1, len(points)) if metres(points[i], points[a]) <= 90)
    stretch = points[a : end + 1]
    near = [min(range(len(stretch)), key=lambda i: (metres(stretch[i], s), i)) for s in stops]
    kept = [(v.lat, v.lon) for v in r[0].path]
    assert kept == [stretch[i] for i in plain(stretch, near, lines.EPS_DEG)] and 8 <= len(kept) < len(stretch)


def test_few_fixes_or_few_vertices_are_no_lap(spark):
    pos, ring, _ = lap(spark, 14)
    assert S.derive_paths(pos, ring).count() == 0
    assert S.derive_paths(pos, ring, min_samples=50).count() == 1
    assert S.derive_paths(pos, ring, min_samples=50, min_vertices=60).count() == 0
