"""Grouped logistic fits against one Newton loop per group in numpy."""

import numpy as np

from fleetlens.operators import models as M


def plain_fit(x, y, l2=2.0):
    p = y.mean()
    if not 0 < p < 1:
        return None
    b = np.zeros(x.shape[1])
    b[0] = np.log(p / (1 - p))
    pen = np.r_[0.0, np.full(len(b) - 1, 2 * l2)]
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(pen), x.T @ (q - y) + pen * b)
        b = b - step
        if np.abs(step).max() < 1e-11:
            break
    return b


def test_all_groups_at_once_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(5):
        x = np.c_[np.ones(300), rng.normal(size=(300, 2)).round(1)]
        y = (rng.random(300) < 1 / (1 + np.exp(-x @ rng.normal(size=3)))).astype(float) if g else np.zeros(300)
        rows += [(g, *map(float, a), float(b)) for a, b in zip(x, y)]
        want[g] = plain_fit(x, y)
    got = M.fit_logistics(spark.createDataFrame(rows, "stop_id long, x0 double, x1 double, x2 double, y double"), "stop_id")
    assert sorted(got) == [1, 2, 3, 4] and want[0] is None and all(np.allclose(got[g], want[g], atol=1e-6) for g in got)
    assert M.fit_logistics(spark.createDataFrame([], "stop_id long, x0 double, x1 double, y double"), "stop_id") == {}


def test_thin_stops_have_no_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(s, "stopped", 1_700_000_000_000 + int(k) * 3_600_000, 1_700_000_000_000 + int(k) * 3_600_000 + int(1000 * rng.exponential(200)), None, None, float(rng.uniform(1000, 5000)))
            for s, n in ((1, 120), (2, 30)) for k in range(n)]
    v = spark.createDataFrame(rows, "stop_id long, outcome string, pinned_at long, departed_at long, first_moved_at long, confirm_sec double, lap double")
    got = M.release_fits(v, 2_000_000_000_000).collect()
    assert [(r.stop_id, r.n, len(r.coefficients)) for r in got] == [(1, 120, 9)]
