"""Stand windows around the clock against plain selection, and the gate's errors against loops."""

import random

import numpy as np
import pandas as pd

from fleetlens.operators import models as M


def test_windows_around_the_clock():
    rng = random.Random(4)
    for half in (0, 3, 60, 400):
        rows = [(1 + c, 5, rng.randrange(5), rng.choice([rng.randrange(1440), 1439, 0, 720]), float(rng.randrange(40)), rng.randint(1, 3)) for c in range(2) for _ in range(150)]
        pdf = pd.DataFrame(rows, columns=["route_id", "stop_id", "fold", "tod", "stand", "w"]).groupby(["route_id", "stop_id", "fold", "tod", "stand"], as_index=False).w.sum()
        got = M._around_the_clock(half)(pdf, np.flatnonzero(np.r_[True, np.diff(pdf.route_id) != 0]))
        want = {}
        for (r, f, t), _ in pdf.groupby(["route_id", "fold", "tod"]):
            d = pdf[(pdf.route_id == r) & (pdf.fold != f)]
            near = (d.tod - t).abs()
            d = d[np.minimum(near, 1440 - near) <= half]
            if len(d):
                want[r, f, t] = (int(d.w.sum()), np.quantile(np.repeat(d.stand, d.w), M.TEN_KNOTS))
        assert len(got) == len(want)
        for x in got.itertuples():
            n, q = want[x.route_id, x.test, x.centre]
            assert x._5 == n and np.allclose(x.hq, q)
