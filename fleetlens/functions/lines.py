"""Simplification of lines that keeps given vertices.

Distances are perpendicular to a chord in plain degrees; a chord without length measures from its point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: About two metres at this latitude.
EPS_DEG = 0.00002


def thinned(lat: np.ndarray, lon: np.ndarray, anchors: np.ndarray, eps: float = EPS_DEG) -> np.ndarray:
    """Vertices that stay: the ends, the ``anchors``, and in each piece between them the vertex farthest from its
    chord as long as that is more than ``eps``, over and over.

    All chords of a round are measured at once, so there are as many rounds as the recursion is deep."""
    n = len(lat)
    if n < 3:
        return np.arange(n)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    keep[anchors] = True
    cuts = np.flatnonzero(keep)
    low, high = cuts[:-1], cuts[1:]
    while len(low):
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            break
        inner = high - low - 1
        first = np.cumsum(inner) - inner
        chord = np.repeat(np.arange(len(low)), inner)
        i = np.arange(inner.sum()) - first[chord] + low[chord] + 1
        a, b = low[chord], high[chord]
        east, north = lon[b] - lon[a], lat[b] - lat[a]
        length = np.sqrt(east * east + north * north)
        pe, pn = lon[i] - lon[a], lat[i] - lat[a]
        off = np.where(length < 1e-12, np.sqrt(pe * pe + pn * pn), np.abs(pe * north - pn * east) / np.maximum(length, 1e-12))
        most = np.maximum.reduceat(off, first)
        # Of equally far vertices the first.
        at = np.minimum.reduceat(np.where(off == most[chord], i, n), first)
        split = most > eps
        keep[at[split]] = True
        low, high = np.concatenate([low[split], at[split]]), np.concatenate([at[split], high[split]])
    return np.flatnonzero(keep)


def nearest_vertices(lat: np.ndarray, lon: np.ndarray, stop_lat: np.ndarray, stop_lon: np.ndarray) -> np.ndarray:
    """The first nearest vertex of each stop."""
    if not len(lat) or not len(stop_lat):
        return np.zeros(0, dtype=int)
    m = np.hypot(lat[:, None] - stop_lat[None, :], (lon[:, None] - stop_lon[None, :]) * np.cos(np.radians((lat[:, None] + stop_lat[None, :]) / 2)))
    return m.argmin(axis=0)


def simplified(lines: DataFrame, path: str = "path", stops: str = "ring", eps: float = EPS_DEG) -> DataFrame:
    """``lines`` with ``path`` (array of lat, lon) thinned; the vertices nearest the row's ``stops`` stay, so that
    every stop keeps one of its own. A null path stays null, a null list of stops keeps only the ends for sure."""
    schema = lines.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, s in zip(pdf[path], pdf[stops], strict=True):
                if p is None:
                    out.append(None)
                    continue
                lat, lon = (np.array([v[c] for v in p], float) for c in ("lat", "lon"))
                sla, slo = (np.array([v[c] for v in (s if s is not None else [])], float) for c in ("lat", "lon"))
                out.append([p[i] for i in thinned(lat, lon, nearest_vertices(lat, lon, sla, slo), eps)])
            yield pdf.assign(**{path: out})

    return lines.mapInPandas(run, schema)
