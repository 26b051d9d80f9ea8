"""Exact Euclidean distance to the nearest set pixel, one dimension at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over j of (i - j)**2 + f[j] for every i, by the lower envelope of parabolas."""
    n = len(f)
    sites = np.flatnonzero(np.isfinite(f))
    if not len(sites):
        return np.full(n, np.inf)
    hull, starts = [sites[0]], [-np.inf]
    for q in sites[1:]:
        while True:
            p = hull[-1]
            s = ((f[q] + q * q) - (f[p] + p * p)) / (2 * (q - p))
            if s > starts[-1]:
                break
            hull.pop()
            starts.pop()
        hull.append(q)
        starts.append(s)
    k = np.searchsorted(starts, np.arange(n), side="right") - 1
    j = np.array(hull)[k]
    return (np.arange(n) - j) ** 2 + f[j]


def distance_transform(pixels: DataFrame) -> DataFrame:
    """(r, c, d) of a table (r, c, set): columns are transformed each on its own, then rows, so no task holds
    more than one line of the raster. Infinite where nothing is set."""

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        r = pdf["r"].to_numpy()
        f = np.full(r[-1] - r[0] + 1, np.inf)
        f[(r - r[0])[pdf["set"].to_numpy(bool)]] = 0
        return pd.DataFrame({"r": r, "c": pdf["c"].to_numpy(), "g": _envelope(f)[r - r[0]]})

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        c = pdf["c"].to_numpy()
        f = np.full(c[-1] - c[0] + 1, np.inf)
        f[c - c[0]] = pdf["g"].to_numpy()
        return pd.DataFrame({"r": pdf["r"].to_numpy(), "c": c, "d": np.sqrt(_envelope(f)[c - c[0]])})

    return pixels.groupBy("c").applyInPandas(column, "r bigint, c bigint, g double").groupBy("r").applyInPandas(row, "r bigint, c bigint, d double")
