"""Polygon kernels in NumPy: hulls, rotated rectangles, simplification, clipping, regular shapes.

They take rings as arrays of shape (n, 2) without a closing point, and are meant for Arrow batches where
no column expression can do the work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise, without points on edges."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def solidity(ring: np.ndarray) -> float:
    """Area over the hull's area."""
    hull = convex_hull(ring)
    whole = abs(signed_area(hull)) if len(hull) > 2 else 0.0
    return abs(signed_area(ring)) / whole if whole else 0.0


def min_rect(ring: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """The smallest rotated rectangle: corners, long and short side, direction of the long side modulo 180."""
    hull = convex_hull(ring)
    if len(hull) < 3:
        d = hull[-1] - hull[0]
        return np.vstack((hull, hull[::-1]))[:4], float(np.hypot(*d)), 0.0, math.degrees(math.atan2(d[1], d[0])) % 180
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        q = hull @ turn.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        w, h = hi - lo
        if best is None or w * h < best[0] - 1e-12:
            box = np.array([lo, (hi[0], lo[1]), hi, (lo[0], hi[1])]) @ turn
            best = (w * h, box, max(w, h), min(w, h), math.degrees(t if w >= h else t + math.pi / 2) % 180)
    return best[1:]


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's line without points nearer than the tolerance to what stays."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, size = line[b] - line[a], np.hypot(*(line[b] - line[a]))
        rel = line[a + 1 : b] - line[a]
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a ring within a convex counter-clockwise ring."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            return out
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        made = []
        for k in range(len(out)):
            p, q, s, t = out[k - 1], out[k], side[k - 1], side[k]
            if s * t < 0:
                made.append(p + (q - p) * (s / (s - t)))
            if t >= 0:
                made.append(q)
        out = np.array(made).reshape(-1, 2)
    return out


def contains(ring: np.ndarray, x: float, y: float) -> bool:
    """By crossings; points on the lower and left edges count as inside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    cuts = (a[:, 1] <= y) != (b[:, 1] <= y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((cuts & (at > x)).sum() % 2)


def interior_point(ring: np.ndarray) -> tuple[float, float]:
    """The middle of the widest part inside the ring at half its height."""
    ys = np.unique(ring[:, 1])
    y = float((ys[:-1] + ys[1:])[np.abs((ys[:-1] + ys[1:]) / 2 - (ys[0] + ys[-1]) / 2).argmin()] / 2) if len(ys) > 1 else float(ys[0])
    a, b = ring, np.roll(ring, -1, axis=0)
    cuts = (a[:, 1] <= y) != (b[:, 1] <= y)
    x = np.sort(a[cuts, 0] + (y - a[cuts, 1]) * (b[cuts, 0] - a[cuts, 0]) / (b[cuts, 1] - a[cuts, 1]))
    if len(x) < 2:
        return float(ring[:, 0].mean()), y
    k = int((x[1::2] - x[::2]).argmax())
    return float((x[2 * k] + x[2 * k + 1]) / 2), y


def normalized(ring: np.ndarray) -> np.ndarray:
    """Counter-clockwise from the smallest point, so equal rings are equal arrays."""
    r = ring if signed_area(ring) >= 0 else ring[::-1]
    k = np.lexsort((r[:, 1], r[:, 0]))[0]
    return np.roll(r, -k, axis=0)


def faults(ring: np.ndarray) -> str | None:
    """Why a ring is not valid: too few points, no area, or edges that cross."""
    if len(ring) < 3:
        return "too few points"
    if signed_area(ring) == 0:
        return "no area"
    n, b = len(ring), np.roll(ring, -1, axis=0)
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if (j + 1) % n == i:
                continue
            if side(ring[i], b[i], ring[j]) * side(ring[i], b[i], b[j]) < 0 and side(ring[j], b[j], ring[i]) * side(ring[j], b[j], b[i]) < 0:
                return "edges cross"
    return None


def regularized(ring: np.ndarray, fit: float = 0.70, small: float = 150.0) -> tuple[np.ndarray, str]:
    """A rectangle scaled to the ring's area where it fills its rotated rectangle well or is small, the ring
    itself elsewhere; with the method's name."""
    corners, long, short, _ = min_rect(ring)
    a, box = abs(signed_area(ring)), long * short
    if box and (a / box >= fit or a <= small):
        scale = min(1.0, max(0.75, math.sqrt(a / box)))
        mid = corners.mean(axis=0)
        return mid + (corners - mid) * scale, "rect"
    return ring, "ortho"


def measures(rings: DataFrame, points: str = "pts", key: str = "id") -> DataFrame:
    """(key, solidity, long, short, angle, n_simple, fault, px, py) of rings of structs (x, y), by batches."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, pts in zip(pdf[key], pdf[points], strict=True):
                ring = np.array([(p["x"], p["y"]) for p in pts], float)
                _, long, short, angle = min_rect(ring)
                px, py = interior_point(ring) if len(ring) > 2 else (float(ring[0, 0]), float(ring[0, 1]))
                out.append((k, solidity(ring), long, short, angle, len(simplify(ring, 2.0)), faults(ring), px, py))
            yield pd.DataFrame(out, columns=[key, "solidity", "long", "short", "angle", "n_simple", "fault", "px", "py"])

    return rings.select(key, points).mapInPandas(run, f"{key} bigint, solidity double, long double, short double, angle double, n_simple bigint, fault string, px double, py double")
