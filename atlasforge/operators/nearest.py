"""Nearest segments to the places of a tile, by NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19


def _runs(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items repeated by their counts, and the number within each, some `CHUNK` at once (an item is never cut)."""
    upto, lo = np.cumsum(many), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
        some = many[lo:hi]
        rep = np.repeat(np.arange(lo, hi), some)
        yield rep, np.arange(len(rep)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi


def _near(x: np.ndarray, y: np.ndarray, s: np.ndarray, radius: float, size: float, slack: float, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, segment), with every one within the radius. Places lie in a square of `size`; those of a
    column of cells are in order, and a segment meets those beside its part over that column, grown by the radius."""
    wide, r = int(size // cell) + 1, radius + slack
    put = np.minimum(x // cell, wide - 1).astype(np.int64) * wide + np.minimum(y // cell, wide - 1).astype(np.int64)
    order = np.argsort(put, kind="stable")
    upto = np.concatenate(([0], np.cumsum(np.bincount(put, minlength=wide * wide))))
    ax, ay, bx, by = s
    steep = np.divide(by - ay, bx - ax, out=np.zeros(len(ax)), where=bx > ax)
    tall = np.where(bx > ax, 0.0, by - ay)
    c0 = np.maximum((ax - r) // cell, 0).astype(np.int64)
    c1 = np.minimum((bx + r) // cell, wide - 1).astype(np.int64)
    for of, step in _runs(np.maximum(c1 - c0 + 1, 0)):
        c, left, low, m = c0[of] + step, ax[of], ay[of], steep[of]
        u = low + (np.maximum(c * cell - r, left) - left) * m
        v = low + (np.minimum((c + 1) * cell + r, bx[of]) - left) * m + tall[of]
        lo, hi = (np.minimum(u, v) - r) // cell, (np.maximum(u, v) + r) // cell
        first = upto[c * wide + np.clip(lo, 0, wide).astype(np.int64)]
        many = np.maximum(upto[c * wide + np.clip(hi + 1, 0, wide).astype(np.int64)] - first, 0)
        some = np.flatnonzero(many)
        first, of = first[some], of[some]
        for k, at in _runs(many[some]):
            yield order[first[k] + at], of[k]


def nearest(places: list[np.ndarray], ends: list[np.ndarray], radius: float, size: float) -> np.ndarray:
    """For each place (x, y) of the square from 0 to `size` the number of a nearest segment (ax, ay, bx, by), if one
    lies within the radius; else that of any segment or -1. Places on a segment's end are settled first, then those
    within a small radius, which falls with the number of places, within four times that and so on: each time they
    meet every segment within that. Cuts of segments by columns are then about as many as pairs."""
    (x, y), (ax, ay, bx, by) = places, ends
    best, least = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
    if not len(x) or not len(ax):
        return best
    slack = 1e-9 * (1 + max(float(np.abs(v).max()) for v in (*places, *ends)))
    flip = bx < ax
    line = np.stack([np.where(flip, b, a) for a, b in ((ax, bx), (ay, by), (bx, ax), (by, ay))])
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    share = np.divide(1.0, long, out=np.zeros(len(ax)), where=long > 0)

    def measure(place: np.ndarray, seg: np.ndarray) -> None:
        gx, gy, ux, uy = x[place] - ax[seg], y[place] - ay[seg], dx[seg], dy[seg]
        t = np.clip((gx * ux + gy * uy) * share[seg], 0.0, 1.0)
        gx -= t * ux
        gy -= t * uy
        d = gx * gx + gy * gy
        np.minimum.at(least, place, d)
        won = d == least[place]
        best[place[won]] = seg[won]

    for a, b in ((ax, ay), (bx, by)):
        for place, seg in _near(x, y, np.stack((a, b, a, b)), 0.0, size, slack, size / 128):
            same = (x[place] == a[seg]) & (y[place] == b[seg])
            least[place[same]], best[place[same]] = 0.0, seg[same]
    left = np.flatnonzero(least > 0)
    part = min(radius, size / np.sqrt(8 * max(1, len(left))))
    while len(left):
        for place, seg in _near(x[left], y[left], line, part, size, slack, 2 * part):
            measure(left[place], seg)
        left = left[least[left] > part * part * (1 - 1e-6)] if part < radius else left[:0]
        part = min(radius, 4 * part)
    return best
