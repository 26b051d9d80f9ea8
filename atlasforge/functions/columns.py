"""Column expressions for boxes, angles and the scalar rules; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def area(p: str = "") -> Column:
    """Of the box x0, y0, x1, y1 with a prefix."""
    return (col(p, "x1") - col(p, "x0")) * (col(p, "y1") - col(p, "y0"))


def inter(a: str, b: str) -> Column:
    """Area that two boxes share, 0 if they do not overlap."""
    w = F.least(col(a, "x1"), col(b, "x1")) - F.greatest(col(a, "x0"), col(b, "x0"))
    h = F.least(col(a, "y1"), col(b, "y1")) - F.greatest(col(a, "y0"), col(b, "y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def rounded(c: Column, n: int = 6) -> Column:
    """Half-even, as the reports are rounded."""
    return F.bround(c.cast("double"), n)


def angle_gap(a: Column, b: Column, period: float = 180) -> Column:
    """Distance of two directions on a circle of `period` degrees."""
    half = period / 2
    return F.abs(F.pmod(a - b + half, F.lit(period)) - half)


def snap(own: Column, grid: Column, within: float) -> Column:
    """The grid's direction (modulo 90) where own lies within so many degrees of it, else own."""
    gap = F.pmod(own - grid + 45, F.lit(90.0)) - 45
    return F.when(F.abs(gap) <= within, own - gap).otherwise(own)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def digitize(c: Column, lo, hi, k: int) -> Column:
    """Which of k equal bins, left-closed, the ends clamped."""
    return clamp(F.floor((c - lo) * k / (hi - lo)), 0, k - 1)


def ladder(*cases: tuple[Column, object], default=None) -> Column:
    """The first case that holds names the label."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, label in cases[1:]:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def rank_of(c: Column, order: list[str]) -> Column:
    """A label's place in an order, after all others if it has none."""
    return reduce(lambda e, kv: e.when(c == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))


def ring_area(points: str) -> Column:
    """Shoelace area of a closed or open ring of structs (x, y)."""
    return F.expr(f"abs(aggregate(sequence(0, size({points}) - 1), 0D, (a, i) -> a + {points}[i].x * {points}[(i + 1) % size({points})].y - {points}[(i + 1) % size({points})].x * {points}[i].y)) / 2")


def path_length(points: str) -> Column:
    """Length of a polyline of structs (x, y)."""
    return F.expr(f"CASE WHEN size({points}) < 2 THEN 0D ELSE aggregate(sequence(1, size({points}) - 1), 0D, (a, i) -> a + hypot({points}[i].x - {points}[i - 1].x, {points}[i].y - {points}[i - 1].y)) END")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / F.when(size == 0, 1).otherwise(size), 0.0, 1.0))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def luma(red: Column, green: Column, blue: Column, alpha: Column | None = None) -> Column:
    """Gray of three bands, cut to a whole number; white where alpha is 0."""
    gray = F.floor(0.299 * red + 0.587 * green + 0.114 * blue)
    return gray if alpha is None else F.when(alpha > 0, gray).otherwise(255)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence(fill: Column, solidity: Column) -> Column:
    """Half of each, to three places."""
    return rounded(0.5 * fill + 0.5 * solidity, 3)


def blank(c: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def ring_centroid(points: str) -> tuple[Column, Column]:
    """Area-weighted centre of a ring of structs (x, y); nulls where the area is 0."""
    at = f"{points}[(i + 1) % size({points})]"
    cross = f"({points}[i].x * {at}.y - {at}.x * {points}[i].y)"
    total = lambda term: F.expr(f"aggregate(sequence(0, size({points}) - 1), 0D, (a, i) -> a + {term})")
    whole = F.nullif(3 * total(cross), F.lit(0.0))
    return total(f"({points}[i].x + {at}.x) * {cross}") / whole, total(f"({points}[i].y + {at}.y) * {cross}") / whole


def along(points: str, share: float) -> Column:
    """The point (x, y) at a share of a polyline's length; its first point where it has none."""
    step = f"hypot({points}[i].x - {points}[i - 1].x, {points}[i].y - {points}[i - 1].y)"
    walk = f"""aggregate(sequence(1, greatest(size({points}) - 1, 1)), named_struct('left', {share}D * __length, 'x', CAST(NULL AS DOUBLE), 'y', CAST(NULL AS DOUBLE)),
      (a, i) -> CASE WHEN a.x IS NOT NULL OR size({points}) < 2 THEN a WHEN {step} > 0 AND a.left <= {step} THEN named_struct('left', 0D, 'x', {points}[i - 1].x + ({points}[i].x - {points}[i - 1].x) * a.left / {step}, 'y', {points}[i - 1].y + ({points}[i].y - {points}[i - 1].y) * a.left / {step}) ELSE named_struct('left', a.left - {step}, 'x', a.x, 'y', a.y) END)"""
    return F.expr(f"transform(array({walk}), s -> named_struct('x', coalesce(s.x, element_at({points}, IF(__length > 0, -1, 1)).x), 'y', coalesce(s.y, element_at({points}, IF(__length > 0, -1, 1)).y)))[0]")
