"""Queries whose work is a kernel on tiles or rings, and composite operators over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from atlasforge.functions.columns import area, ladder, rounded
from atlasforge.operators import raster as R
from atlasforge.operators import shapes as S
from atlasforge.operators import tiles as T
from atlasforge.operators.greedy import suppress
from atlasforge.operators.spatial import best_match, overlapping
from atlasforge.plans.registry import query
from atlasforge.plans.spatial import pair_iou, pairs_of, rings

C = F.col
TILE = 64


@query("pair_iou", "pairs", "SELECT a_id, b_id, round_even(inter / CAST(a_area + b_area - inter AS DOUBLE), 6) AS iou FROM pairs")
def pair_iou_query(t):
    return pairs_of(t).select("a_id", "b_id", rounded(pair_iou()).alias("iou"))


@query("pilot_iou", "pairs", "SELECT a_id AS id, round_even(inter / CAST(a_area + b_area - inter AS DOUBLE), 6) AS iou, round_even(inter / CAST(b_area AS DOUBLE), 6) AS precision, round_even(inter / CAST(a_area AS DOUBLE), 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY b_id) AS k FROM pairs) WHERE k = 1")
def pilot_iou(t):
    """Each reference against its first prediction."""
    one = pairs_of(t).groupBy("a_id").agg(F.min_by(F.struct(C("inter").alias("i"), area("a_").alias("a"), area("b_").alias("b")), "b_id").alias("s")).select(C("a_id").alias("id"), "s.*")
    return one.select("id", rounded(C("i") / (C("a") + C("b") - C("i"))).alias("iou"), rounded(C("i") / C("b")).alias("precision"), rounded(C("i") / C("a")).alias("recall"))


@query("cell_width_ok", "raster", "SELECT r // 10 AS label, max(gray) >= 170 AS ok FROM raster GROUP BY 1")
def cell_width_ok(t):
    """Zones whose largest value reaches a bound."""
    return t.raster.groupBy(F.expr("r div 10").alias("label")).agg((F.max("gray") >= 170).alias("ok"))


@query("piece_under_click", "pairs", "SELECT b_id AS id, coalesce(arg_max(a_id, (inter, -a_id)) FILTER (WHERE inter * 2 >= b_area), arg_max(a_id, (a_area, -a_id))) AS piece FROM pairs GROUP BY 1")
def piece_under_click(t):
    """The parcel that holds most of a candidate, else the largest that it touches."""
    p = pairs_of(t)
    most = F.max(F.when(C("inter") * 2 >= area("b_"), F.struct("inter", (-C("a_id")).alias("k"))))
    big = F.max(F.struct(area("a_").alias("a"), (-C("a_id")).alias("k")))
    return p.groupBy(C("b_id").alias("id")).agg((-F.coalesce(most["k"], big["k"])).alias("piece"))


@query("road_offsets", "raster", """WITH s AS (SELECT r, c FROM raster), k AS (SELECT s.r, s.c, min(CASE WHEN i.c > s.c THEN i.c - s.c END) AS dr, min(CASE WHEN i.c < s.c THEN s.c - i.c END) AS dl FROM s JOIN raster i ON i.r = s.r AND i.gray < 80 AND abs(i.c - s.c) <= 44 AND i.c <> s.c GROUP BY 1, 2)
SELECT r, c, (dr - dl) / 2.0::DOUBLE AS off, dl + dr AS width FROM k WHERE dr IS NOT NULL AND dl IS NOT NULL""")
def road_offsets(t):
    """Distance from samples to the first ink on either side, within 44 pixels."""
    s = t.raster.select("r", "c")
    scan = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(44)))).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("ic", C("c") + C("k") * C("side"))
    ink = t.raster.where("gray < 80").select("r", C("c").alias("ic"))
    first = scan.join(ink, ["r", "ic"]).groupBy("r", "c").agg(F.min(F.when(C("side") > 0, C("k"))).alias("dr"), F.min(F.when(C("side") < 0, C("k"))).alias("dl"))
    return first.where("dr IS NOT NULL AND dl IS NOT NULL").select("r", "c", ((C("dr") - C("dl")) / 2).alias("off"), (C("dl") + C("dr")).alias("width"))


@query("ink_alignment", "parcels raster", """WITH s AS (SELECT id, p.x0 // 4 + k AS r, p.y0 % 64 AS c FROM parcels p, range(0, 8) k(k)), d AS (SELECT s.id, s.r, s.c, min(abs(i.c - s.c)) AS d FROM s JOIN raster i ON i.r = s.r AND i.gray < 110 GROUP BY 1, 2, 3)
SELECT id, round_even(count_if(d <= 3) / 8.0::DOUBLE, 6) AS near3, round_even(count_if(d <= 6) / 8.0::DOUBLE, 6) AS near6, median(d) AS median_offset FROM d GROUP BY 1 HAVING count(*) >= 4""")
def ink_alignment(t):
    """Boundary samples against the nearest ink of their row; under half of them on the plate gives no row. Each
    place is measured once. Joins are by sorting: the planner takes samples for as small as their parcels."""
    s = t.parcels.select("id", F.explode(F.sequence(F.expr("x0 div 4"), F.expr("x0 div 4 + 7"))).alias("r"), (C("y0") % 64).alias("c"))
    ink = t.raster.where("gray < 110").groupBy("r").agg(F.collect_list("c").alias("ink"))
    place = s.select("r", "c").distinct().hint("merge").join(ink, "r").select("r", "c", F.array_min(F.transform("ink", lambda k: F.abs(k - C("c")))).alias("d"))
    d = s.hint("merge").join(place, ["r", "c"]).select("id", "d")
    share = lambda k: rounded(F.count_if(C("d") <= k) / F.lit(8.0))
    return d.groupBy("id").agg(share(3).alias("near3"), share(6).alias("near6"), F.percentile("d", 0.5).alias("median_offset"), F.count("*").alias("n")).where("n >= 4").drop("n")


@query("components", "raster", """WITH RECURSIVE m AS MATERIALIZED (SELECT r, c, r * 64 + c AS k FROM raster WHERE gray < 45), e AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM m a JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.k <> b.k), w(k, l) AS (SELECT k, k FROM m UNION SELECT e.v, w.l FROM w JOIN e ON w.k = e.u)
SELECT l // 64 AS r, l % 64 AS c, count(*) AS px FROM (SELECT k, min(l) AS l FROM w GROUP BY k) GROUP BY l""")
def components(t):
    """The eight-connected components of dark pixels by their first pixel, with their size."""
    lab = R.components(t.raster.where("gray < 45"), eight=True)
    return lab.groupBy("label").agg(F.count("*").alias("px")).select(F.expr(f"label div {1 << 31}").alias("r"), (C("label") % (1 << 31)).alias("c"), "px")


@query("polygonize_stats", "raster", """WITH RECURSIVE m AS MATERIALIZED (SELECT r, c, r * 64 + c AS k FROM raster WHERE gray < 45), e AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1), w(k, l) AS (SELECT k, k FROM m UNION SELECT e.v, w.l FROM w JOIN e ON w.k = e.u)
SELECT l // 64 AS r, l % 64 AS c, count(*) AS px, min(k // 64) AS r0, max(k // 64) AS r1, min(k % 64) AS c0, max(k % 64) AS c1 FROM (SELECT k, min(l) AS l FROM w GROUP BY k) GROUP BY l""")
def polygonize_stats(t):
    """Area and bounds of each component, named by its first pixel."""
    lab = R.components(t.raster.where("gray < 45"))
    g = lab.groupBy("label").agg(F.count("*").alias("px"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return g.select(F.expr(f"label div {1 << 31}").alias("r"), (C("label") % (1 << 31)).alias("c"), "px", "r0", "r1", "c0", "c1")


@query("union_agg", "candidates", "SELECT parcel_id, count(*) AS px FROM (SELECT DISTINCT parcel_id, x, unnest(range(y0, y1)) AS y FROM (SELECT parcel_id, y0, y1, unnest(range(x0, x1)) AS x FROM candidates)) GROUP BY 1")
def union_agg(t):
    """Area of the union of each parcel's candidates."""
    from atlasforge.operators.spatial import union_area

    return union_area(t.candidates, "parcel_id").select("parcel_id", C("area").alias("px"))


@query("guard_output_exists", "parcels", "SELECT count(*) AS n, true AS refused FROM parcels")
def guard_output_exists(t):
    """A second write to the same place is refused."""
    from pyspark.errors import AnalysisException

    from atlasforge.sources.files import write_once
    from atlasforge.staging import staged

    first = staged(t.parcels, "guard")
    path = first.inputFiles()[0].rpartition("/")[0]
    try:
        write_once(t.parcels, path)
        refused = False
    except AnalysisException:
        refused = True
    return first.agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("file_hashes")
def file_hashes(t):
    """Size and SHA-256 of all input files."""
    from atlasforge.sources.files import file_hashes as hashes

    return hashes(t.spark, f"{t.sf_dir}/*.parquet").select("size", "sha256")


HALO = 32


def _tile_query(t, columns: str, work, schema: str):
    """work(grid, r0, c0, mine) -> rows for each tile of the raster, read with a margin of `HALO` pixels;
    mine(r, c) tells which places of the raster the tile owns. A component belongs to the tile with its
    first pixel, so it comes once, and whole as far as the margin reaches."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = T.grid_of(pdf, "gray", 255)
        mine = lambda r, c: (np.asarray(r) // TILE == key[0]) & (np.asarray(c) // TILE == key[1])
        return pd.DataFrame(work(grid, r0, c0, mine), columns=columns.split())

    return R.haloed(t.raster, HALO, TILE).groupBy("br", "bc").applyInPandas(run, schema)


def _own_pixels(mask: np.ndarray, r0: int, c0: int, mine) -> list[tuple[int, int]]:
    r, c = np.nonzero(mask)
    keep = mine(r + r0, c + c0)
    return [(int(a) + r0, int(b) + c0) for a, b in zip(r[keep], c[keep], strict=True)]


@query("line_opening")
def line_opening(t):
    """Ink that a 15-pixel line at 9.5 degrees, or one across, fits into; pixel by pixel."""
    work = lambda g, r0, c0, mine: _own_pixels(T.opened(g < 150, T.oriented(15, 99.5)) | T.opened(g < 150, T.oriented(11, 9.5)), r0, c0, mine)
    return _tile_query(t, "r c", work, schema="r bigint, c bigint")


@query("plate_mask")
def plate_mask(t):
    """Blocks of four by four on the plate: not dark by their maximum in a component that reaches the raster's
    border, and two blocks away from what is."""
    block = t.raster.groupBy(F.expr("r div 4").alias("r"), F.expr("c div 4").alias("c")).agg(F.max("gray").alias("top"))
    lab = R.components(block.where("top < 120").select("r", "c"))
    ends = block.agg(F.max("r").alias("r1"), F.max("c").alias("c1"))  # one row
    edge = lab.crossJoin(ends).where("r IN (0, r1) OR c IN (0, c1)").select("label").distinct()
    off = lab.join(edge, "label", "left_semi").select("r", "c", F.lit(0).alias("off"))
    on = block.select("r", "c").join(off, ["r", "c"], "left").select("r", "c", F.coalesce("off", F.lit(1)).alias("on"))
    return R.box_sums(on, {"s": C("on")}, 2).where("s = 25").select("r", "c")


@query("skeletonize")
def skeletonize(t):
    work = lambda g, r0, c0, mine: _own_pixels(T.thin(g < 110), r0, c0, mine)
    return _tile_query(t, "r c", work, schema="r bigint, c bigint")


def _pieces(mask: np.ndarray, least: int, r0: int, c0: int, mine):
    """The components of at least so many pixels whose first pixel the tile owns."""
    lab = R.label_components(mask)
    for k in np.unique(lab[lab > 0]):
        first = divmod(int(k) - 1, mask.shape[1])
        if mine(first[0] + r0, first[1] + c0):
            part = lab == k
            if part.sum() >= least:
                yield part, first[0] + r0, first[1] + c0


@query("threshold_candidates")
def threshold_candidates(t):
    """The baseline: ink, closed by 3, opened by 3, components of the whole raster of at least 10 pixels with
    their bounds."""
    m = R.morphed(t.raster.select("r", "c", (C("gray") < 120).cast("int").alias("m")), (F.max, 1), (F.min, 1), (F.min, 1), (F.max, 1))
    lab = R.components(m.where("m = 1").select("r", "c"))
    g = lab.groupBy("label").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.count("*").alias("px"))
    return g.where("px >= 10").drop("label")


@query("drawn_cells")
def drawn_cells(t):
    """White components wide enough for a disc of two pixels: size and greatest distance to ink, by their
    first pixel. Components and distances are those of the whole raster."""
    from atlasforge.operators.distance import distance_transform

    lab = R.components(t.raster.where("gray >= 60").select("r", "c"))
    d = distance_transform(t.raster.select("r", "c", (C("gray") < 60).alias("set")))
    g = lab.join(d, ["r", "c"]).groupBy("label").agg(F.count("*").alias("px"), F.max("d").alias("width")).where("px >= 8 AND width >= 2")
    return g.select(F.expr(f"label div {1 << 31}").alias("r"), (C("label") % (1 << 31)).alias("c"), "px", "width")


@query("divider_split")
def divider_split(t):
    """Dark components cut along vertical lines of ink: seeds are what the dilated lines leave, and grow back
    until they tile the component; a component with fewer than two seeds stays whole."""

    def work(g, r0, c0, mine):
        out = []
        lines = T.dilate(T.opened(g < 60, T.oriented(5, 90)), np.ones((1, 3), bool))
        for part, r, c in _pieces(g < 120, 60, r0, c0, mine):
            seeds = R.label_components(part & ~lines)
            kinds = [k for k in np.unique(seeds[seeds > 0]) if (seeds == k).sum() >= 8]
            if not 2 <= len(kinds) <= 40:
                out.append((r, c, 1, int(part.sum())))
                continue
            grown = np.where(np.isin(seeds, kinds), seeds, 0)
            for _ in range(64):
                wide = np.max([T.shifted(grown, *s) for s in ((0, 1), (1, 0), (0, -1), (-1, 0))], axis=0)
                new = np.where((grown == 0) & part, wide, grown)
                if (new == grown).all():
                    break
                grown = new
            out += [(r, c, i + 1, int((grown == k).sum())) for i, k in enumerate(kinds)]
        return out

    return _tile_query(t, "r c piece px", work, schema="r bigint, c bigint, piece bigint, px bigint")


@query("embedded_reject")
def embedded_reject(t):
    """Small dark components, by their first pixel, and whether the ring around them is mostly dark, too."""
    lab = R.components(t.raster.where("gray < 60").select("r", "c"))
    small = lab.groupBy("label").agg(F.count("*").alias("px")).where("px BETWEEN 2 AND 59")
    some = lab.join(small, "label")

    def grown(size: int):
        k = T.ellipse(size)
        at = F.array(*(F.struct((C("r") + int(i) - size // 2).alias("r"), (C("c") + int(j) - size // 2).alias("c")) for i, j in zip(*np.nonzero(k), strict=True)))
        return some.select("label", "px", F.explode(at).alias("s")).select("label", "px", "s.r", "s.c").distinct()

    ring = grown(9).join(grown(3), ["label", "r", "c"], "left_anti").join(t.raster, ["r", "c"])
    share = ring.groupBy("label").agg(F.avg((C("gray") < 110).cast("double")).alias("share"))
    j = small.join(share, "label", "left")
    return j.select(F.expr(f"label div {1 << 31}").alias("r"), (C("label") % (1 << 31)).alias("c"), "px", (F.coalesce("share", F.lit(0.0)) > 0.30).alias("embedded"))


@query("evidence_bundle")
def evidence_bundle(t):
    """Shares of ink, closed and opened ink, hatch and dividers (strict and relaxed) in each finding's whole
    window, clipped by the raster; none under four pixels."""
    from atlasforge.operators.windows import BITS, window_shares
    from atlasforge.plans.spatial import divider_pixels, hatch_mask

    kind = lambda d, name: d.select("r", "c", F.when(C("strict"), BITS[name] + BITS[name + "_relaxed"]).otherwise(BITS[name + "_relaxed"]).alias(name)).hint("merge")
    fields = t.raster.join(kind(hatch_mask(t), "hatch"), ["r", "c"], "left").join(kind(divider_pixels(t), "divider"), ["r", "c"], "left")
    marks = F.when(C("gray") < 110, BITS["ink"]).otherwise(0) + F.coalesce("hatch", F.lit(0)) + F.coalesce("divider", F.lit(0))
    box = t.findings.where("NOT err AND category IS NOT NULL").select("id", (C("x0") % 40).alias("c0"), (C("y0") % 480).alias("u"), (C("x1") - C("x0")).alias("w"), (C("y1") - C("y0")).alias("h"))
    box = box.select("id", F.least("u", C("u") + C("h")).alias("r0"), F.greatest("u", C("u") + C("h")).alias("r1"), "c0", (C("c0") + C("w")).alias("c1"))
    return window_shares(fields.select("r", "c", marks.cast("bigint").alias("v")), box)


def _ring_query(t, columns: str, work, schema: str):
    def run(batches):
        for pdf in batches:
            rows = [(k, *work(np.array([(p["x"], p["y"]) for p in pts], float))) for k, pts in zip(pdf["id"], pdf["pts"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *columns.split()])

    return rings(t).mapInPandas(run, f"id bigint, {schema}")


@query("mrr")
def mrr(t):
    return _ring_query(t, "long short angle", lambda r: S.min_rect(r)[1:], "long double, short double, angle double")


@query("solidity")
def solidity(t):
    return _ring_query(t, "solidity", lambda r: (S.solidity(r),), "solidity double")


@query("simplify")
def simplify(t):
    return _ring_query(t, "n kept", lambda r: (len(r), len(S.simplify(r, 2.0))), "n bigint, kept bigint")


@query("regularize")
def regularize(t):
    return _ring_query(t, "method area", lambda r: (S.regularized(r)[1], abs(S.signed_area(S.regularized(r)[0]))), "method string, area double")


@query("geom_validity")
def geom_validity(t):
    return _ring_query(t, "n reason", lambda r: (len(r), S.faults(r)), "n bigint, reason string")


@query("geom_normalize")
def geom_normalize(t):
    """A hash of each ring that does not depend on its start or direction."""
    import hashlib

    return _ring_query(t, "digest", lambda r: (hashlib.sha256(S.normalized(r).tobytes()).hexdigest(),), "digest string")


def _samples(box: np.ndarray, n: int, last: bool) -> np.ndarray:
    x0, y0, x1, y1 = box
    ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)
    step = np.hypot(*np.diff(ring, axis=0).T)
    at = np.concatenate(([0], np.cumsum(step)))
    s = np.linspace(0, at[-1], n) if last else np.arange(n) / n * at[-1]
    return np.stack([np.interp(s, at, ring[:, k]) for k in (0, 1)], axis=1)


def _to_boundary(p: np.ndarray, box: np.ndarray) -> np.ndarray:
    x0, y0, x1, y1 = box
    cx, cy = np.clip(p[:, 0], x0, x1), np.clip(p[:, 1], y0, y1)
    outside = np.hypot(p[:, 0] - cx, p[:, 1] - cy)
    inside = np.minimum.reduce([p[:, 0] - x0, x1 - p[:, 0], p[:, 1] - y0, y1 - p[:, 1]])
    return np.where(outside > 0, outside, np.abs(inside))


def _boundary(t, pooled: bool):
    pairs = best_match(pairs_of(t), "a_id", "b_id", pair_iou()).where("best >= 0.5")
    a = t.parcels.select(C("id").alias("a_id"), *(C(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")))
    b = t.candidates.select(C("id").alias("b_id"), *(C(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")))
    joined = pairs.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", *(f"a{c}" for c in ("x0", "y0", "x1", "y1")), *(f"b{c}" for c in ("x0", "y0", "x1", "y1")))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                p, q = np.array(row[2:6], float), np.array(row[6:10], float)
                size = lambda x: 2 * (x[2] - x[0] + x[3] - x[1])
                n = [max(2, int(np.ceil(size(x))) + 1) if pooled else max(8, int(size(x))) for x in (p, q)]
                d = [_to_boundary(_samples(x, k, pooled), y) for x, y, k in ((p, q, n[0]), (q, p, n[1]))]
                out.append((row[0], row[1], float(np.concatenate(d).mean() if pooled else (d[0].mean() + d[1].mean()) / 2)))
            yield pd.DataFrame(out, columns=["a_id", "b_id", "dist"])

    return joined.mapInPandas(run, "a_id bigint, b_id bigint, dist double")


@query("boundary_dist_pooled")
def boundary_dist_pooled(t):
    """Mean distance of boundary samples of both boxes to the other's boundary, pooled."""
    return _boundary(t, True)


@query("boundary_dist_sym")
def boundary_dist_sym(t):
    """Half the sum of the two directions' means."""
    return _boundary(t, False)


@query("nms_masks")
def nms_masks(t):
    """Greedy suppression within a tile by score, over an IoU of 0.5."""
    f = t.findings.where("NOT err").withColumn("score", (C("id") * 7919) % 10007)
    return suppress(f, ["tile_no"], 0.5)


@query("clamp_to_ink", "pairs", "SELECT b_id AS id, a_id, CASE WHEN (b_area - inter) * 100 > 7 * b_area THEN 'clamp' ELSE 'keep' END AS action FROM pairs WHERE inter * 2 >= b_area")
def clamp_to_ink(t):
    """Boxes with more than 7 % overhang are cut back to what supports them."""
    p = pairs_of(t).where(C("inter") * 2 >= area("b_"))
    return p.select(C("b_id").alias("id"), "a_id", ladder(((area("b_") - C("inter")) * 100 > 7 * area("b_"), "clamp"), default="keep").alias("action"))


@query("hatch_core_trim", "pairs", "SELECT b_id AS id, (b_area - inter) * 100 BETWEEN 6 * b_area AND 45 * b_area AND b_id % 100 <= 20 AS trimmed FROM pairs WHERE inter * 2 >= b_area")
def hatch_core_trim(t):
    """Trimmed if 6 to 45 % would go and little of that is hatched."""
    p = pairs_of(t).where(C("inter") * 2 >= area("b_"))
    gone = (area("b_") - C("inter")) * 100
    return p.select(C("b_id").alias("id"), (gone.between(6 * area("b_"), 45 * area("b_")) & (C("b_id") % 100 <= 20)).alias("trimmed"))


@query("postfix_trim", "pairs", "SELECT b_id AS id, CASE WHEN inter / CAST(a_area + b_area - inter AS DOUBLE) < 0.30 THEN 'needs_review' ELSE 'added+trim' END AS action FROM pairs")
def postfix_trim(t):
    return pairs_of(t).select(C("b_id").alias("id"), ladder((pair_iou() < 0.30, "needs_review"), default="added+trim").alias("action"))


@query("core_envelope", "raster", "SELECT r8, max(c8) AS edge FROM (SELECT r // 8 AS r8, c // 8 AS c8 FROM raster GROUP BY 1, 2 HAVING count_if(gray < 110) * 100 > 25 * count(*)) GROUP BY 1")
def core_envelope(t):
    """The outermost dense block of each row of blocks."""
    g = t.raster.groupBy(F.expr("r div 8").alias("r8"), F.expr("c div 8").alias("c8")).agg(F.count_if(C("gray") < 110).alias("k"), F.count("*").alias("n"))
    return g.where("k * 100 > 25 * n").groupBy("r8").agg(F.max("c8").alias("edge"))
