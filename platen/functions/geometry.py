"""Scalar geometry as column expressions: page boxes, affine and projective maps, rectangles, tolerances."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the spacing of doubles at one, below which a denominator counts as zero.
EPSILON = 2.220446049250313e-16


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def effective_box(media: Column, crop: Column) -> Column:
    """The crop box where there is one, else the media box."""
    return F.coalesce(crop, media)


def rotation(turn: Column) -> Column:
    """Quarter turns modulo 360; other angles count as none."""
    return F.when(F.pmod(turn, F.lit(90)) == 0, F.pmod(turn, F.lit(360))).otherwise(0)


def user_unit(unit: Column) -> Column:
    return F.when(_finite(unit) & (unit > 0), unit).otherwise(1.0)


def display_size(width: Column, height: Column, turn: Column) -> Column:
    """Axes change places at 90 and 270 degrees."""
    swapped = rotation(turn).isin(90, 270)
    return F.struct(F.when(swapped, height).otherwise(width).alias("width"), F.when(swapped, width).otherwise(height).alias("height"))


def size_delta(own: Column, other: Column) -> Column:
    return F.struct((other["width"] - own["width"]).alias("width"), (other["height"] - own["height"]).alias("height"))


def top_left(x: Column, y: Column, origin_x: Column, origin_y: Column, height: Column) -> Column:
    """From a lower-left origin to a top-left one, unclamped."""
    return F.struct((x - origin_x).alias("x"), (height - (y - origin_y)).alias("y"))


def affine_apply(m: Column, x: Column, y: Column) -> Column:
    """m = [a, b, c, d, e, f] over a column vector."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def affine_multiply(m: Column, n: Column) -> Column:
    """The map that applies m first, then n."""
    return F.array(
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]
    )


def advance(width: Column, size: Column, char_space: Column, word_space: Column, scale: Column, space: Column) -> Column:
    """How far the pen moves: widths in thousandths, scale in percent; word space only after a single-byte space."""
    return (width / 1000 * size + char_space + F.when(space, word_space).otherwise(0.0)) * scale / 100


def denominator(m: Column, x: Column, y: Column) -> Column:
    return m[6] * x + m[7] * y + m[8]


def project(m: Column, x: Column, y: Column) -> Column:
    """A point through a homography; null where the denominator is not finite or vanishes."""
    d = denominator(m, x, y)
    safe = F.when(_finite(d) & (F.abs(d) > EPSILON), d)
    return F.when(safe.isNotNull(), F.struct(((m[0] * x + m[1] * y + m[2]) / safe).alias("x"), ((m[3] * x + m[4] * y + m[5]) / safe).alias("y")))


def _over_corners(m: Column, box: Column, keep: Callable[[list[tuple[Column, Column, Column]], tuple[Column, ...]], Column]) -> Column:
    """Envelope of a box's projected corners; null unless keep(corners, envelope) holds. Corners are their denominator and the point.

    They are plain columns: Spark compiles these, but interprets what a lambda binds, which takes longer than to repeat them.
    """
    places = [(box["x0"], box["y0"]), (box["x1"], box["y0"]), (box["x1"], box["y1"]), (box["x0"], box["y1"])]
    corners = []
    for x, y in places:
        d = denominator(m, x, y)
        corners.append((d, F.try_divide(m[0] * x + m[1] * y + m[2], d), F.try_divide(m[3] * x + m[4] * y + m[5], d)))
    _, xs, ys = zip(*corners, strict=True)
    ends = (F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    return F.when(keep(corners, ends), F.struct(*[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)]))


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def _clear(corners: list[tuple[Column, Column, Column]]) -> Column:
    return _all([F.coalesce(_finite(d) & (F.abs(d) > EPSILON), F.lit(False)) for d, _, _ in corners])


def project_box_compare(m: Column, box: Column) -> Column:
    """Envelope of the four projected corners; null if a corner has none."""
    return _over_corners(m, box, lambda c, e: _clear(c))


def project_box_plan(m: Column, box: Column) -> Column:
    """As for comparing, and the corners lie on one side of the horizon and the envelope has an area."""

    def keep(c: list[tuple[Column, Column, Column]], e: tuple[Column, ...]) -> Column:
        one_side = _all([d > 0 for d, _, _ in c]) | _all([d < 0 for d, _, _ in c])
        return _clear(c) & one_side & (e[2] > e[0]) & (e[3] > e[1])

    return _over_corners(m, box, keep)


def project_box_layout(m: Column, box: Column) -> Column:
    """Only finiteness is asked of the corners."""
    return _over_corners(m, box, lambda c, e: _all([_finite(x) & _finite(y) for _, x, y in c]))


def project_baseline(m: Column, points: Column) -> Column:
    """Median y of a projected polyline; null if any of its points has none."""
    ys = F.array_sort(F.transform(points, lambda p: project(m, p["x"], p["y"])["y"]))
    n = F.size(ys)
    middle = (F.get(ys, F.floor((n - 1) / 2).cast("int")) + F.get(ys, F.floor(n / 2).cast("int"))) / 2
    return F.when((n > 0) & F.forall(ys, lambda y: y.isNotNull()), middle)


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def regular(m: Column) -> Column:
    d = determinant(m)
    return _finite(d) & (F.abs(d) > EPSILON)


def clear_of_horizon(m: Column, points: Column) -> Column:
    return F.forall(points, lambda p: _finite(denominator(m, p["x"], p["y"])) & (F.abs(denominator(m, p["x"], p["y"])) > EPSILON))


def tolerance(absolute: Column, em: Column, size: Column) -> Column:
    """An absolute tolerance, else one in ems of a size."""
    return F.coalesce(absolute, em * size)


def within(delta: Column, limit: Column) -> Column:
    return F.abs(delta) <= limit


def point_envelope(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def quantise(x: Column, steps: int = 1024) -> Column:
    """Whole steps of a distance, ties to even; an error where it isn't finite or leaves the range of a long."""
    made = F.rint(F.abs(x) * steps)
    return F.when(_finite(x) & (made < 2.0**63), made.cast("long")).otherwise(F.raise_error(F.lit("a residual is not finite or too large")).cast("long"))


def pixel_scale(width_px: Column, height_px: Column, width_pt: Column, height_pt: Column, most: float = 0.005) -> Column:
    """Points per pixel on both axes; null where these differ by more than that share."""
    sx, sy = F.try_divide(width_pt, width_px), F.try_divide(height_pt, height_px)
    return F.when(F.abs(F.try_divide(sx, sy) - 1) <= most, F.struct(sx.alias("x"), sy.alias("y")))


def scale_box(box: Column, scale: Column) -> Column:
    return F.when(box.isNotNull() & scale.isNotNull(), F.struct((box["x0"] * scale["x"]).alias("x0"), (box["y0"] * scale["y"]).alias("y0"), (box["x1"] * scale["x"]).alias("x1"), (box["y1"] * scale["y"]).alias("y1")))


def scale_points(points: Column, scale: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * scale["x"]).alias("x"), (p["y"] * scale["y"]).alias("y")))


def rotate(x: Column, y: Column, centre_x: Column, centre_y: Column, degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct((centre_x + (x - centre_x) * c - (y - centre_y) * s).alias("x"), (centre_y + (x - centre_x) * s + (y - centre_y) * c).alias("y"))


def inverse_rotation(width: Column, height: Column, degrees: Column) -> Column:
    """The affine map, row by row, that undoes a rotation about the middle of a page."""
    c, s, x, y = F.cos(F.radians(-degrees)), F.sin(F.radians(-degrees)), width / 2, height / 2
    return F.array(F.round(c, 10), F.round(-s, 10), F.round(x - c * x + s * y, 6), F.round(s, 10), F.round(c, 10), F.round(y - s * x - c * y, 6))


def quadrants(width: Column, height: Column) -> Column:
    """Four boxes (whole numbers) of a page, by rows."""
    x, y = F.floor(width / 2), F.floor(height / 2)
    whole = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("long")
    box = lambda *v: F.struct(*[whole(e).alias(n) for n, e in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    return F.array(box(0, 0, x, y), box(x, 0, width, y), box(0, y, x, height), box(x, y, width, height))


def padded_box(box: Column, left: float, top: float, right: float, bottom: float, width: Column, height: Column) -> Column:
    return F.struct(
        F.greatest(box["x0"] - left, F.lit(0.0)).alias("x0"), F.greatest(box["y0"] - top, F.lit(0.0)).alias("y0"), F.least(box["x1"] + right, width).alias("x1"), F.least(box["y1"] + bottom, height).alias("y1")
    )


def axis_plan(own: Column, wanted: Column) -> Column:
    """Where a centred axis is cut and pasted when its length changes."""
    cut, paste = F.floor((own - wanted) / 2), F.floor((wanted - own) / 2)
    return F.struct(F.greatest(cut, F.lit(0)).alias("crop"), F.greatest(paste, F.lit(0)).alias("paste"), F.least(own, wanted).alias("length"))


def shape_distance(a: Column, b: Column, ratio_a: Column, ratio_b: Column) -> Column:
    """The larger of mean absolute difference and log aspect ratio; null for other lengths."""
    mean = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(mean, F.abs(F.ln(ratio_a / ratio_b))))


def intersects(a: Column, b: Column) -> Column:
    """Half-open overlap."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def centre(box: Column) -> Column:
    return F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))


def mirrored(x: Column, width: Column) -> Column:
    return width - x


def scaled_node(box: Column, polygon: Column, baseline: Column, scale: Column) -> Column:
    """box, polygon and baseline in points; each null where it or the scale is unknown, a baseline also where it is not finite or negative."""
    y = F.when(_finite(baseline) & (baseline >= 0), baseline * scale["y"])
    return F.struct(scale_box(box, scale).alias("box"), F.when(scale.isNotNull(), scale_points(polygon, scale)).alias("polygon"), y.alias("baseline"))


def project_claim(m: Column, claim: Column) -> Column:
    """A claim (see claims) of a polyline through a homography: evidence and confidence stay, an unknown claim stays as it is. Null where a known
    one has a point beyond reach: its denominator must lie clear of the horizon."""
    points = F.transform(claim["value"], lambda p: project(m, p["x"], p["y"]))
    moved = F.when(clear_of_horizon(m, claim["value"]) & F.forall(points, lambda p: p.isNotNull()), claim.withField("value", points))
    return F.when(claim["status"] == "known", moved).otherwise(claim)
