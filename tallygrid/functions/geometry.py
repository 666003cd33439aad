"""Plane geometry as Column expressions; a point is a pair of Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def distance(p: Point, q: Point) -> Column:
    return F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))


def cross(p: Point, q: Point, r: Point) -> Column:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def area(p: Point, q: Point, r: Point) -> Column:
    return F.abs(cross(p, q, r)) / 2


def angle(vertex: Point, p: Point, q: Point) -> Column:
    """Degrees at the vertex; the cosine is clamped to -1..1; null where an arm has no length."""
    dot = (p[0] - vertex[0]) * (q[0] - vertex[0]) + (p[1] - vertex[1]) * (q[1] - vertex[1])
    cosine = F.try_divide(dot, distance(vertex, p) * distance(vertex, q))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def projection(p: Point, a: Point, b: Point) -> tuple[Column, Column, Column]:
    """(t, x, y): foot of p on the line a-b at a + t * (b - a); t is 0 if a and b are one point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.coalesce(F.try_divide((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))
    return t, a[0] + t * dx, a[1] + t * dy


def line_distance(p: Point, a: Point, b: Point) -> Column:
    return F.coalesce(F.try_divide(F.abs(cross(a, b, p)), distance(a, b)), distance(p, a))


def centroid(a: Point, b: Point, c: Point) -> Point:
    return (a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3


def _flat(a: Point, b: Point, c: Point) -> Column:
    return F.abs(cross(a, b, c)) < 1e-9


def circumcentre(a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """(x, y, radius); 0, 0, 0 for points on a line."""
    d = 2 * cross(a, b, c)
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = F.try_divide(cy * bb - by * cc, d), F.try_divide(bx * cc - cx * bb, d)
    flat = _flat(a, b, c)
    return F.when(flat, 0.0).otherwise(a[0] + ux), F.when(flat, 0.0).otherwise(a[1] + uy), F.when(flat, 0.0).otherwise(F.sqrt(ux * ux + uy * uy))


def incentre(a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """(x, y, radius); 0, 0, 0 for points on a line."""
    la, lb, lc = distance(b, c), distance(a, c), distance(a, b)
    around, flat = la + lb + lc, _flat(a, b, c)
    place = lambda k: F.when(flat, 0.0).otherwise(F.try_divide(la * a[k] + lb * b[k] + lc * c[k], around))
    return place(0), place(1), F.when(flat, 0.0).otherwise(F.try_divide(2 * area(a, b, c), around))


def orthocentre(a: Point, b: Point, c: Point) -> Point:
    """Sum of the corners less two circumcentres; null for points on a line."""
    x, y, _ = circumcentre(a, b, c)
    flat = _flat(a, b, c)
    return F.when(~flat, a[0] + b[0] + c[0] - 2 * x), F.when(~flat, a[1] + b[1] + c[1] - 2 * y)


def altitude_foot(p: Point, a: Point, b: Point) -> Point:
    _, x, y = projection(p, a, b)
    return x, y


# Smallest side, altitude and area as shares of the canvas's short side (area: of its square).
TRIANGLE_RULES = {"min_side": 0.18, "min_altitude": 0.12, "min_area": 0.03}
# By task smallest side and area as such shares, smallest and largest angle, and degrees to keep from a right angle.
TRIANGLE_TASKS = {
    "triangle_center": (0.20, 0.04, 31.0, 116.0, 0.0),
    "incenter": (0.20, 0.04, 31.0, 116.0, 0.0),
    "circumcenter": (0.20, 0.04, 31.0, 112.0, 0.0),
    "orthocenter": (0.22, 0.045, 33.0, 110.0, 8.0),
}


def triangle_reject(
    a: Point, b: Point, c: Point, short: float, min_side: float = 0.18, min_area: float = 0.03, min_altitude: float = 0.12, min_angle: float | None = None, max_angle: float | None = None, forbidden: tuple[tuple[float, float], ...] = ()
) -> Column:
    """Q1: what is wrong with a triangle, null if nothing."""
    sides = [distance(b, c), distance(a, c), distance(a, b)]
    angles = [angle(a, b, c), angle(b, a, c), angle(c, a, b)]
    out = F.when(area(a, b, c) < min_area * short * short, "area").when(F.least(*sides) < min_side * short, "side")
    out = out.when(F.coalesce(F.try_divide(2 * area(a, b, c), F.greatest(*sides)), F.lit(0.0)) < min_altitude * short, "altitude")
    if min_angle is not None:
        out = out.when(F.least(*angles) < min_angle, "smallest angle")
    if max_angle is not None:
        out = out.when(F.greatest(*angles) > max_angle, "largest angle")
    for low, high in forbidden:
        out = out.when(F.exists(F.array(*angles), lambda x: (x >= low) & (x <= high)), "forbidden angle")
    return out


def triangle_violations(a: Point, b: Point, c: Point, short: float, task: str) -> dict[str, Column]:
    """Q4: rules of a task that a triangle breaks."""
    side, size, low, high, off = TRIANGLE_TASKS[task]
    angles = [angle(a, b, c), angle(b, a, c), angle(c, a, b)]
    return {
        "side": F.least(distance(b, c), distance(a, c), distance(a, b)) < side * short,
        "area": area(a, b, c) < size * short * short,
        "small_angle": F.least(*angles) < low,
        "large_angle": F.greatest(*angles) > high,
        "right_angle": F.exists(F.array(*angles), lambda x: F.abs(x - 90.0) < off),
    }


def polygon_area(points: list[Point]) -> Column:
    terms = [p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)]
    return F.abs(sum(terms[1:], terms[0])) / 2


def polygon_violations(points: list[Point], short: float, kind: str) -> dict[str, Column]:
    """Q4: fixed values of the shape checks, as shares of the canvas's short side."""
    sides = [distance(p, q) for p, q in zip(points, points[1:] + points[:1], strict=True)]
    if kind == "parallelogram":
        return {"side": F.least(*sides) < 0.17 * short, "area": polygon_area(points) < 0.04 * short * short}
    if kind == "isosceles_trapezoid":
        return {"top": sides[2] < 0.18 * short, "area": polygon_area(points) < 0.05 * short * short}
    if kind == "square_outlier":
        return {"side": F.least(*sides) < 0.25 * short, "area": polygon_area(points) < 0.09 * short * short}
    if kind == "right_triangle":  # corner with the right angle first
        legs = (sides[0], sides[-1])
        return {"leg": F.least(*legs) < 0.20 * short, "ratio": F.coalesce(F.try_divide(F.greatest(*legs), F.least(*legs)), F.lit(float("inf"))) > 1.35}
    raise ValueError(kind)


#: Q4 as a table. Task, measure, which side of the limit breaks it, limit, power of the short side that it is a share of.
QUALITY_RULES = [
    *((task, *rule) for task, (side, size, low, high, off) in TRIANGLE_TASKS.items() for rule in (
        ("side", "below", side, 1), ("area", "below", size, 2), ("small_angle", "below", low, 0), ("large_angle", "above", high, 0), ("right_angle", "below", off, 0)) if rule[2] > 0),
    ("angle_bisector", "opening", "below", 36.0, 0), ("angle_bisector", "opening", "above", 120.0, 0),
    ("parallelogram", "side", "below", 0.17, 1), ("parallelogram", "area", "below", 0.04, 2),
    ("isosceles_trapezoid", "top", "below", 0.18, 1), ("isosceles_trapezoid", "area", "below", 0.05, 2),
    ("right_triangle", "leg", "below", 0.20, 1), ("right_triangle", "ratio", "above", 1.35, 0),
    ("square_outlier", "side", "below", 0.25, 1), ("square_outlier", "area", "below", 0.09, 2),
]


def measures(points: list[Point]) -> dict[str, Column]:
    """Q4: what the rules look at. Three points: a triangle, the first its right angle, the second the vertex of an opening.
    Four: a polygon, of which the third side is the top."""
    sides = [distance(p, q) for p, q in zip(points, points[1:] + points[:1], strict=True)]
    if len(points) != 3:
        return {"side": F.least(*sides), "area": polygon_area(points), "top": sides[2]}
    a, b, c = points
    angles, legs = [angle(a, b, c), angle(b, a, c), angle(c, a, b)], (sides[0], sides[2])
    return {
        "side": F.least(*sides), "area": area(a, b, c), "small_angle": F.least(*angles), "large_angle": F.greatest(*angles), "right_angle": F.least(*(F.abs(x - 90.0) for x in angles)),
        "opening": angles[1], "leg": F.least(*legs), "ratio": F.coalesce(F.try_divide(F.greatest(*legs), F.least(*legs)), F.lit(float("inf"))),
    }


def broken_rules(rows: DataFrame, key: list[str], shapes: dict[str, list[Point]], short: float, rules: list[tuple] = QUALITY_RULES) -> DataFrame:
    """Q4: (key, task, measure, side): every rule that a row's shapes break. shapes: task -> its points; rules: a short table,
    which is broadcast; measures are worked out once a row and joined with it."""
    wanted = {t: {m for task, m, *_ in rules if task == t} for t in shapes}
    values = F.array(*(F.struct(F.lit(t).alias("task"), F.lit(m).alias("measure"), v.alias("value")) for t, points in shapes.items() for m, v in measures(points).items() if m in wanted[t]))
    long = rows.select(*key, F.inline(values))
    table = rows.sparkSession.createDataFrame([(t, m, s, float(x) * short**p) for t, m, s, x, p in rules], "task string, measure string, side string, _limit double")
    found = long.join(F.broadcast(table), ["task", "measure"])
    return found.where(F.when(F.col("side") == "below", F.col("value") < F.col("_limit")).otherwise(F.col("value") > F.col("_limit"))).select(*key, "task", "measure", "side")


def well_spaced(points: Column, least: float) -> Column:
    """No two of an array of structs x, y are nearer than `least`."""
    near = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2))) < least
    later = F.transform(points, lambda p, i: F.exists(F.slice(points, i + 2, F.size(points)), lambda q: near(p, q)))
    return ~F.exists(later, lambda x: x)


def inside(points: Column, width: float, height: float, padding: float) -> Column:
    return F.forall(points, lambda p: p["x"].between(padding, width - padding) & p["y"].between(padding, height - padding))


def layout_ok(points: Column, width: float, height: float, padding: float, least: float) -> Column:
    """Q2"""
    return inside(points, width, height, padding) & well_spaced(points, least)
