"""Colour and pixel expressions over columns r, g, b, x, y."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def red_option() -> Column:
    """M1: red of the option scorer."""
    r, g, b = _rgb()
    return (r >= 140) & (r - F.greatest(g, b) >= 40) & (g <= 130) & (b <= 130)


def red_maze(dominance: int = 70) -> Column:
    """M1: red of mazes; square mazes take a dominance of 80."""
    r, g, b = _rgb()
    return (r >= 150) & (r - F.greatest(g, b) >= dominance)


def wall() -> Column:
    """M2"""
    return F.greatest(*_rgb()) <= 40


def luma(p: list[Column]) -> Column:
    """0.299 r + 0.587 g + 0.114 b, half up; in whole thousandths, as a grey of 245.5 would be 245.49999999999997 in doubles."""
    return F.round((299 * p[0] + 587 * p[1] + 114 * p[2]) / 1000)


def grey(*rgb: str) -> Column:
    return luma([F.col(c) for c in rgb or ("r", "g", "b")])


def euclidean(a: list[Column], c: list[Column]) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2)) for x, y in zip(a, c, strict=True)), F.lit(0.0)))


def manhattan(a: list[Column], c: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, c, strict=True)), F.lit(0)).cast("double")


def coverage(a: list[Column], c: list[Column]) -> Column:
    """1 where exactly one of the two is bright."""
    return ((luma(a) > 245) != (luma(c) > 245)).cast("double")


def _lab(p: list[Column]) -> list[Column]:
    lin = [F.when(v / 255 <= 0.04045, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4))) for v in p]
    # sRGB to XYZ under D65, and its white.
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    white = (0.95047, 1.0, 1.08883)
    xyz = [sum((k * v for k, v in zip(row, lin, strict=True)), F.lit(0.0)) / w for row, w in zip(rows, white, strict=True)]
    f = [F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def cielab(a: list[Column], c: list[Column]) -> Column:
    return euclidean(_lab(a), _lab(c))


#: Distance by name.
METRICS = {"euclidean": euclidean, "manhattan": manhattan, "coverage": coverage, "cielab": cielab}


def distance(metric: str, a: list[Column], b: list[Column]) -> Column:
    """Of two colours, by the metric's name."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {sorted(METRICS)}")
    return METRICS[metric](a, b)


def total(d: Column, places: int) -> Column:
    """M3: sum of distances (an aggregate), rounded half up. Each is taken in whole 1e-9, so that the sum is exact: sums of
    doubles depend on the order in which the rows meet."""
    return F.round(F.sum(F.floor(d * 1e9 + 0.5).cast("decimal(18,0)")) * F.lit(Decimal("0.000000001")), places).cast("double")


def window(width: int, height: int, crop: tuple[int, int, int, int] | None = None, size: tuple[int, int] | None = None) -> Column:
    """M4: inside an explicit (left, top, right, bottom) window, or a centred one of the given size; right and bottom are outside."""
    if crop is None:
        w, h = size or (width, height)
        crop = ((width - w) // 2, (height - h) // 2, (width - w) // 2 + w, (height - h) // 2 + h)
    left, top, right, bottom = crop
    return (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)


def scaled_box(box: list[Column], source: tuple[int, int], target: tuple[int, int], margin: float = 4) -> list[Column]:
    """M5: (left, top, right, bottom) of a box on another canvas.

    The margin goes in on the source canvas; an axis on which nothing would be left keeps its own edges. Scaled edges are
    rounded half to even; left and top stay below the target's size, right and bottom are one further at least.
    """
    if min(*source, *target) <= 0:
        raise ValueError("canvas sizes must be positive")
    out = {}
    for axis, (low, high) in enumerate(((box[0], box[2]), (box[1], box[3]))):
        inner_low, inner_high = F.greatest(F.lit(0.0), low + margin), F.least(F.lit(float(source[axis])), high - margin)
        room = inner_high > inner_low if margin > 0 else F.lit(False)
        first = F.bround(F.when(room, inner_low).otherwise(low) * (target[axis] / source[axis])).cast("int")
        last = F.bround(F.when(room, inner_high).otherwise(high) * (target[axis] / source[axis])).cast("int")
        first = F.greatest(F.lit(0), F.least(F.lit(target[axis] - 1), first))
        out[axis] = first, F.greatest(first + 1, F.least(F.lit(target[axis]), last))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def nearer(colour: list[Column], base: list[Column], white: tuple[int, int, int] = (255, 255, 255)) -> Column:
    """M6: mono if strictly nearer to the base colour than to white."""
    return F.when(euclidean(colour, base) < euclidean(colour, [F.lit(v) for v in white]), "mono").otherwise("white")


def safe_radius(cell_size: Column, cell_radius: Column, ring_width: Column, scale: Column) -> Column:
    """M7: from the first measure that is there; 4 at least, before and after scaling."""
    base = F.greatest(F.lit(4.0), F.coalesce(F.bround(F.coalesce(cell_size * 0.45, cell_radius * 0.8, ring_width * 0.6)), F.lit(4.0)))
    return F.greatest(F.lit(4.0), F.bround(base * scale)).cast("int")


def cell_of(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Row and column of a regular grid by division, so that a range join becomes an equi join."""
    return F.floor(y / height).cast("int"), F.floor(x / width).cast("int")


def cell_id(row: Column, column: Column, columns: int) -> Column:
    """M10"""
    return row * columns + column


def cell_place(cell: Column, columns: int) -> tuple[Column, Column]:
    return F.floor(cell / columns).cast("long"), cell % columns


def extent(record: str, fallback: tuple[int, int] | None = None) -> tuple[Column, Column]:
    """Width and height of a record's canvas: canvas_dimensions (a pair or an object), canvas_size, or the largest
    right and bottom of cell_bboxes, each only if positive; rounded half to even. Without them the fallback, else an error."""
    at = lambda path: F.get_json_object(record, path).try_cast("double")
    whole = lambda v: F.bround(v).cast("long")
    pair = F.struct(whole(at("$.canvas_dimensions[0]")).alias("w"), whole(at("$.canvas_dimensions[1]")).alias("h"))
    named = F.struct(whole(at("$.canvas_dimensions.width")).alias("w"), whole(at("$.canvas_dimensions.height")).alias("h"))
    size = F.struct(whole(at("$.canvas_size")).alias("w"), whole(at("$.canvas_size")).alias("h"))
    boxes = F.filter(F.flatten(F.from_json(F.get_json_object(record, "$.cell_bboxes"), "array<array<array<double>>>")), lambda b: F.size(b) >= 4)
    most = F.struct(*(whole(F.array_max(F.transform(boxes, lambda b: b[k]))).alias(n) for k, n in ((2, "w"), (3, "h"))))  # noqa: B023
    fits = lambda s: F.when((s["w"] > 0) & (s["h"] > 0), s)
    last = F.raise_error(F.lit("no canvas size in the record")).cast("struct<w:bigint,h:bigint>") if fallback is None else F.struct(F.lit(fallback[0]).cast("long").alias("w"), F.lit(fallback[1]).cast("long").alias("h"))
    found = F.coalesce(fits(pair), fits(named), fits(size), fits(most), last)
    return found["w"], found["h"]
