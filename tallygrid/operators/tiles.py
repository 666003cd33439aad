"""Range joins by tiles: which pixels lie in which boxes and discs, as an equi join with an exact test behind it.

An area is put into the level of tiles that are as wide as itself or less than twice that, so that it touches four tiles at
most, whatever its size. A pixel is in one tile of each level. Areas and pixels meet on (key, level, tile); a pair meets once,
as a pixel has one tile in the area's level. Of the pixels in those tiles a part that doesn't depend on the sizes is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest tile, and levels above it: tiles of LEAST * 2**level pixels, up to sides of four billion.
LEAST, LEVELS = 8, 30
AREA = ("x0", "y0", "x1", "y1", "cx", "cy", "radius")


def box_areas(boxes: DataFrame, margin: Column | float = 0) -> DataFrame:
    """(..., x0, y0, x1, y1) of boxes (left, top, right, bottom): grown by the margin, out to whole pixels; x1 and y1 are outside.

    A margin below 0 counts as 0. Boxes of which nothing is left, and those with a null edge, hold no pixel.
    """
    wide = F.greatest(F.lit(0.0), margin if isinstance(margin, Column) else F.lit(float(margin)))
    edge = {"x0": F.floor(F.col("left") - wide), "y0": F.floor(F.col("top") - wide), "x1": F.ceil(F.col("right") + wide), "y1": F.ceil(F.col("bottom") + wide)}
    none = {c: F.lit(None).cast("double") for c in ("cx", "cy", "radius")}
    return boxes.withColumns({k: v.cast("long") for k, v in edge.items()} | none).drop("left", "top", "right", "bottom")


def disc_areas(discs: DataFrame) -> DataFrame:
    """(..., cx, cy, radius) of discs, with the box around each; a radius of 0 or less, or a null, holds no pixel."""
    has = F.col("radius") > 0
    own = {c: F.when(has, F.col(c).cast("double")) for c in ("cx", "cy", "radius")}
    around = {f"{a}{k}": F.when(has, e(F.col(f"c{a}") + s * F.col("radius")) + k).cast("long") for a in "xy" for k, s, e in ((0, -1, F.ceil), (1, 1, F.floor))}
    return discs.withColumns(own).withColumns(around)


def inside(pixels: DataFrame, areas: DataFrame, key: list[str]) -> DataFrame:
    """Every pair of a pixel (key, y, x, ...) and an area of its key that holds it: all columns of both, without the tiles.

    areas: of `box_areas` or `disc_areas` or a union of them. Neither side is broadcast; skewed tiles are split at run time.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = areas.where("x0 < x1 and y0 < y1").withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(side / LEAST)).cast("int")))
    levels = [r[0] for r in own.select("_level").distinct().limit(LEVELS + 1).collect()]  # LEVELS at most
    if not levels:
        return pixels.join(areas.limit(0).hint("merge"), key)
    size = F.expr(f"shiftleft({LEAST}L, _level)")
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size)))
    own = own.withColumn("_ty", span("y0", "y1")).withColumn("_tx", span("x0", "x1"))
    spread = pixels.withColumn("_level", F.explode(F.lit(sorted(levels))))
    spread = spread.withColumns({"_ty": F.floor(F.col("y") / size), "_tx": F.floor(F.col("x") / size)})
    found = spread.join(own.hint("merge"), [*key, "_level", "_ty", "_tx"]).drop("_level", "_ty", "_tx")
    in_box = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return found.where(in_box & (F.col("radius").isNull() | (dx * dx + dy * dy <= F.col("radius") * F.col("radius"))))


def suppressed(mask: DataFrame, areas: DataFrame, key: list[str]) -> DataFrame:
    """The pixels of a mask that lie in no area of their key, such as walls without what the endpoints' markers cover."""
    hit = inside(mask.select(*key, "y", "x").distinct(), areas, key).select(*key, "y", "x").distinct()
    return mask.join(hit.hint("merge"), [*key, "y", "x"], "left_anti")


def marker_boxes(found: DataFrame, seeds: DataFrame, key: list[str], safe_radius: int, width: int, height: int) -> DataFrame:
    """(key, left, top, right, bottom) around the region of each seed (key, y, x): padded by half the radius, 2 to 8 pixels, and clamped.

    found: runs of regions (key, y, x0, x1, region), as `grid.regions` gives them.
    """
    from tallygrid.operators.grid import region_boxes

    hit = seeds.select(*key, "y", F.col("x").alias("_x")).join(found, [*key, "y"]).where("_x between x0 and x1").select(*key, "region").distinct()
    own = found.join(hit.hint("merge"), [*key, "region"])
    return region_boxes(own, key, max(2, min(8, round(safe_radius * 0.5))), width, height).drop("region")
