"""Cells, pixels and frames held in tables: masks, nearest colours, grids, connectivity, paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallygrid.functions.pixels import METRICS, euclidean, total
from tallygrid.operators import paths
from tallygrid.operators.components import connected_components, cut

Palette = list[tuple[str, tuple[int, int, int]]]

#: Side of a tile of an image; a row of it is a long.
TILE = 64


def nearest_palette(rgb: list[Column], palette: Palette) -> Column:
    """Name of the closest colour, the first on a tie. The palette is a literal of a few colours: no join."""
    scored = F.array(*(F.struct(F.round(euclidean(rgb, [F.lit(v) for v in colour]), 9).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, colour) in enumerate(palette)))
    return F.array_min(scored)["name"]


def nearest_candidate(points: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, name) of the candidate closest to the key's point, the first on a tie; points: key, px, py."""
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))), 6)
    return candidates.join(points.hint("merge"), key).groupBy(key).agg(F.min_by("name", F.struct(d, "pos")).alias("name"))


def centroid(pixels: DataFrame, keys: list[str], mask: Column, least: int = 20) -> DataFrame:
    """Count and mean place of masked pixels; no place below `least` pixels."""
    out = pixels.groupBy(*keys).agg(F.count_if(mask).alias("n"), F.avg(F.when(mask, F.col("x"))).alias("cx"), F.avg(F.when(mask, F.col("y"))).alias("cy"))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("cx", "cy")})


def best_frame(frames: DataFrame, reference: DataFrame, metric: str = "euclidean", stride: int = 1, window: Column | None = None) -> DataFrame:
    """(image_id, frame_idx, diff) of the frame with the least summed distance to the reference, the earliest on a tie.

    Both hold one row a pixel; pixels that only one of them has don't count.
    """
    own = frames.where(F.col("frame_idx") % max(1, stride) == 0)
    own = own if window is None else own.where(window)
    ref = reference.select("image_id", "x", "y", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    d = METRICS[metric]([F.col(c) for c in "rgb"], [F.col(f"_{c}") for c in "rgb"])
    sums = own.join(ref, ["image_id", "x", "y"]).groupBy("image_id", "frame_idx").agg(total(d, 6).alias("diff"))
    best = sums.groupBy("image_id").agg(F.min(F.struct("diff", "frame_idx")).alias("_b"))
    return best.select("image_id", F.col("_b.frame_idx").alias("frame_idx"), F.col("_b.diff").alias("diff"))


def cell_means(pixels: DataFrame, keys: list[str], size: int, inset: int = 0) -> DataFrame:
    """Mean colour of the inner part of each cell of a regular grid."""
    inner = (F.col("x") % size >= inset) & (F.col("x") % size < size - inset) & (F.col("y") % size >= inset) & (F.col("y") % size < size - inset)
    place = {"row": F.floor(F.col("y") / size).cast("long"), "col": F.floor(F.col("x") / size).cast("long")}
    return pixels.where(inner).withColumns(place).groupBy(*keys, "row", "col").agg(*(F.avg(c).alias(c) for c in "rgb"))


def valid_grids(cells: DataFrame, n: int) -> DataFrame:
    """(puzzle_id, valid): each row, column and box holds 1..n once. n: a square number, up to 49.

    Each line is a mask of the values that it holds, a bit each, so that one aggregate does for all of them: n * n cells
    whose 3 * n masks are full hold every value once a line. Other values, places outside the grid and nulls make it invalid.
    """
    box = int(n**0.5)
    if box * box != n or n > 49:
        raise ValueError("the size of a grid is a square number, 49 at most")
    inside = F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1) & F.col("value").between(1, n)
    bit = F.when(inside, F.expr("shiftleft(1L, int(value))"))
    lines = {"row": F.col("row"), "col": F.col("col"), "box": F.floor(F.col("row") / box) * box + F.floor(F.col("col") / box)}
    masks = [F.bit_or(F.when(place == k, F.col("_bit"))).alias(f"_{name}{k}") for name, place in lines.items() for k in range(n)]
    full = F.lit((1 << (n + 1)) - 2)
    own = cells.withColumn("_bit", bit).groupBy("puzzle_id").agg(F.count("*").alias("_n"), *masks)
    right = F.col("_n") == n * n
    for name in lines:
        for k in range(n):
            right = right & F.coalesce(F.col(f"_{name}{k}") == full, F.lit(False))
    return own.select("puzzle_id", right.alias("valid"))


def mirrored(cells: DataFrame, half: int, white: str = "white") -> DataFrame:
    """Expected colour of the right half: that of the mirrored left cell, white without one. cells: grid_id, row, col, colour."""
    left = cells.select("grid_id", "row", (2 * half - 1 - F.col("col")).alias("col"), F.col("colour").alias("_left"))
    return cells.where(F.col("col") >= half).join(left, ["grid_id", "row", "col"], "left").withColumn("expected", F.coalesce("_left", F.lit(white))).drop("_left")


def tile_similarity(reference: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """(key, similarity) of each piece: 1 less the mean difference of the colours, each from 0 to 1; one row a pixel on both sides."""
    other = candidate.select(*key, "y", "x", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    gap = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0)) / (3 * 255)
    return reference.join(other, [*key, "y", "x"]).groupBy(*key).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.avg(gap))).alias("similarity"))


def puzzle_accuracy(pieces: DataFrame, puzzle: str, least: float = 0.9) -> DataFrame:
    """(puzzle, correct, total, accuracy): pieces that are alike enough, of all pieces of a puzzle."""
    right = F.count_if(F.col("similarity") >= least)
    return pieces.groupBy(puzzle).agg(right.alias("correct"), F.count("*").alias("total"), (right / F.count("*")).alias("accuracy"))


def clean_border(pixels: DataFrame, key: list[str], width: int, height: int, least: int = 250) -> DataFrame:
    """(key, clean): whether every pixel on the edge of the image is near white."""
    edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    return pixels.where(edge).groupBy(*key).agg(F.bool_and(F.least(*"rgb") >= least).alias("clean"))


def trim_box(pixels: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Box of pixels that differ from the corner pixel (least y, then x) by more than the tolerance; all pixels if none do."""
    corner = pixels.groupBy(*keys).agg(F.min_by(F.struct(*"rgb"), F.struct("y", "x")).alias("_c"))
    own = pixels.join(corner, keys).withColumn("_in", F.greatest(*(F.abs(F.col(c) - F.col(f"_c.{c}")) for c in "rgb")) > tolerance)
    edge = lambda f, c: F.coalesce(f(F.when(F.col("_in"), F.col(c))), f(c))
    return own.groupBy(*keys).agg(edge(F.min, "x").alias("left"), edge(F.min, "y").alias("top"), edge(F.max, "x").alias("right"), edge(F.max, "y").alias("bottom"))


def _tile_runs(bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tile, row, first and last column, first run of the region) of the runs of bits in tiles of 64 rows, in order."""
    mask = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").reshape(len(bits), TILE, TILE).astype(bool)
    edge = np.diff(mask.view(np.int8), axis=2, prepend=0, append=0)
    tile, row, x0 = np.nonzero(edge[:, :, :-1] > 0)
    x1 = np.nonzero(edge[:, :, 1:] < 0)[2]
    run = np.cumsum(edge[:, :, :-1] > 0, dtype=np.int32).reshape(mask.shape) - 1
    both = mask[:, 1:] & mask[:, :-1]
    a, b = run[:, 1:][both], run[:, :-1][both]
    root = np.arange(len(x0), dtype=np.int32)
    while (root[a] != root[b]).any():
        p, q = root[a], root[b]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up
    return tile, row, x0, x1, root


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (key, _ty, _tx, _rows) to (key, _runs); 128 tiles are taken in hand at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            *_, ty, tx, rows = part.columns
            owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(rows).to_numpy())
            flat = rows.flatten()
            bits = np.zeros((part.num_rows, TILE), dtype=np.int64)
            bits[owner, flat.field("y").to_numpy() % TILE] = flat.field("bits").to_numpy()
            tile, row, x0, x1, root = _tile_runs(bits)
            top, left = ty.to_numpy()[tile] * TILE, tx.to_numpy()[tile] * TILE
            cols = {"y": top + row, "x0": left + x0, "x1": left + x1, "fy": top + row[root], "fx": left + x0[root]}
            runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], names=list(cols))
            offsets = pa.array(np.searchsorted(tile, np.arange(part.num_rows + 1)), pa.int32())
            keys = part.columns[:-3]
            yield pa.record_batch([*keys, pa.ListArray.from_arrays(offsets, runs)], names=[*part.schema.names[:-3], "_runs"])


def regions(pixels: DataFrame, key: list[str]) -> DataFrame:
    """G1: (key, y, x0, x1, region) of the 4-connected regions of masked pixels; runs end at multiples of TILE.

    Images of any size are cut into tiles of TILE x TILE pixels, whose rows are bits of a long. Regions inside a tile are
    found in the task that has it, many tiles in arrays at once. Only regions that meet at the edges of tiles are nodes of a
    graph, whose components are found for all images in rounds that grow with the log of the diameter.
    """
    place = pixels.where("y is not null and x is not null").select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    rows = place.groupBy(*key, "y", F.expr("shiftright(x, 6)").alias("_tx")).agg(F.expr("bit_or(shiftleft(1L, int(x & 63)))").alias("bits"))
    tiles = rows.groupBy(*key, F.expr("shiftright(y, 6)").alias("_ty"), "_tx").agg(F.collect_list(F.struct("y", "bits")).alias("_rows"))
    schema = StructType([*(tiles.schema[k] for k in key), StructField("_runs", ArrayType(StructType([StructField(c, LongType()) for c in ("y", "x0", "x1", "fy", "fx")])))])
    found = cut(tiles.mapInArrow(_label, schema)).select(*key, F.inline("_runs"))
    runs = found.select(*key, "y", "x0", "x1", F.xxhash64(*key, "fy", "fx").alias("region"))
    other = runs.select(*key, F.col("y").alias("_y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("region").alias("_region"))
    beside = runs.where("x0 & 63 = 0").join(other.where("_x1 & 63 = 63").withColumns({"y": F.col("_y"), "x0": F.col("_x1") + 1}).hint("merge"), [*key, "y", "x0"])
    above = runs.where("y & 63 = 0").withColumn("_tx", F.expr("shiftright(x0, 6)"))
    above = above.join(other.where("_y & 63 = 63").withColumns({"y": F.col("_y") + 1, "_tx": F.expr("shiftright(_x0, 6)")}).hint("merge"), [*key, "y", "_tx"]).where("x0 <= _x1 and _x0 <= x1")
    edges = cut(beside.select("region", "_region").unionByName(above.select("region", "_region")).distinct())
    if edges.isEmpty():
        return runs
    joined = connected_components(edges, "region", "_region").withColumnRenamed("node", "region")
    return runs.join(joined.hint("merge"), "region", "left").select(*key, "y", "x0", "x1", F.coalesce("component", "region").alias("region"))


def connected(pixels: DataFrame, key: list[str], seeds: DataFrame) -> DataFrame:
    """G1: (key, connected): whether start (sx, sy) and goal (gx, gy) lie in one region; False off the mask."""
    found = regions(pixels, key).select(*(F.col(k).alias(f"_k_{k}") for k in key), "y", "x0", "x1", "region")
    at = lambda x, y: (F.col("y") == F.col(y)) & F.col(x).between(F.col("x0"), F.col("x1"))
    own = seeds.join(found.hint("merge"), [*(F.col(k) == F.col(f"_k_{k}") for k in key), at("sx", "sy") | at("gx", "gy")], "left")
    one = lambda x, y: F.max(F.when(at(x, y), F.col("region")))
    ends = own.groupBy(*key, "sx", "sy", "gx", "gy").agg(one("sx", "sy").alias("_s"), one("gx", "gy").alias("_e"))
    return ends.select(*key, F.coalesce(F.col("_s") == F.col("_e"), F.lit(False)).alias("connected"))


def region_boxes(found: DataFrame, key: list[str], padding: int, width: int, height: int) -> DataFrame:
    """Padded box of each region, clamped to the image; right and bottom are one further than the last pixel."""
    out = found.groupBy(*key, "region").agg(F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"))
    return out.withColumns({
        "left": F.greatest(F.col("left") - padding, F.lit(0)), "top": F.greatest(F.col("top") - padding, F.lit(0)),
        "right": F.least(F.col("right") + padding + 1, F.lit(width)), "bottom": F.least(F.col("bottom") + padding + 1, F.lit(height)),
    })


def nearest_masked(pixels: DataFrame, key: list[str], points: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Masked pixel nearest to (px, py) by square rings; none beyond the radius.

    The point is rounded half to even and moved onto the image. In a ring its left and right columns, as far as they are on
    the image, are looked down first, side by side; then its top and bottom rows, column by column.
    """
    place = lambda c, size: F.least(F.greatest(F.bround(c).cast("long"), F.lit(0)), F.lit(size - 1))
    own = points.select(*key, place("px", width).alias("_cx"), place("py", height).alias("_cy"))
    near = pixels.join(own, key).withColumn("ring", F.greatest(F.abs(F.col("x") - F.col("_cx")), F.abs(F.col("y") - F.col("_cy")))).where(F.col("ring") <= radius)
    side = (F.col("x") == F.greatest(F.lit(0), F.col("_cx") - F.col("ring"))) | (F.col("x") == F.least(F.lit(width - 1), F.col("_cx") + F.col("ring")))
    order = F.struct("ring", (~side).alias("late"), F.when(side, F.col("y")).otherwise(F.col("x")).alias("first"), F.when(side, F.col("x")).otherwise(F.col("y")).alias("then"), "y", "x")
    return near.groupBy(*key).agg(F.min(order).alias("_n")).select(*key, "_n.ring", "_n.y", "_n.x")


def shortest_paths(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """(grid_id, steps, path) from start to goal over 4-connected open cells of many grids; nulls where there is no way.

    cells: grid_id, y, x of open cells; ends: grid_id, sx, sy, gx, gy; path: array of (y, x), both ends included. Ties go to
    the smallest (y, x).
    """
    start = cells.select("grid_id", paths.pack("y", "x").alias("start")).distinct()
    own = ends.select("grid_id", paths.pack("sy", "sx").alias("start"), paths.pack("gy", "gx").alias("goal"))
    found = paths.shortest_paths(paths.lattice_edges(cells, "grid_id", "y", "x", paths.SQUARE), own.join(start.hint("merge"), ["grid_id", "start"], "left_semi"))
    place = F.transform("path", lambda n: F.struct(paths.unpack(n)[0].alias("y"), paths.unpack(n)[1].alias("x")))
    return ends.select("grid_id").join(found.hint("merge"), "grid_id", "left").select("grid_id", "steps", place.alias("path"))


def stacking_order(pixels: DataFrame, key: list[str], palette: Palette, height: int, near: float = 48.0, light: int = 240, dark: int = 15) -> DataFrame:
    """(key, colours): colours by the first row, from the top, whose mean is within `near` of one not used yet.

    Of the image's rows every height // (6 * colours)-th is looked at. A round for each colour at most, over all images:
    rows below the last hit; near-white, near-black and pixels of used colours are left out.
    """
    step = max(1, height // (len(palette) * 6))
    own = pixels.where(~((F.least(*"rgb") >= light) | (F.greatest(*"rgb") <= dark)) & (F.col("y") % step == 0))
    state = cut(pixels.select(*key).distinct().withColumns({"_y": F.lit(-1).cast("long"), "colours": F.array().cast("array<string>")}))
    of = lambda rgb, k: euclidean(rgb, [F.lit(v) for v in palette[k][1]])
    for _ in palette:
        live = own.join(state, key).where(F.col("y") > F.col("_y"))
        for k, (name, _) in enumerate(palette):
            live = live.where(~(F.array_contains("colours", name) & (of([F.col(c) for c in "rgb"], k) <= near)))
        rows = live.groupBy(*key, "y").agg(*(F.avg(c).alias(c) for c in "rgb"), F.first("colours").alias("colours"))
        scored = [F.when(~F.array_contains("colours", name), F.struct(F.round(of([F.col(c) for c in "rgb"], k), 9).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, _) in enumerate(palette)]
        hits = rows.withColumn("_h", F.array_min(F.array_compact(F.array(*scored)))).where(F.col("_h.d") <= near).groupBy(*key).agg(F.min_by(F.struct("y", F.col("_h.name").alias("name")), "y").alias("_b"))
        if (hits := cut(hits)).isEmpty():
            break
        state = cut(state.join(hits, key, "left").select(*key, F.coalesce(F.col("_b.y"), F.lit(1 << 40)).alias("_y"), F.when(F.col("_b").isNull(), F.col("colours")).otherwise(F.array_append("colours", F.col("_b.name"))).alias("colours")))
    return state.select(*key, "colours")
