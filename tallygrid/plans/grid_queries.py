"""Queries of pixels, grids, geometry, quality rules and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import geometry as G
from tallygrid.functions import pixels as P
from tallygrid.operators import grid, paths, plugins, summary, tiles
from tallygrid.operators.components import cut
from tallygrid.plans import record_queries
from tallygrid.plans.fixtures import duck, fixture, table
from tallygrid.plans.registry import query

PX, TRI, CAND = duck("pixels"), duck("triangles"), duck("candidates")
#: Sparse test images have few red pixels; masks of the queries are wider than those of the scorers.
BRIGHT = "r >= 150"


@query(f"SELECT image_id, count(*) FILTER (r >= 140 AND r - greatest(g, b) >= 40 AND g <= 130 AND b <= 130) AS option_red, count(*) FILTER (r >= 150 AND r - greatest(g, b) >= 70) AS maze_red, count(*) FILTER (r >= 150 AND r - greatest(g, b) >= 80) AS square_red FROM {PX} GROUP BY 1")
def m1_red_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels").groupBy("image_id")
    return own.agg(F.count_if(P.red_option()).alias("option_red"), F.count_if(P.red_maze()).alias("maze_red"), F.count_if(P.red_maze(80)).alias("square_red"))


@query(f"SELECT image_id, count(*) FILTER (greatest(r, g, b) <= 40) AS walls FROM {PX} GROUP BY 1")
def m2_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pixels").groupBy("image_id").agg(F.count_if(P.wall()).alias("walls"))


REF = f"(SELECT image_id, x, y, r AS r0, g AS g0, b AS b0 FROM {PX} WHERE frame_idx = 1)"


@query(f"""SELECT frame_idx, (sum(CAST(floor(sqrt((r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2) * 1e9 + 0.5) AS BIGINT)) + 500000) // 1000000 / 1000 AS euclidean, round(sum(CAST(abs(r - r0) + abs(g - g0) + abs(b - b0) AS DOUBLE)), 3) AS manhattan,
  CAST(count(*) FILTER ((round(0.299 * r + 0.587 * g + 0.114 * b) > 245) <> (round(0.299 * r0 + 0.587 * g0 + 0.114 * b0) > 245)) AS DOUBLE) AS coverage FROM {PX} JOIN {REF} USING (image_id, x, y) GROUP BY 1""")
def m3_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels")
    ref = own.where("frame_idx = 1").select("image_id", "x", "y", *(F.col(c).alias(f"{c}0") for c in "rgb"))
    a, b = [F.col(c) for c in "rgb"], [F.col(f"{c}0") for c in "rgb"]
    return own.join(ref, ["image_id", "x", "y"]).groupBy("frame_idx").agg(*(P.total(P.METRICS[m](a, b), 3).alias(m) for m in ("euclidean", "manhattan", "coverage")))


@query()
def m3_cielab(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels")
    return own.select("image_id", "frame_idx", "x", "y", F.round(P.cielab([F.col(c) for c in "rgb"], [F.lit(255), F.lit(255), F.lit(255)]), 4).alias("to_white"))


@query(f"SELECT image_id, count(*) FILTER (x >= 12 AND x < 36 AND y >= 16 AND y < 32) AS centred, count(*) FILTER (x >= 3 AND x < 9 AND y >= 0 AND y < 40) AS cropped FROM {PX} GROUP BY 1")
def m4_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pixels").groupBy("image_id").agg(F.count_if(P.window(48, 48, size=(24, 16))).alias("centred"), F.count_if(P.window(48, 48, crop=(3, 0, 9, 40))).alias("cropped"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS l, l_quantity + l_linenumber AS r, CAST(l_partkey % 58 AS DOUBLE) AS t, CAST(l_partkey % 58 + l_suppkey % 9 AS DOUBLE) AS d FROM lineitem),
m AS (SELECT *, greatest(0, l + 2) AS il, least(56, r - 2) AS ir, greatest(0, t + 2) AS it, least(60, d - 2) AS ib FROM b),
s AS (SELECT l_orderkey, l_linenumber, round_even((CASE WHEN ir > il THEN il ELSE l END) * 1.25, 0) AS l, round_even((CASE WHEN ir > il THEN ir ELSE r END) * 1.25, 0) AS r,
  round_even((CASE WHEN ib > it THEN it ELSE t END) * 1.5, 0) AS t, round_even((CASE WHEN ib > it THEN ib ELSE d END) * 1.5, 0) AS d FROM m),
c AS (SELECT l_orderkey, l_linenumber, greatest(0, least(69, l)) AS x0, greatest(0, least(89, t)) AS y0, r, d FROM s)
SELECT l_orderkey, l_linenumber, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(greatest(x0 + 1, least(70, r)) AS INTEGER) AS x1, CAST(greatest(y0 + 1, least(90, d)) AS INTEGER) AS y1 FROM c""")
def m5_scaled_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 1 to 7 by 0 to 8 pixels, some beyond the canvas, on one of other proportions."""
    q, y = F.col("l_quantity"), (F.col("l_partkey") % 58).cast("double")
    box = P.scaled_box([q, y, q + F.col("l_linenumber"), y + F.col("l_suppkey") % 9], (56, 60), (70, 90), 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)))


@query(f"SELECT image_id, frame_idx, x, y, CASE WHEN sqrt((r - 30) ** 2 + (g - 60) ** 2 + (b - 90) ** 2) < sqrt((r - 255) ** 2 + (g - 255) ** 2 + (b - 255) ** 2) THEN 'mono' ELSE 'white' END AS label FROM {PX}")
def m6_nearer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pixels").select("image_id", "frame_idx", "x", "y", P.nearer([F.col(c) for c in "rgb"], [F.lit(30), F.lit(60), F.lit(90)]).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(4, round_even(greatest(4, round_even(CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 0.45 WHEN 1 THEN l_quantity * 0.8 ELSE l_quantity * 0.6 END, 0)) * 1.5, 0)) AS INTEGER) AS radius FROM lineitem""")
def m7_safe_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.when(F.col("l_linenumber") % 3 == k, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.safe_radius(part(0), part(1), part(2), F.lit(1.5)).alias("radius"))


@query("SELECT l_orderkey, l_partkey, (l_partkey // 7) * 7 + l_partkey % 7 AS cell, l_partkey // 7 AS row, l_partkey % 7 AS col FROM lineitem")
def m10_cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = P.cell_place(F.col("l_partkey"), 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", P.cell_id(row, col, 7).alias("cell"), row.alias("row"), col.alias("col"))


CENTROID = f"(SELECT image_id, count(*) FILTER ({BRIGHT}) AS n, avg(x) FILTER ({BRIGHT}) AS cx, avg(y) FILTER ({BRIGHT}) AS cy FROM {PX} GROUP BY 1)"


@query(f"SELECT image_id, n, CASE WHEN n >= 20 THEN round(cx, 6) END AS cx, CASE WHEN n >= 20 THEN round(cy, 6) END AS cy FROM {CENTROID}")
def a12_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.centroid(fixture(spark, sf_dir, "pixels"), ["image_id"], F.expr(BRIGHT))
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query(f"""SELECT image_id, frame_idx, diff FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY diff, frame_idx) AS k FROM (SELECT image_id, frame_idx, round(sum(CAST(abs(r - r0) + abs(g - g0) + abs(b - b0) AS DOUBLE)), 6) AS diff
  FROM {PX} JOIN {REF} USING (image_id, x, y) WHERE frame_idx % 2 = 0 AND x >= 8 AND x < 40 AND y >= 8 AND y < 40 GROUP BY 1, 2)) WHERE k = 1""")
def a13_best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels")
    return grid.best_frame(own, own.where("frame_idx = 1"), "manhattan", 2, P.window(48, 48, size=(32, 32)))


@query(f"""SELECT image_id, y // 8 AS row, x // 8 AS col, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, sqrt((avg(r) - 128) ** 2 + (avg(g) - 128) ** 2 + (avg(b) - 128) ** 2) <= 20 AS hit
  FROM {PX} WHERE x % 8 BETWEEN 1 AND 6 AND y % 8 BETWEEN 1 AND 6 GROUP BY 1, 2, 3""")
def a15_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.cell_means(fixture(spark, sf_dir, "pixels"), ["image_id"], 8, 1)
    near = P.euclidean([F.col(c) for c in "rgb"], [F.lit(128)] * 3) <= 20
    return out.withColumn("hit", near).withColumns({c: F.round(c, 6) for c in "rgb"})


@query("SELECT l_orderkey AS puzzle_id, max(l_partkey) % 3 > 0 AS valid FROM lineitem GROUP BY 1")
def a16_valid_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each order; one in three has a row out of place."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("puzzle_id")).agg(F.max("l_partkey").alias("k"))
    cells = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).selectExpr("puzzle_id", "k", "i div 4 as row", "i % 4 as col")
    value = F.expr("if(k % 3 = 0 and row = 1, 1, 0) + 1 + (row % 2 * 2 + row div 2 + col + k) % 4")
    return grid.valid_grids(cells.withColumn("value", value).drop("k"), 4)


@query(f"""WITH p AS (SELECT *, y // 12 * 4 + x // 12 AS piece FROM {PX} WHERE frame_idx = 1),
t AS (SELECT image_id, piece, 1 - avg((least(255, r + (image_id * 7 + piece * 13) % 200) - r) / 765) AS s FROM p GROUP BY 1, 2)
SELECT image_id AS puzzle_id, count(*) FILTER (s >= 0.9) AS correct, count(*) AS total, round(count(*) FILTER (s >= 0.9) / count(*), 9) AS accuracy, round(avg(s), 9) AS similarity FROM t GROUP BY 1""")
def a17_tile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in sixteen pieces, each of them redder than it was, some by too much."""
    own = fixture(spark, sf_dir, "pixels").where("frame_idx = 1").withColumnRenamed("image_id", "puzzle_id").withColumn("piece", F.expr("y div 12 * 4 + x div 12"))
    redder = own.withColumn("r", F.expr("least(255, r + (puzzle_id * 7 + piece * 13) % 200)"))
    pieces = grid.tile_similarity(own, redder, ["puzzle_id", "piece"])
    out = grid.puzzle_accuracy(pieces, "puzzle_id")
    return out.join(pieces.groupBy("puzzle_id").agg(F.round(F.avg("similarity"), 9).alias("similarity")), "puzzle_id").withColumn("accuracy", F.round("accuracy", 9))


@query(f"SELECT image_id, bool_and(least(r, g, b) >= 250) AS clean FROM {PX} WHERE x IN (0, 47) OR y IN (0, 47) GROUP BY 1")
def a19_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.clean_border(fixture(spark, sf_dir, "pixels"), ["image_id"], 48, 48)


EXTENT = "vec_id % 50 - 5 AS n, vec_id % 9 AS k, vec_id % 6 AS m FROM embeddings"


@query(f"""WITH e AS (SELECT vec_id, {EXTENT}), r AS (SELECT *, greatest(7, k) AS bx, greatest(3, 11 - k) AS by_ FROM e)
SELECT vec_id, CAST(CASE WHEN m = 0 AND n > 0 THEN n WHEN m = 5 THEN round_even(n / 2 + 6.5, 0) WHEN m IN (1, 2) AND n > 0 THEN n WHEN m IN (2, 3) THEN bx ELSE 100 END AS BIGINT) AS width,
  CAST(CASE WHEN m = 0 AND n > 0 THEN 9 WHEN m = 5 THEN 5 WHEN m IN (1, 2) AND n > 0 THEN n WHEN m IN (2, 3) THEN by_ ELSE 90 END AS BIGINT) AS height FROM r""")
def a21_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a pair of dimensions (a list or an object), one size, boxes, none of them, or sizes that aren't positive."""
    own = table(spark, sf_dir, "embeddings").selectExpr("vec_id", *EXTENT.removesuffix(" FROM embeddings").split(", "))
    pair = """case m when 0 then concat('[', n, ', "9"]') when 5 then concat('{"width": ', n / 2 + 6.5D, ', "height": 5}') else 'null' end"""
    boxes = "if(m in (2, 3), concat('[[[0, 0, 7, 3], [1, 1, ', k, ', ', 11 - k, '], [9]]]'), 'null')"
    record = own.selectExpr("vec_id", f"""concat('{{"canvas_dimensions": ', {pair}, ', "canvas_size": ', if(m in (1, 2), string(n), 'null'), ', "cell_bboxes": ', {boxes}, '}}') as record""")
    width, height = P.extent("record", (100, 90))
    return record.select("vec_id", width.alias("width"), height.alias("height"))


@query(f"""SELECT image_id, frame_idx, coalesce(min(x) FILTER (d > 90), min(x)) AS left, coalesce(min(y) FILTER (d > 90), min(y)) AS top, coalesce(max(x) FILTER (d > 90), max(x)) AS right, coalesce(max(y) FILTER (d > 90), max(y)) AS bottom
  FROM (SELECT p.*, greatest(abs(p.r - c.r), abs(p.g - c.g), abs(p.b - c.b)) AS d FROM {PX} p JOIN (SELECT image_id, frame_idx, arg_min(r, y * 100 + x) AS r, arg_min(g, y * 100 + x) AS g, arg_min(b, y * 100 + x) AS b FROM {PX} GROUP BY 1, 2) c USING (image_id, frame_idx)) GROUP BY 1, 2""")
def a22_trim_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.trim_box(fixture(spark, sf_dir, "pixels"), ["image_id", "frame_idx"], 90)


POINT = f"(SELECT vec_id, 256 + 40 * CAST(embedding[17] AS DOUBLE) AS px, 256 + 40 * CAST(embedding[18] AS DOUBLE) AS py FROM embeddings)"


@query(f"SELECT vec_id, name FROM (SELECT vec_id, name, row_number() OVER (PARTITION BY vec_id ORDER BY round(sqrt((x - px) ** 2 + (y - py) ** 2), 6), pos) AS k FROM {CAND} JOIN {POINT} USING (vec_id)) WHERE k = 1")
def j6_nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "256 + 40 * cast(embedding[16] as double) as px", "256 + 40 * cast(embedding[17] as double) as py")
    return grid.nearest_candidate(points, fixture(spark, sf_dir, "candidates"), "vec_id")


COLOURS = [("red", (220, 30, 30)), ("green", (40, 180, 60)), ("blue", (40, 60, 220)), ("white", (255, 255, 255)), ("black", (0, 0, 0))]


@query(f"""SELECT image_id, frame_idx, x, y, arg_min(name, d * 10 + k) AS name FROM (SELECT image_id, frame_idx, x, y, name, k, (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2 AS d FROM {PX},
  (VALUES {", ".join(f"('{n}', {k}, {c[0]}, {c[1]}, {c[2]})" for k, (n, c) in enumerate(COLOURS))}) p(name, k, pr, pg, pb)) GROUP BY ALL""")
def j7_nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pixels").select("image_id", "frame_idx", "x", "y", grid.nearest_palette([F.col(c) for c in "rgb"], COLOURS).alias("name"))


@query(f"SELECT DISTINCT image_id, EXISTS (SELECT 1 FROM {PX} w WHERE w.image_id = p.image_id AND w.frame_idx = 2 AND greatest(w.r, w.g, w.b) <= 120 AND EXISTS (SELECT 1 FROM {PX} q WHERE q.image_id = w.image_id AND q.x = w.x AND q.y = w.y AND q.frame_idx = 1 AND {BRIGHT.replace('r', 'q.r')})) AS overlaps FROM {PX} p")
def j8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels")
    red, wall = own.where(f"frame_idx = 1 and {BRIGHT}"), own.where("frame_idx = 2 and greatest(r, g, b) <= 120")
    hit = red.join(wall, ["image_id", "y", "x"], "left_semi").select("image_id").distinct().withColumn("_hit", F.lit(True))
    return own.select("image_id").distinct().join(hit, "image_id", "left").select("image_id", F.coalesce("_hit", F.lit(False)).alias("overlaps"))


@query(f"SELECT p.image_id, c.id AS cell, count(*) AS n FROM {PX} p JOIN (SELECT i AS id, i % 6 * 8 AS x0, i // 6 * 8 AS y0 FROM range(36) t(i)) c ON p.x >= x0 AND p.x < x0 + 8 AND p.y >= y0 AND p.y < y0 + 8 GROUP BY 1, 2")
def j9_cell_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = P.cell_of(F.col("x"), F.col("y"), 8, 8)
    return fixture(spark, sf_dir, "pixels").groupBy("image_id", P.cell_id(row, col, 6).cast("long").alias("cell")).agg(F.count("*").alias("n"))


AREAS = """(SELECT l_suppkey AS image_id, l_linenumber AS area_id, max(l_partkey) AS p, max(l_orderkey) AS o FROM {lineitem} GROUP BY l_suppkey, l_linenumber)"""
BOXES = f"SELECT image_id, area_id, p % 48 - 3.5 AS \"left\", o % 48 - 3.5 AS top, p % 48 - 3.5 + o % 9 + CASE WHEN p % 7 = 0 THEN 60 ELSE 0 END AS \"right\", o % 48 - 3.5 + p % 9 AS bottom FROM {AREAS} WHERE p % 2 = 0"
DISCS = f"SELECT image_id, area_id, p % 48 + 0.25 AS cx, o % 48 AS cy, CASE WHEN o % 7 = 0 THEN 40 ELSE p % 7 END AS radius FROM {AREAS} WHERE p % 2 = 1"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven areas of each image: boxes with a margin of 1.5 and discs, of no size up to more than the image."""
    own = spark.sql("SELECT image_id, area_id, cast(p as double) as p, cast(o as double) as o FROM " + AREAS, lineitem=table(spark, sf_dir, "lineitem"))
    boxes = own.where("p % 2 = 0").selectExpr("image_id", "area_id", "p % 48 - 3.5D as left", "o % 48 - 3.5D as top", "p % 48 - 3.5D + o % 9 + if(p % 7 = 0, 60, 0) as right", "o % 48 - 3.5D + p % 9 as bottom")
    discs = own.where("p % 2 = 1").selectExpr("image_id", "area_id", "p % 48 + 0.25D as cx", "o % 48 as cy", "if(o % 7 = 0, 40D, p % 7) as radius")
    return tiles.box_areas(boxes, 1.5).unionByName(tiles.disc_areas(discs))


IN_AREAS = f"""(SELECT p.*, b.area_id FROM {PX} p JOIN ({BOXES.format(lineitem='lineitem')}) b ON p.image_id = b.image_id AND x >= floor("left" - 1.5) AND x < ceil("right" + 1.5) AND y >= floor(top - 1.5) AND y < ceil(bottom + 1.5)
  UNION ALL SELECT p.*, d.area_id FROM {PX} p JOIN ({DISCS.format(lineitem='lineitem')}) d ON p.image_id = d.image_id AND radius > 0 AND (x - cx) ** 2 + (y - cy) ** 2 <= radius ** 2)"""


@query(f"SELECT image_id, area_id, count(*) AS n, CAST(sum(x * 100 + y) AS BIGINT) AS places FROM {IN_AREAS} GROUP BY 1, 2")
def j9_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of all frames against boxes and discs of any size."""
    found = tiles.inside(fixture(spark, sf_dir, "pixels"), areas(spark, sf_dir), ["image_id"])
    return found.groupBy("image_id", "area_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * 100 + F.col("y")).alias("places"))


@query(f"SELECT image_id, count(*) AS walls FROM {PX} p WHERE greatest(r, g, b) <= 120 AND NOT EXISTS (SELECT 1 FROM {IN_AREAS} a WHERE a.image_id = p.image_id AND a.x = p.x AND a.y = p.y AND a.area_id <= 2) GROUP BY 1")
def j9_suppressed_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls outside the first two areas of their image, which stand for its endpoints."""
    walls = fixture(spark, sf_dir, "pixels").where("greatest(r, g, b) <= 120")
    return tiles.suppressed(walls, areas(spark, sf_dir).where("area_id <= 2"), ["image_id"]).groupBy("image_id").agg(F.count("*").alias("walls"))


MIR = "(SELECT DISTINCT l_suppkey AS grid_id, l_linenumber AS row, l_partkey % 8 AS col, CASE WHEN l_partkey % 8 % 3 = 0 THEN 'blue' ELSE 'red' || l_linenumber END AS colour FROM lineitem)"


@query(f"SELECT a.grid_id, a.row, a.col, a.colour, coalesce(b.colour, 'white') AS expected FROM {MIR} a LEFT JOIN {MIR} b ON a.grid_id = b.grid_id AND a.row = b.row AND b.col = 7 - a.col WHERE a.col >= 4")
def j10_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as grid_id", "l_linenumber as row", "l_partkey % 8 as col", "if(l_partkey % 8 % 3 = 0, 'blue', concat('red', l_linenumber)) as colour").distinct()
    return grid.mirrored(own, 4)


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "candidates").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return own.withColumn("points", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))


NEAR = f"(SELECT DISTINCT a.vec_id FROM {CAND} a JOIN {CAND} b ON a.vec_id = b.vec_id AND a.pos < b.pos WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 20)"


@query(f"SELECT vec_id, vec_id NOT IN (SELECT vec_id FROM {NEAR}) AS spaced FROM embeddings")
def j11_well_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("vec_id", G.well_spaced(F.col("points"), 20.0).alias("spaced"))


@query(f"SELECT vec_id, bool_and(x BETWEEN 150 AND 362 AND y BETWEEN 150 AND 362) AND vec_id NOT IN (SELECT vec_id FROM {NEAR}) AS ok FROM {CAND} GROUP BY vec_id")
def q2_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("vec_id", G.layout_ok(F.col("points"), 512.0, 512.0, 150.0, 20.0).alias("ok"))


def corners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Point, G.Point, G.Point]:
    c = F.col
    return fixture(spark, sf_dir, "triangles"), (c("ax"), c("ay")), (c("bx"), c("by_")), (c("cx"), c("cy"))


SIDES = f"""(SELECT *, sqrt((bx - cx) ** 2 + (by_ - cy) ** 2) AS la, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS lb, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS lc, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS cr FROM {TRI})"""
ANGLES = f"(SELECT *, abs(cr) / 2 AS area, degrees(acos((lb ** 2 + lc ** 2 - la ** 2) / (2 * lb * lc))) AS wa, degrees(acos((la ** 2 + lc ** 2 - lb ** 2) / (2 * la * lc))) AS wb, degrees(acos((la ** 2 + lb ** 2 - lc ** 2) / (2 * la * lb))) AS wc FROM {SIDES})"


@query(f"SELECT vec_id, round(lc, 4) AS side, round(area, 3) AS area, round(wa, 4) AS angle, round(((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / lc ** 2, 5) AS t, round(abs(cr) / lc, 4) AS off FROM {ANGLES}")
def m8_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a, b, c = corners(spark, sf_dir)
    return own.select("vec_id", F.round(G.distance(a, b), 4).alias("side"), F.round(G.area(a, b, c), 3).alias("area"), F.round(G.angle(a, b, c), 4).alias("angle"), F.round(G.projection(c, a, b)[0], 5).alias("t"), F.round(G.line_distance(c, a, b), 4).alias("off"))


@query(f"""SELECT vec_id, round((ax + bx + cx) / 3, 4) AS gx, round(la * lb * lc / (2 * abs(cr)), 3) AS radius, round(abs(cr) / (la + lb + lc), 4) AS inradius, round((la * ax + lb * bx + lc * cx) / (la + lb + lc), 4) AS ix,
  round(ax + ((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / lc ** 2 * (bx - ax), 4) AS foot_x, true AS orthogonal FROM {SIDES}""")
def m9_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a, b, c = corners(spark, sf_dir)
    hx, hy = G.orthocentre(a, b, c)
    dot = (hx - a[0]) * (c[0] - b[0]) + (hy - a[1]) * (c[1] - b[1])
    size = G.distance((hx, hy), a) * G.distance(b, c)
    return own.select(
        "vec_id", F.round(G.centroid(a, b, c)[0], 4).alias("gx"), F.round(G.circumcentre(a, b, c)[2], 3).alias("radius"), F.round(G.incentre(a, b, c)[2], 4).alias("inradius"),
        F.round(G.incentre(a, b, c)[0], 4).alias("ix"), F.round(G.altitude_foot(c, a, b)[0], 4).alias("foot_x"), (F.abs(dot) <= 1e-6 * size + 1e-6).alias("orthogonal"),
    )


@query(f"""SELECT vec_id, CASE WHEN area < 0.0003 * 512 * 512 THEN 'area' WHEN least(la, lb, lc) < 0.05 * 512 THEN 'side' WHEN 2 * area / greatest(la, lb, lc) < 0.04 * 512 THEN 'altitude' WHEN least(wa, wb, wc) < 20 THEN 'smallest angle'
  WHEN greatest(wa, wb, wc) > 120 THEN 'largest angle' WHEN wa BETWEEN 85 AND 95 OR wb BETWEEN 85 AND 95 OR wc BETWEEN 85 AND 95 THEN 'forbidden angle' END AS reason FROM {ANGLES}""")
def q1_triangle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a, b, c = corners(spark, sf_dir)
    return own.select("vec_id", G.triangle_reject(a, b, c, 512.0, 0.05, 0.0003, 0.04, 20.0, 120.0, ((85.0, 95.0),)).alias("reason"))


@query(f"""SELECT vec_id, best, best = substr('ABCDE', CAST(vec_id % 5 AS INTEGER) + 1, 1) AS ok FROM (SELECT vec_id, name AS best, row_number() OVER (PARTITION BY vec_id ORDER BY round(sqrt((x - gx) ** 2 + (y - gy) ** 2), 6), pos) AS k
  FROM {CAND} JOIN (SELECT vec_id, (ax + bx + cx) / 3 AS gx, (ay + by_ + cy) / 3 AS gy FROM {TRI}) USING (vec_id)) WHERE k = 1""")
def q3_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a, b, c = corners(spark, sf_dir)
    x, y = G.centroid(a, b, c)
    best = grid.nearest_candidate(own.select("vec_id", x.alias("px"), y.alias("py")), fixture(spark, sf_dir, "candidates"), "vec_id")
    return best.select("vec_id", F.col("name").alias("best"), (F.col("name") == F.expr("substr('ABCDE', cast(vec_id % 5 as int) + 1, 1)")).alias("ok"))


@query(f"""SELECT vec_id, rule FROM (SELECT vec_id, unnest([CASE WHEN least(la, lb, lc) < 0.22 * 512 THEN 'side' END, CASE WHEN area < 0.045 * 512 * 512 THEN 'area' END, CASE WHEN least(wa, wb, wc) < 33 THEN 'small_angle' END,
  CASE WHEN greatest(wa, wb, wc) > 110 THEN 'large_angle' END, CASE WHEN abs(wa - 90) < 8 OR abs(wb - 90) < 8 OR abs(wc - 90) < 8 THEN 'right_angle' END,
  CASE WHEN least(lc, lb) < 0.2 * 512 THEN 'leg' END, CASE WHEN greatest(lc, lb) / least(lc, lb) > 1.35 THEN 'ratio' END]) AS rule FROM {ANGLES}) WHERE rule IS NOT NULL""")
def q4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a, b, c = corners(spark, sf_dir)
    rules = G.triangle_violations(a, b, c, 512.0, "orthocenter") | G.polygon_violations([a, b, c], 512.0, "right_triangle")
    broken = F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items())))
    return own.select("vec_id", F.explode(broken).alias("rule"))


def rule_sql() -> str:
    """The rules written out over the angles' columns and those of the polygon a, b, c, d."""
    three = {"side": "least(la, lb, lc)", "area": "area", "small_angle": "least(wa, wb, wc)", "large_angle": "greatest(wa, wb, wc)", "right_angle": "least(abs(wa - 90), abs(wb - 90), abs(wc - 90))", "opening": "wb", "leg": "least(lc, lb)", "ratio": "greatest(lc, lb) / least(lc, lb)"}
    four = {"side": "least(lc, la, ld, le)", "area": "quad", "top": "ld"}
    out = []
    for task, measure, side, limit, power in G.QUALITY_RULES:
        value = (four if task in ("parallelogram", "isosceles_trapezoid", "square_outlier") else three)[measure]
        out.append(f"CASE WHEN {value} {'<' if side == 'below' else '>'} {limit} * {512**power} THEN '{task}/{measure}/{side}' END")
    return f"""SELECT vec_id, rule FROM (SELECT vec_id, unnest([{', '.join(out)}]) AS rule FROM (SELECT *, sqrt((cx - dx) ** 2 + (cy - dy) ** 2) AS ld, sqrt((ax - dx) ** 2 + (ay - dy) ** 2) AS le,
      abs(ax * by_ - bx * ay + bx * cy - cx * by_ + cx * dy - dx * cy + dx * ay - ax * dy) / 2 AS quad FROM {ANGLES})) WHERE rule IS NOT NULL"""


@query(rule_sql())
def q4_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine rule sets, as a table that is joined to the measures."""
    own, a, b, c = corners(spark, sf_dir)
    d = (F.col("dx"), F.col("dy"))
    polygons = ("parallelogram", "isosceles_trapezoid", "square_outlier")
    shapes = {t: [a, b, c, d] if t in polygons else [a, b, c] for t in dict.fromkeys(r[0] for r in G.QUALITY_RULES)}
    return G.broken_rules(own, ["vec_id"], shapes, 512.0).select("vec_id", F.concat_ws("/", "task", "measure", "side").alias("rule"))


MASK = f"(SELECT DISTINCT image_id, y, x FROM {PX} WHERE {BRIGHT} OR g >= 100)"


def first_to_last(pixels: DataFrame) -> DataFrame:
    """Whether the first and the last masked pixel of each image are connected."""
    own = cut(pixels.where(f"{BRIGHT} or g >= 100").select("image_id", "y", "x"))
    ends = own.groupBy("image_id").agg(F.min(F.expr("y * 100 + x")).alias("a"), F.max(F.expr("y * 100 + x")).alias("b"))
    seeds = ends.selectExpr("image_id", "a % 100 as sx", "a div 100 as sy", "b % 100 as gx", "b div 100 as gy")
    return grid.connected(own, ["image_id"], seeds)


@query()
def g1_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over all images, for which recursive SQL is too slow."""
    return first_to_last(fixture(spark, sf_dir, "pixels"))


def bright_boxes(pixels: DataFrame) -> DataFrame:
    key = ["image_id", "frame_idx"]
    return grid.region_boxes(grid.regions(pixels.where(BRIGHT), key), key, 2, 48, 48).drop("region")


@query()
def a18_region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 over all frames of all images, for which recursive SQL is too slow."""
    return bright_boxes(fixture(spark, sf_dir, "pixels"))


@query(f"""WITH p AS (SELECT image_id, image_id * 7 % 60 - 6 + 0.5 AS px, image_id * 11 % 56 - 4 + 0.5 AS py FROM (SELECT DISTINCT image_id FROM {PX})),
c AS (SELECT image_id, least(47, greatest(0, CAST(round_even(px, 0) AS BIGINT))) AS cx, least(47, greatest(0, CAST(round_even(py, 0) AS BIGINT))) AS cy FROM p),
n AS (SELECT DISTINCT image_id, y, x, cx, cy, greatest(abs(x - cx), abs(y - cy)) AS ring FROM {PX} JOIN c USING (image_id) WHERE {BRIGHT}),
o AS (SELECT *, x = greatest(0, cx - ring) OR x = least(47, cx + ring) AS side FROM n WHERE ring <= 9)
SELECT image_id, ring, y, x FROM o QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ring, side DESC, CASE WHEN side THEN y ELSE x END, CASE WHEN side THEN x ELSE y END) = 1""")
def g2_nearest_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a point of each image, some of them off the image."""
    own = fixture(spark, sf_dir, "pixels")
    points = own.select("image_id").distinct().selectExpr("image_id", "image_id * 7 % 60 - 6 + 0.5D as px", "image_id * 11 % 56 - 4 + 0.5D as py")
    return grid.nearest_masked(own.where(BRIGHT), ["image_id"], points, 9, 48, 48)


OPEN = "(SELECT DISTINCT l_suppkey AS grid_id, l_partkey % 12 AS y, l_orderkey % 12 AS x FROM lineitem WHERE (l_partkey % 12 * 7 + l_orderkey % 12 * 5 + l_suppkey) % 4 > 0)"


@query(f"""WITH RECURSIVE o AS (SELECT * FROM {OPEN}), w(grid_id, y, x, d) AS (SELECT grid_id, min(y * 100 + x) // 100, min(y * 100 + x) % 100, 0 FROM o GROUP BY 1
  UNION SELECT o.grid_id, o.y, o.x, d + 1 FROM w JOIN o ON o.grid_id = w.grid_id AND abs(o.y - w.y) + abs(o.x - w.x) = 1 WHERE d < 60)
SELECT e.grid_id, CAST(min(d) AS INTEGER) AS steps FROM (SELECT grid_id, max(y * 100 + x) AS k FROM o GROUP BY 1) e LEFT JOIN w ON w.grid_id = e.grid_id AND w.y * 100 + w.x = k GROUP BY 1""")
def g3_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).select("grid_id", "steps")


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as grid_id", "l_partkey % 12 as y", "l_orderkey % 12 as x").where("(y * 7 + x * 5 + grid_id) % 4 > 0").distinct()
    ends = own.groupBy("grid_id").agg(F.min(F.expr("y * 100 + x")).alias("a"), F.max(F.expr("y * 100 + x")).alias("b"))
    return grid.shortest_paths(own, ends.selectExpr("grid_id", "a % 100 as sx", "a div 100 as sy", "b % 100 as gx", "b div 100 as gy"))


@query()
def g3_path_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 with the cell ids of each path; ties of equally short paths aren't settled alike in SQL."""
    cells = F.transform("path", lambda c: P.cell_id(c["y"], c["x"], 12).cast("string"))
    return solved(spark, sf_dir).select("grid_id", "steps", F.array_join(cells, ",").alias("cells"))


HEX = "(SELECT DISTINCT l_suppkey AS grid_id, l_partkey % 12 - 6 AS q, l_orderkey % 12 - 6 AS r FROM lineitem WHERE (l_partkey + l_orderkey * 3 + l_suppkey) % 5 > 1)"


@query(f"""WITH RECURSIVE o AS (SELECT * FROM {HEX}), w(grid_id, q, r, d) AS (SELECT grid_id, min(q * 100 + r + 50) // 100 - CASE WHEN min(q * 100 + r + 50) < 0 AND min(q * 100 + r + 50) % 100 <> 0 THEN 1 ELSE 0 END, (min(q * 100 + r + 50) % 100 + 100) % 100 - 50, 0 FROM o GROUP BY 1
  UNION SELECT o.grid_id, o.q, o.r, d + 1 FROM w JOIN o ON o.grid_id = w.grid_id AND greatest(abs(o.q - w.q), abs(o.r - w.r), abs(o.q + o.r - w.q - w.r)) = 1 WHERE d < 60)
SELECT e.grid_id, CAST(min(d) AS INTEGER) AS steps FROM (SELECT grid_id, max(q * 100 + r) AS k FROM o GROUP BY 1) e LEFT JOIN w ON w.grid_id = e.grid_id AND w.q * 100 + w.r = k GROUP BY 1""")
def g3_hexagon_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last open hexagon of each supplier's maze, in axial coordinates."""
    own = hexagons(spark, sf_dir)
    ends = own.groupBy("grid_id").agg(F.min(paths.pack("q", "r")).alias("start"), F.max(paths.pack("q", "r")).alias("goal"))
    return paths.shortest_paths(paths.lattice_edges(own, "grid_id", "q", "r", paths.HEXAGON), ends).select("grid_id", "steps")


def hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").where("(l_partkey + l_orderkey * 3 + l_suppkey) % 5 > 1")
    return own.selectExpr("l_suppkey as grid_id", "l_partkey % 12 - 6 as q", "l_orderkey % 12 - 6 as r").distinct()


RINGS = "(SELECT s_suppkey AS grid_id, k AS ring, CASE WHEN k = 0 THEN 1 ELSE 3 + (s_suppkey + k * k) % 7 END AS cells FROM supplier, range(6) t(k))"


@query(f"""WITH RECURSIVE c AS (SELECT grid_id, ring, cells AS n, unnest(range(cells)) AS i FROM {RINGS}),
e AS (SELECT grid_id, ring * 100 + i AS a, ring * 100 + (i + 1) % n AS b FROM c WHERE n > 1
  UNION SELECT c.grid_id, c.ring * 100 + c.i, o.ring * 100 + o.i FROM c JOIN c o ON o.grid_id = c.grid_id AND o.ring = c.ring + 1 AND c.i * o.n < (o.i + 1) * c.n AND o.i * c.n < (c.i + 1) * o.n),
p AS (SELECT * FROM (SELECT grid_id, a, b FROM e UNION SELECT grid_id, b, a FROM e) WHERE (least(a, b) * 3 + greatest(a, b) * 5 + grid_id) % 3 > 0),
w(grid_id, v, d) AS (SELECT DISTINCT grid_id, 0, 0 FROM c UNION SELECT p.grid_id, p.b, d + 1 FROM w JOIN p ON p.grid_id = w.grid_id AND p.a = w.v WHERE d < 40)
SELECT g.grid_id, CAST(min(d) AS INTEGER) AS steps FROM (SELECT DISTINCT grid_id FROM c) g LEFT JOIN w ON w.grid_id = g.grid_id AND w.v = 501 GROUP BY 1""")
def g3_ring_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the centre to the second cell of the outermost ring, through the passages that each supplier's labyrinth has left."""
    rings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), F.explode(F.expr("sequence(0L, 5L)")).alias("ring"))
    edges = paths.ring_edges(rings.withColumn("cells", F.expr("if(ring = 0, 1, 3 + (grid_id + ring * ring) % 7)")), "grid_id")
    name = lambda c: paths.unpack(c)[0] * 100 + paths.unpack(c)[1]
    edges = edges.where((F.least(name("a"), name("b")) * 3 + F.greatest(name("a"), name("b")) * 5 + F.col("grid_id")) % 3 > 0)
    ends = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), paths.pack(F.lit(0), F.lit(0)).alias("start"), paths.pack(F.lit(5), F.lit(1)).alias("goal"))
    return paths.shortest_paths(edges, ends).select("grid_id", "steps")


@query()
def g4_stacking_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every frame; a round for each colour."""
    key = ["image_id", "frame_idx"]
    out = grid.stacking_order(fixture(spark, sf_dir, "pixels"), key, [c for c in COLOURS if c[0] not in ("white", "black")], 48, near=110.0)
    return out.select(*key, F.array_join("colours", ",").alias("colours"))


@query(record_queries.A1_BY_GROUP)
def x1_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer of each group, the rows united and summed up."""
    own = record_queries.explicit(record_queries.channel_votes(spark, sf_dir)).withColumn("error", F.lit(""))
    return plugins.score(own, ["task_group", "offline_pass", "error"]).groupBy("task_group").agg(*summary.run_columns())


@query(f"""SELECT metric, round(d, 3) AS d FROM (SELECT sum(sqrt((r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2)) AS euclidean, sum(CAST(abs(r - r0) + abs(g - g0) + abs(b - b0) AS DOUBLE)) AS manhattan,
  CAST(count(*) FILTER ((round(0.299 * r + 0.587 * g + 0.114 * b) > 245) <> (round(0.299 * r0 + 0.587 * g0 + 0.114 * b0) > 245)) AS DOUBLE) AS coverage FROM {PX} JOIN {REF} USING (image_id, x, y)) UNPIVOT (d FOR metric IN (euclidean, manhattan, coverage))""")
def x4_metrics_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "pixels")
    ref = own.where("frame_idx = 1").select("image_id", "x", "y", *(F.col(c).alias(f"{c}0") for c in "rgb"))
    a, b, names = [F.col(c) for c in "rgb"], [F.col(f"{c}0") for c in "rgb"], ["euclidean", "manhattan", "coverage"]
    sums = own.join(ref, ["image_id", "x", "y"]).agg(*(P.total(P.distance(m, a, b), 3).alias(m) for m in names))
    return sums.unpivot([], names, "metric", "d")
