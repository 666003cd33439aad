"""Queries over whole tables against brute force and their twins."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from tallygrid.operators import grid, paths, tiles
from tallygrid.plans.fixtures import fixture
from test_queries import duck, test_same_rows as same_rows  # noqa: F401  a fixture


def areas(cells):
    """4-connected regions of a set of (y, x)."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
            left -= near
            own |= near
            todo += near
        out.append(own)
    return out


def test_regions_of_all_images(spark):
    masked, bright, images = defaultdict(set), defaultdict(set), set()
    for r in fixture(spark, DATA, "pixels").collect():
        images.add(r.image_id)
        if r.r >= 150 or r.g >= 100:
            masked[r.image_id].add((r.y, r.x))
        if r.r >= 150:
            bright[r.image_id, r.frame_idx].add((r.y, r.x))
    assert len(images) > 3 and len(bright) > 3 * len(images)
    found = {r.image_id: r.connected for r in entry.queries()["g1_connected"](spark, DATA).collect()}
    assert found == {k: any(min(own) in a and max(own) in a for a in areas(own)) for k, own in masked.items()}
    boxes = sorted(tuple(r[c] for c in ("image_id", "frame_idx", "left", "top", "right", "bottom")) for r in entry.queries()["a18_region_boxes"](spark, DATA).collect())
    ys, xs = (lambda a: [y for y, _ in a]), (lambda a: [x for _, x in a])
    assert boxes == sorted((*k, max(min(xs(a)) - 2, 0), max(min(ys(a)) - 2, 0), min(max(xs(a)) + 3, 48), min(max(ys(a)) + 3, 48)) for k, own in bright.items() for a in areas(own))


def test_regions_across_tiles(spark):
    """Areas of images larger than a tile, from noise to stripes and a spiral, some left of and above 0."""
    rng = random.Random(6)
    images = {k: {(y, x) for y in range(-70, 140) for x in range(-10, 75) if rng.random() < 0.3 + k / 10} for k in range(4)}
    images[4] = {(y, x) for y in range(130) for x in range(150) if x % 2 == 0 or y == (0 if x % 4 == 1 else 129)}
    images[5] = {(0, 63), (0, 64), (63, 10), (64, 10), (63, 63), (64, 64)}
    pixels = spark.createDataFrame([(k, y, x) for k, own in images.items() for y, x in own], "k int, y int, x int")
    found = defaultdict(lambda: defaultdict(set))
    for r in grid.regions(pixels.unionByName(pixels.where("x % 3 = 0")), ["k"]).collect():
        found[r.k][r.region] |= {(r.y, x) for x in range(r.x0, r.x1 + 1)}
    for k, own in images.items():
        assert sorted(map(sorted, found[k].values())) == sorted(map(sorted, areas(own)))
    seeds = spark.createDataFrame([(4, 0, 0, 148, 129), (5, 63, 63, 64, 64), (5, 63, 0, 64, 0), (9, 0, 0, 0, 0)], "k int, sx int, sy int, gx int, gy int")
    assert sorted((r.k, r.connected) for r in grid.connected(pixels, ["k"], seeds).collect()) == [(4, True), (5, False), (5, True), (9, False)]


def test_regions_inside_tiles_need_no_graph(spark, monkeypatch):
    monkeypatch.setattr(grid, "connected_components", None)
    pixels = spark.createDataFrame([(k, y, x) for k in range(3) for y in range(48) for x in range(48) if (y + x) % (k + 2)], "k int, y int, x int")
    assert {r.k: r.n for r in grid.regions(pixels, ["k"]).groupBy("k").agg(F.count_distinct("region").alias("n")).collect()} == {k: len(areas({(y, x) for y in range(48) for x in range(48) if (y + x) % (k + 2)})) for k in range(3)}


def test_nearest_masked_looks_down_the_sides_first(spark):
    """Ring by ring: left and right columns from the top, then top and bottom rows from the left, on the image only."""
    rng = random.Random(9)
    size, masks = 12, {k: {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(0, 9))} for k in range(60)}
    points = {k: (rng.choice([-3, 0, 2.5, 3.5, 6, 11.4, 14]), rng.choice([-1, 0.5, 5, 7, 11, 30])) for k in masks}

    def walk(mask, px, py):
        cx, cy = (max(0, min(size - 1, round(v))) for v in (px, py))
        for d in range(5):
            left, right, top, bottom = max(0, cx - d), min(size - 1, cx + d), max(0, cy - d), min(size - 1, cy + d)
            ways = [(y, x) for y in range(top, bottom + 1) for x in (left, right)] + [(y, x) for x in range(left + 1, right) for y in (top, bottom)]
            if hit := next((p for p in ways if p in mask), None):
                return hit

    pixels = spark.createDataFrame([(k, y, x) for k, m in masks.items() for y, x in m], "k int, y long, x long")
    given = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in points.items()], "k int, px double, py double")
    found = {r.k: (r.y, r.x) for r in grid.nearest_masked(pixels, ["k"], given, 4, size, size).collect()}
    assert found == {k: p for k, m in masks.items() if (p := walk(m, *points[k]))}


def test_stacking_order_row_by_row(spark):
    rng = random.Random(4)
    palette = [("red", (220, 30, 30)), ("green", (40, 180, 60)), ("blue", (40, 60, 220))]
    shades = [c for _, c in palette] + [(242, 250, 241), (14, 3, 15), (120, 120, 120), (240, 239, 240), (15, 16, 2)]
    images = {k: [[tuple(v + rng.choice([0, 9, 15]) * (k % 2) for v in rng.choice(shades[: 3 + k % 6])) for _ in range(4)] for _ in range(40)] for k in range(25)}
    for rows in images.values():
        for y in range(0, 40, 5):
            rows[y : y + 5] = [[rng.choice(shades)] * 4] * 5

    def order(rows):
        free, out = dict(palette), []
        gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b)) ** 0.5
        for y in range(0, 40, max(1, 40 // 18)):
            own = [p for p in rows[y] if not min(p) >= 240 and not max(p) <= 15 and all(gap(p, c) > 48 for n, c in palette if n in out)]
            if own and free:
                mean = [sum(v) / len(own) for v in zip(*own)]
                name = min(free, key=lambda n: gap(mean, free[n]))
                if gap(mean, free[name]) <= 48:
                    out.append(name)
                    del free[name]
        return out

    pixels = spark.createDataFrame([(k, y, x, *p) for k, rows in images.items() for y, row in enumerate(rows) for x, p in enumerate(row)], "k int, y long, x long, r int, g int, b int")
    found = {r.k: r.colours for r in grid.stacking_order(pixels, ["k"], palette, 40).collect()}
    assert found == {k: order(rows) for k, rows in images.items()} and len({tuple(v) for v in found.values()}) > 3


@pytest.mark.parametrize("name", ["r2_path_reward", "t24_solution_text", "j12_sequences", "w8_ordered_dedupe", "s2_stacking"])
def test_paths_of_all_orders(spark, duck, name):  # noqa: F811
    same_rows(spark, duck, name)
    orders = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert entry.queries()[name](spark, DATA).select("path_id").distinct().count() == orders


def test_texts_of_all_languages_collapse(spark, duck):  # noqa: F811
    same_rows(spark, duck, "t4_collapse")
    assert entry.queries()["t4_collapse"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_cells_of_shortest_paths(spark):
    """Steps as by a breadth first search; paths of neighbouring open cells, with the smallest parent on ties."""
    rng = random.Random(5)
    open_cells = {g: {(y, x) for y in range(5) for x in range(5) if (y, x) in ((0, 0), (4, 4)) or rng.random() < 0.7} for g in range(12)}
    open_cells[12] = {(0, 0)}
    ends = [(g, 0, 0, 4, 4) if g < 12 else (g, 0, 0, 0, 0) for g in open_cells]

    def one(cells, goal):
        parent, front = {(0, 0): None}, [(0, 0)]
        while front and goal not in parent:
            new = {}
            for y, x in sorted(front):
                for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if c in cells and c not in parent:
                        new.setdefault(c, (y, x))
            parent |= new
            front = list(new)
        if goal not in parent:
            return None
        path = [goal]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        return path[::-1]

    cells = spark.createDataFrame([(g, y, x) for g, own in open_cells.items() for y, x in own], "grid_id int, y int, x int")
    found = grid.shortest_paths(cells, spark.createDataFrame(ends, "grid_id int, sx int, sy int, gx int, gy int")).collect()
    expected = {g: one(own, (4, 4) if g < 12 else (0, 0)) for g, own in open_cells.items()}
    assert len(found) == len(expected) and None in expected.values()
    assert {r.grid_id: r.path and [(c.y, c.x) for c in r.path] for r in found} == expected
    assert all(r.steps == (len(r.path) - 1 if r.path else None) for r in found)


def test_path_cells_of_the_query(spark):
    for r in entry.queries()["g3_path_cells"](spark, DATA).collect():
        ids = [int(c) for c in r.cells.split(",")] if r.cells else []
        assert len(ids) == (0 if r.steps is None else r.steps + 1)
        assert all(abs(a // 12 - b // 12) + abs(a % 12 - b % 12) == 1 for a, b in zip(ids, ids[1:]))


@pytest.mark.parametrize("small", [1 << 16, 0])
def test_paths_in_hexagons_and_rings(spark, small):
    """Steps and nodes as by a breadth first search with the smallest parent on ties, in one task and by joins."""
    rng = random.Random(3)
    hexes = {g: {(q, r) for q in range(-3, 4) for r in range(-3, 4) if rng.random() < 0.75 or (q, r) in ((-3, -3), (3, 3))} for g in range(6)}
    edges = defaultdict(lambda: defaultdict(list))
    number = lambda a, b: a * (1 << 32) + b + (1 << 31)
    for g, cells in hexes.items():
        for q, r in cells:
            edges[g][number(q, r)] += [number(q + i, r + j) for i, j in paths.HEXAGON if (q + i, r + j) in cells]
    rings = {10: [1, 3, 6, 6, 5], 11: [1, 1, 2, 8], 12: [2, 7]}
    for g, counts in rings.items():
        for ring, n in enumerate(counts):
            for i in range(n):
                if n > 1:
                    edges[g][number(ring, i)] += [number(ring, (i + 1) % n), number(ring, (i - 1) % n)]
                if ring + 1 < len(counts):
                    m = counts[ring + 1]
                    for t in range(i * m // n, -(-(i + 1) * m // n)):
                        edges[g][number(ring, i)].append(number(ring + 1, t))
                        edges[g][number(ring + 1, t)].append(number(ring, i))
    own = paths.lattice_edges(spark.createDataFrame([(g, q, r) for g, c in hexes.items() for q, r in c], "grid_id int, q int, r int"), "grid_id", "q", "r", paths.HEXAGON)
    own = own.unionByName(paths.ring_edges(spark.createDataFrame([(g, k, n) for g, c in rings.items() for k, n in enumerate(c)], "grid_id int, ring int, cells int"), "grid_id"))
    got = defaultdict(lambda: defaultdict(set))
    for r in own.collect():
        got[r.grid_id][r.a].add(r.b)
    assert {g: dict(e) for g, e in got.items()} == {g: {a: set(b) for a, b in e.items() if b} for g, e in edges.items()}
    ends = [(g, number(-3, -3), number(3, 3)) for g in hexes] + [(g, number(0, 0), number(len(c) - 1, 2 % c[-1])) for g, c in rings.items()] + [(20, 5, 5), (21, 5, 6)]
    found = {r.grid_id: r.path for r in paths.shortest_paths(own, spark.createDataFrame(ends, "grid_id int, start long, goal long"), small=small).collect()}
    assert found == {g: paths.breadth_first(edges[g], a, b) or None for g, a, b in ends[:-2]} | {20: [5], 21: None}
    assert any(found[g] is None for g in hexes) or all(len(found[g]) > 5 for g in hexes)


def test_long_paths_back_by_doubling(spark):
    """A way of 40 steps beside one of 41, of which the joins take the shorter, and graphs that end early."""
    ring = [(1, k, (k + 1) % 81) for k in range(81)] + [(2, 0, 1), (2, 1, 2)]
    edges = spark.createDataFrame(ring + [(g, b, a) for g, a, b in ring], "grid_id int, a long, b long")
    found = {r.grid_id: (r.steps, r.path) for r in paths.shortest_paths(edges, spark.createDataFrame([(1, 0, 40), (2, 0, 2)], "grid_id int, start long, goal long"), small=1).collect()}
    assert found == {1: (40, list(range(41))), 2: (2, [0, 1, 2])}


def test_pixels_in_areas_of_any_size(spark):
    rng = random.Random(8)
    pixels = [(k, y, x) for k in (1, 2) for y in range(-3, 40) for x in range(0, 70) if rng.random() < 0.5]
    boxes = [(k, a, rng.uniform(-20, 60), rng.uniform(-20, 40)) for k in (1, 2, 3) for a in range(12)]
    boxes = [(k, a, x, y, x + rng.choice([0, 0.3, 7.5, 16, 200]), y + rng.choice([0.2, 9, 64])) for k, a, x, y in boxes] + [(1, 50, None, 0.0, 5.0, 5.0), (1, 51, 9.0, 9.0, 2.0, 2.0)]
    discs = [(k, 100 + a, rng.uniform(-5, 70), rng.uniform(-5, 40), rng.choice([0.0, -2.0, 0.4, 3.0, 8.0, 90.0])) for k in (1, 2) for a in range(10)] + [(2, 150, 5.0, 5.0, None)]
    areas = tiles.box_areas(spark.createDataFrame(boxes, "k int, area int, left double, top double, right double, bottom double"), 1.5)
    areas = areas.unionByName(tiles.disc_areas(spark.createDataFrame(discs, "k int, area int, cx double, cy double, radius double")))
    own = spark.createDataFrame(pixels, "k int, y long, x long")
    want = {(k, a, y, x) for k, y, x in pixels for j, a, l, t, r, b in boxes if j == k and l is not None and math.floor(l - 1.5) <= x < math.ceil(r + 1.5) and math.floor(t - 1.5) <= y < math.ceil(b + 1.5)}
    want |= {(k, a, y, x) for k, y, x in pixels for j, a, cx, cy, r in discs if j == k and r and r > 0 and (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    found = [(r.k, r.area, r.y, r.x) for r in tiles.inside(own, areas, ["k"]).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    some = areas.where("area < 2 or area > 108")
    hit = {(k, y, x) for k, a, y, x in want if a < 2 or a > 108}
    assert sorted(r[:] for r in tiles.suppressed(own, some, ["k"]).collect()) == sorted(set(pixels) - hit)
    assert tiles.inside(own, areas.limit(0), ["k"]).count() == 0
    plan = tiles.inside(own, areas, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_markers_of_endpoints(spark):
    """The box of the region around a seed, padded and clamped."""
    rows = ["##..#", "#...#", "....#"]
    pixels = spark.createDataFrame([(1, y, x) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"], "k int, y long, x long")
    seeds = spark.createDataFrame([(1, 1, 0), (1, 2, 2)], "k int, y long, x long")
    found = tiles.marker_boxes(grid.regions(pixels, ["k"]), seeds, ["k"], 4, 5, 9)
    assert [(r.left, r.top, r.right, r.bottom) for r in found.collect()] == [(0, 0, 4, 4)]
