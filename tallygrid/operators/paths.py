"""Shortest paths in many graphs at once, over edge tables: square grids, hexagons, rings or any passages.

Graphs of a bounded size are searched in one task each. All larger ones advance one step a round. Edges go both ways, so what a layer can reach lies in the layer before it, in itself or
ahead, and a round looks at the last two layers only. Each layer is written once, to a folder of its own; edges are written in
buckets of their start, so that a round shuffles the frontier and not the edges. The way back is found by pointer doubling:
with L steps in log2(L) rounds of joins, not L.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.components import cut, shared_path
from tallygrid.shipping import ship

# Steps to the six neighbours of a hexagon in axial coordinates.
HEXAGON = [(1, -1), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1)]
SQUARE = [(1, 0), (-1, 0), (0, 1), (0, -1)]
_HALF, _WHOLE = 1 << 31, 1 << 32


def pack(first: str | Column, second: str | Column) -> Column:
    """A node's number from its two coordinates, each of 32 bits; numbers stand in the order of (first, second)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (first, second))
    return a.cast("long") * _WHOLE + b.cast("long") + _HALF


def unpack(node: str | Column) -> tuple[Column, Column]:
    n = F.col(node) if isinstance(node, str) else node
    first = F.shiftright(n, 32)
    return first, n - first * _WHOLE - _HALF


def lattice_edges(cells: DataFrame, key: str, first: str, second: str, steps: list[tuple[int, int]]) -> DataFrame:
    """(key, a, b): open cells that are one of the steps apart, both ways; the steps must hold the opposite of each."""
    own = cells.select(key, F.col(first).cast("long").alias("_i"), F.col(second).cast("long").alias("_j")).distinct()
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    near = own.withColumn("_m", moves).select(key, pack("_i", "_j").alias("a"), pack(F.col("_i") + F.col("_m.i"), F.col("_j") + F.col("_m.j")).alias("b"))
    return near.join(own.select(key, pack("_i", "_j").alias("b")).hint("merge"), [key, "b"], "left_semi").select(key, "a", "b")


def ring_edges(rings: DataFrame, key: str) -> DataFrame:
    """(key, a, b): neighbours in a maze of rings (key, ring, cells): along each ring, and between rings where two cells' arcs
    overlap, both ways. A node is pack(ring, place)."""
    own = rings.select(key, F.col("ring").cast("long").alias("ring"), F.col("cells").cast("long").alias("n")).where("n > 0")
    cells = own.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    along = cells.where("n > 1").select(key, pack("ring", "i").alias("a"), pack("ring", F.expr("(i + 1) % n")).alias("b"))
    outer = own.select(key, (F.col("ring") - 1).alias("ring"), F.col("n").alias("m"))
    across = cells.join(outer.hint("merge"), [key, "ring"]).withColumn("t", F.explode(F.expr("sequence(i * m div n, ((i + 1) * m + n - 1) div n - 1)")))
    across = across.select(key, pack("ring", "i").alias("a"), pack(F.col("ring") + 1, "t").alias("b"))
    one = along.unionByName(across)
    return one.unionByName(one.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def layers(edges: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """(key, node, parent, steps) of all nodes up to the layer of the goal: parent is the smallest node of the layer before that leads here."""
    spark, folder = edges.sparkSession, shared_path(edges.sparkSession)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edges_{uuid.uuid4().hex}"
    own = edges.select(key, F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("to")).where("node <> to")
    own.repartition(buckets, key, "node").write.bucketBy(buckets, key, "node").option("path", f"{folder}/edges").format("parquet").saveAsTable(name)
    try:
        own, goals = spark.table(name), ends.select(key, F.col("goal").cast("long").alias("node"))
        start = ends.select(key, F.col("start").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("steps"))
        front, before, k = _written(start.where("node is not null"), f"{folder}/layers/layer=0"), None, 0
        while not front.isEmpty():
            k += 1
            done = front.join(goals.hint("merge"), [key, "node"], "left_semi").select(key)
            reach = front.join(done.hint("merge"), key, "left_anti").select(key, "node").hint("merge").join(own, [key, "node"])
            reach = reach.groupBy(key, F.col("to").alias("node")).agg(F.min("node").alias("parent"))
            for seen in (front, before) if before is not None else (front,):
                reach = reach.join(seen.select(key, "node").hint("merge"), [key, "node"], "left_anti")
            front, before = _written(reach.select(key, "node", "parent", F.lit(k).alias("steps")), f"{folder}/layers/layer={k}"), front
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay in the folder
    return spark.read.schema(start.schema).parquet(f"{folder}/layers").drop("layer")


def breadth_first(edges: dict[int, list[int]], start: int, goal: int) -> list[int]:
    """A shortest path in one graph, with the smallest parent on ties; empty if there is none."""
    parent: dict[int, int | None] = {start: None}
    front = [start]
    while front and goal not in parent:
        new: dict[int, int] = {}
        for v in sorted(front):
            for u in edges.get(v, ()):
                if u not in parent:
                    new.setdefault(u, v)
        parent |= new
        front = list(new)
    path: list[int] = []
    at = goal if goal in parent else None
    while at is not None:
        path.append(at)
        at = parent[at]
    return path[::-1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (key, start, goal, a, b) sorted by key: (key, place, node) of each graph's path, one graph in memory at a time."""
    now, edges, kind = None, {}, None

    def path() -> pa.RecordBatch:
        nodes = breadth_first(edges, *now[1:])
        return pa.record_batch([pa.array([now[0]] * len(nodes), kind), pa.array(range(len(nodes)), pa.int32()), pa.array(nodes, pa.int64())], names=["key", "place", "node"])

    for batch in batches:
        kind = batch.column(0).type
        for key, start, goal, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (key, start, goal):
                if now is not None:
                    yield path()
                now, edges = (key, start, goal), {}
            edges.setdefault(a, []).append(b)
    if now is not None:
        yield path()


def path_nodes(edges: DataFrame, ends: DataFrame, key: str = "grid_id", small: int = 1 << 16) -> DataFrame:
    """(key, place, node) of the nodes of a shortest path of each graph from start to goal, places from 0; no rows where there is none.

    edges: (key, a, b), both ways, nodes as long numbers; ends: (key, start, goal), one row a graph. Of equally short paths
    each node, from the goal on, has the smallest parent. Graphs of at most `small` edges are searched whole, many graphs in
    a task; larger ones step by step by joins.
    """
    ship(edges.sparkSession)
    own = ends.select(key, F.col("start").cast("long").alias("start"), F.col("goal").cast("long").alias("goal"))
    sizes = edges.groupBy(key).agg(F.count("*").alias("_n"))
    todo = cut(own.where("start <> goal").join(sizes.hint("merge"), key))
    rows = edges.join(todo.where(F.col("_n") <= small).hint("merge"), key).select(key, "start", "goal", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = rows.repartition(key).sortWithinPartitions(key).mapInArrow(_solve, f"{key} {edges.schema[key].dataType.simpleString()}, place int, node long")
    found = own.where("start = goal").select(key, F.lit(0).alias("place"), F.col("start").alias("node")).unionByName(found)
    far = todo.where(F.col("_n") > small)
    if far.isEmpty():
        return found
    return found.unionByName(_stepwise(edges.join(far.select(key).hint("merge"), key, "left_semi"), far, key))


def _stepwise(edges: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """`path_nodes` of graphs of any size: layer by layer, and back by pointer doubling."""
    found = cut(layers(edges, ends, key))
    last = found.join(ends.select(key, F.col("goal").cast("long").alias("node")).hint("merge"), [key, "node"])
    have = cut(last.select(key, "node", F.col("steps").alias("place")))
    most = have.agg(F.max("place")).first()[0] or 0
    limits = have.select(key, F.col("place").alias("_most"))
    jump = found.where("parent is not null").join(limits.hint("merge"), key).where("steps <= _most").select(key, "node", F.col("parent").alias("to"), "steps")
    jumps = []
    for k in range(most.bit_length()):
        if k:
            half = jump.select(key, F.col("node").alias("to"), F.col("to").alias("_to"))
            jump = jump.where(F.col("steps") >= 1 << k).join(half.hint("merge"), [key, "to"]).select(key, "node", F.col("_to").alias("to"), "steps")
        jump = cut(jump)
        jumps.append(jump)
    for k in reversed(range(len(jumps))):
        more = have.where(F.col("place") >= 1 << k).join(jumps[k].select(key, "node", "to").hint("merge"), [key, "node"])
        have = have.unionByName(cut(more.select(key, F.col("to").alias("node"), (F.col("place") - (1 << k)).alias("place"))))
    return have.select(key, "place", "node")


def shortest_paths(edges: DataFrame, ends: DataFrame, key: str = "grid_id", small: int = 1 << 16) -> DataFrame:
    """(key, steps, path): path is the array of nodes, both ends included; nulls where there is no way."""
    nodes = path_nodes(edges, ends, key, small)
    own = nodes.groupBy(key).agg(F.max("place").alias("steps"), F.array_sort(F.collect_list(F.struct("place", "node"))).alias("_p"))
    return ends.select(key).join(own.hint("merge"), key, "left").select(key, "steps", F.col("_p.node").alias("path"))
