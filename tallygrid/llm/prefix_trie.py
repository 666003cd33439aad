"""A trie of conversations that share their first turns, rolled up by centroid decomposition.

Nodes are the distinct sequences of first d turns (role, text); a node's parent lacks the last turn, and the root has none.
Sums over subtrees (childless nodes, tokens that a cache of shared prefixes saves) are taken by centroid decomposition of
the parent edges, so that a conversation of any length costs a logarithm of rounds, not one for each turn:

* A component's node weighs as many rows as conversations pass through it. The weight of all that is below a node follows
  from the lengths of its members, so no first sum over the tree is needed to find centroids.
* The centroid is the deepest node that has more than half of its component's weight below it. What its part below it sums
  up to is added to every node on the path from the centroid to the component's top. Then the centroid goes, each of its
  children becomes the top of a component, and what is left above is one as well, each with half of the weight at most.
* Components of more than `block` rows are split by equi joins: which child of the centroid a node is below is looked up in
  the rows of a conversation that passes through it, and so is the path to the top. Smaller components are split on in
  arrays, many of them in one task.

Prefixes are named by a 128-bit hash that is a sum over (depth, turn); sums are taken in runs of RUN turns, so that one
conversation may be spread over many tasks. Member lists are hashed as a sorted stream of joined pieces.

Rows: a null role or text is empty; rows of a null conv_id are left out. Turns are ordered by turn, null first, then by a
hash of role and text; repeated rows are turns of their own. An empty table gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import cut, read
from tallygrid.llm.turns import ordered, positions
from tallygrid.shipping import ship

#: Turns of a conversation summed in one task, weight of a component that is split in arrays, rows of such components
#: taken in hand at once, components whose centroids may be broadcast (under 100 bytes each), and ids joined to one piece.
RUN, BLOCK, ROWS, FEW, PIECE = 4096, 1 << 13, 1 << 16, 10_000, 4096
#: Conversations of one hundred share the first turns of their first one, up to 5.
FAMILY, SHARED = 100, 6
LANES = range(4)
VALUES = ("leaves", "saved")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, own, chars): a hash of role and text, and the text's code points."""
    role, text = (F.expr(f"coalesce(cast({c} as string), '')") for c in ("role", "text"))
    own = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own.alias("own"), F.char_length(text).cast("long").alias("chars"))


def originals(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, own, chars) of the turns as they are, depths from 1, and (conv_id, n_turns) of every conversation."""
    rows, convs = positions(ordered(turn_rows(conversations), F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("own")), "conv_id")
    return rows.select("conv_id", (F.col("position") + 1).alias("depth"), "own", "chars"), convs.withColumnRenamed("n", "n_turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `originals`, of conversations that begin with the first turns of their family's first one.

    The first h turns of conversation c, h = crc32(decimal c) % SHARED, are those of conversation c - c % FAMILY.
    """
    rows, convs = originals(conversations)
    convs = cut(convs.select("conv_id", F.col("n_turns").alias("n_own"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")))
    lengths = convs.select(F.col("conv_id").alias("first"), F.col("n_own").alias("n_first"))
    convs = convs.join(lengths.hint("merge"), "first", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
    convs = cut(convs.select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))
    rows = cut(rows)
    own = rows.join(convs.select("conv_id", "h", "taken").hint("merge"), "conv_id").where("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "own", "chars")
    shared = rows.where(F.col("depth") < SHARED).withColumnRenamed("conv_id", "first")
    shared = convs.select("conv_id", "first", "h").join(shared.hint("merge"), "first").where("depth <= h")
    return own.unionByName(shared.select("conv_id", "depth", "own", "chars")), convs.select("conv_id", "n_turns")


def _name(depth, lanes) -> F.Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *((x % (1 << 32)).cast("string") for x in lanes)).cast("binary")))


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, n_turns): the node that each conversation reaches with each turn, the root included."""
    lane = lambda k: F.conv(F.substring("spread", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("spread", F.md5(F.concat_ws(":", F.col("depth").cast("string"), "own").cast("binary"))).select("conv_id", "depth", "chars", F.expr(f"(depth - 1) div {RUN}").alias("run"), *(lane(k).alias(f"x{k}") for k in LANES))
    runs = rows.groupBy("conv_id", "run").agg(*(F.sum(f"x{k}").alias(f"s{k}") for k in LANES))
    earlier = W.partitionBy("conv_id").orderBy("run")
    runs = runs.select("conv_id", "run", *((F.sum(f"s{k}").over(earlier) - F.col(f"s{k}")).alias(f"s{k}") for k in LANES))
    so_far = W.partitionBy("conv_id", "run").orderBy("depth")
    rows = rows.select("*", *(F.sum(f"x{k}").over(so_far).alias(f"p{k}") for k in LANES)).join(runs.hint("merge"), ["conv_id", "run"])
    upto = [F.col(f"s{k}") + F.col(f"p{k}") for k in LANES]
    rows = rows.select("conv_id", "depth", _name(F.col("depth"), upto).alias("node"), _name(F.col("depth") - 1, [x - F.col(f"x{k}") for k, x in enumerate(upto)]).alias("parent"), "chars")
    rows = rows.join(convs.hint("merge"), "conv_id")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), _name(F.lit(0), [F.lit(0)] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "n_turns")
    return rows.unionByName(root)


def nodes_of(found: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, chars, weight, leaf): conv_id is the smallest member, weight the rows of its subtree."""
    return found.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"), (F.max("n_turns") == F.min("depth")).alias("leaf"),
    )


def centroid_sums(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values over all subtrees of a forest by centroid decomposition.

    parent: index of each node's parent, which stands before it, or -1; weight: at least 1 a node, summed over its subtree.
    """
    n = len(parent)
    size, free, pre = [1] * n, [0] * n, np.zeros(n, dtype=np.int64)
    above = parent.tolist()
    for v in range(n - 1, -1, -1):
        if above[v] >= 0:
            size[above[v]] += size[v]
    roots = 0
    for v in range(n):  # preorder numbers: a subtree is a range of them
        u = above[v]
        at = roots if u < 0 else free[u]
        if u < 0:
            roots += size[v]
        else:
            free[u] += size[v]
        pre[v], free[v] = at, at + 1
    end = pre + np.array(size, dtype=np.int64)
    out, left = np.zeros_like(values), weight.astype(np.int64)
    top = np.arange(n)
    for v in range(n):
        if above[v] >= 0:
            top[v] = top[above[v]]
    live = np.arange(n)
    centre = np.full(n, -1)
    while len(live):
        mine = top[live]
        heavy = live[2 * left[live] > left[mine]]
        heavy = heavy[np.argsort(pre[heavy], kind="stable")]  # of nodes on one path the deepest comes last
        centre[top[heavy]] = heavy
        c = centre[mine]
        inside = (pre[live] >= pre[c]) & (pre[live] < end[c])
        path = (pre[live] <= pre[c]) & (pre[c] < end[live])
        below = live[inside]
        sums = np.zeros_like(values)
        np.add.at(sums, top[below], values[below])
        on = live[path]
        out[on] += sums[top[on]]
        gone = left[c[path]]
        change = on != c[path]
        left[on[change]] -= gone[change]
        kids = below[parent[below] == c[inside]]
        key = top[kids] * n + pre[kids]
        order = np.argsort(key)
        rest = below[below != c[inside]]
        child = kids[order][np.searchsorted(key[order], top[rest] * n + pre[rest], side="right") - 1] if len(rest) else rest
        top[rest] = child
        live = live[live != c]
    return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, depth, node, parent, weight, leaves, saved) sorted by component and depth; whole components are taken together."""

    def sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        comp, node, above = (rows.column(k).to_pylist() for k in ("comp", "node", "parent"))
        at = {x: k for k, x in enumerate(zip(comp, node, strict=True))}
        parent = np.array([at.get(x, -1) for x in zip(comp, above, strict=True)], dtype=np.int64)
        values = np.stack([rows.column(v).to_numpy() for v in VALUES], axis=1)
        found = centroid_sums(parent, rows.column("weight").to_numpy(), values)
        return pa.record_batch([pa.array(node, pa.binary()), *(pa.array(found[:, k]) for k in range(len(VALUES)))], names=["node", *VALUES])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) >= ROWS:
            last, comps = held[-1].column(0)[-1], batch.column(0)
            cut_at = next((k for k in range(batch.num_rows) if comps[k] != last), None)
            if cut_at is not None:
                yield sums([*held, batch.slice(0, cut_at)])
                held, batch = [], batch.slice(cut_at)
        held.append(batch)
    if held:
        yield sums(held)


def subtree_sums(nodes: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, leaves, saved): sums over each node's subtree. nodes: one tree, with (node, parent, depth, rep, weight, leaves, saved),
    rep a conversation through the node; found: (conv_id, depth, node)."""
    top = nodes.where("parent is null").select("node", "weight").first()
    if top is None:
        return nodes.select("node", *VALUES)
    start = nodes.withColumns({"comp": F.when(F.col("depth") > 0, F.lit(bytes(top.node))).otherwise(F.col("node")), "total": F.lit(top.weight)})
    own = start.columns
    small, sums = [start.where(F.col("total") <= block)], []
    large = start.where(F.col("total") > block)
    found = found.select("conv_id", F.col("depth").alias("up"), F.col("node").alias("passed"))
    while True:
        picked = large.where("2 * weight > total").groupBy("comp").agg(F.max(F.struct("depth", "node", "rep", "weight")).alias("c"))
        picked = cut(picked.select("comp", F.col("c.depth").alias("c_depth"), F.col("c.node").alias("c_node"), F.col("c.rep").alias("c_rep"), F.col("c.weight").alias("c_weight")))
        few = picked.count()
        if not few:
            break
        spread = (lambda df: F.broadcast(df)) if few <= FEW else (lambda df: df.hint("merge"))  # noqa: B023
        now = large.join(spread(picked), "comp")
        kids = now.where("parent = c_node").select(F.col("node").alias("passed"), F.col("weight").alias("kid_weight"))
        below = now.where("depth > c_depth").join(found.hint("merge"), (F.col("rep") == F.col("conv_id")) & (F.col("up") == F.col("c_depth") + 1)).drop("conv_id", "up")
        below = below.join(kids.hint("merge"), "passed", "left").withColumn("on_path", F.lit(False))
        way = found.join(spread(picked.select("comp", "c_depth", "c_rep")), F.col("conv_id") == F.col("c_rep")).where("up <= c_depth").select("comp", F.col("passed").alias("node"), F.lit(True).alias("on_path"))
        above = now.where("depth <= c_depth").join(way.hint("merge"), ["comp", "node"], "left").withColumns({"passed": F.lit(None).cast("binary"), "kid_weight": F.lit(None).cast("long"), "on_path": F.coalesce("on_path", F.lit(False))})
        marked = cut(below.unionByName(above))
        inside = marked.where("kid_weight is not null or node = c_node").groupBy("comp").agg(*(F.sum(v).alias(v) for v in VALUES))
        sums.append(cut(marked.where("on_path").select("comp", "node").join(spread(inside), "comp").select("node", *VALUES)))
        is_below = F.col("kid_weight").isNotNull()
        split = marked.where("node <> c_node").withColumns(
            {
                "comp": F.when(is_below, F.col("passed")).otherwise(F.col("comp")),
                "total": F.when(is_below, F.col("kid_weight")).otherwise(F.col("total") - F.col("c_weight")),
                "weight": F.when(F.col("on_path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
            }
        ).select(*own)
        small.append(split.where(F.col("total") <= block))
        large = split.where(F.col("total") > block)
    rest = small[0]
    for x in small[1:]:
        rest = rest.unionByName(x)
    rest = rest.select("comp", "depth", "node", "parent", "weight", *VALUES).repartition("comp").sortWithinPartitions("comp", "depth")
    out = rest.mapInArrow(_local, "node binary, leaves long, saved long")
    for x in sums:
        out = out.unionByName(x)
    return out.groupBy("node").agg(*(F.sum(v).alias(v) for v in VALUES))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) sorted by both: runs of one node, at most PIECE ids long, as text."""
    node, ids = None, []

    def piece() -> tuple[bytes, int, str]:
        return node, ids[0], ",".join(map(str, ids))

    for batch in batches:
        out = []
        for n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if ids and (n != node or len(ids) == PIECE):
                out.append(piece())
                ids = []
            node = n
            ids.append(c)
        yield _pieces(out)
    if ids:
        yield _pieces([piece()])


def _pieces(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id: the hash of each node's joined pieces, of which one is held at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for n, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if sha is not None and n == node:
                sha.update(b",")
            else:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256()
            sha.update(ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends"])
    if sha is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends"])


def ends(found: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined; nodes where none ends have no row."""
    last = found.where("depth = n_turns").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = last.mapInArrow(_join_ids, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digest, "node binary, ends string")


def trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node, with its sums, of turns (conv_id, depth, own, chars) and conversations (conv_id, n_turns)."""
    ship(rows.sparkSession)
    found = cut(paths(rows, convs))
    nodes = cut(nodes_of(found))
    values = nodes.select("node", "parent", "depth", F.col("conv_id").alias("rep"), "weight", F.col("leaf").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    none = {c: F.lit(None).cast(t) for c, t in (("leaves", "long"), ("saved", "long"), ("n_children", "long"), ("ends", "string"), ("parent", "binary"), ("depth", "long"), ("conv_id", "long"), ("n_convs", "long"))}
    fill = lambda df: df.withColumns({c: x for c, x in none.items() if c not in df.columns})
    parts = [
        nodes.select("node", "parent", "depth", "conv_id", "n_convs"),
        subtree_sums(values, found, block),
        nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")),
        ends(found),
    ]
    out = fill(parts[0])
    for x in parts[1:]:
        out = out.unionByName(fill(x))
    out = cut(out.groupBy("node").agg(*(F.max(c).alias(c) for c in none)))
    above = out.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above.hint("merge"), "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(read(spark, sf_dir, "conversations")))


#: Prefixes are lists of turns; a node's ancestors are those of its smallest member.
ORACLE = """
WITH tab AS (
  SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, count(*) AS n, string_split(hex(encode(CAST(conv_id AS VARCHAR))), '') AS x FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x)), lambda i: CAST(strpos('0123456789ABCDEF', x[i - i % 2 + 2 - i % 2]) - 1 AS BIGINT))),
    lambda a, b: xor(t[xor(a, b) % 16 + 1], a // 16)), 4294967295) % 6 AS h FROM o, tab),
k AS (SELECT c.*, least(c.h, coalesce(f.n, 0)) AS taken FROM c LEFT JOIN c f ON f.conv_id = c.b),
r AS (
  SELECT k.conv_id, i - h + taken AS depth, role, text FROM k JOIN t ON t.conv_id = k.conv_id WHERE i > h
  UNION ALL SELECT k.conv_id, i, role, text FROM k JOIN t ON t.conv_id = b WHERE i <= h),
m AS (
  SELECT conv_id, depth, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS seq, length(text) AS chars FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
l AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY conv_id),
g AS (
  SELECT seq, min(depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, CAST(max(n) = min(depth) AS INTEGER) AS leaf, (count(*) - 1) * min(chars) AS saved,
    coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE depth = n), '') AS ends
  FROM m JOIN l USING (conv_id) GROUP BY seq),
s AS (
  SELECT m.seq, sum(g.leaf) AS leaves, sum(g.saved) AS saved, count(*) FILTER (WHERE g.depth = m.depth + 1) AS kids
  FROM g JOIN m ON m.conv_id = g.conv_id AND m.depth <= g.depth GROUP BY m.seq)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.seq = g.seq LEFT JOIN g p ON p.depth = g.depth - 1 AND p.seq = g.seq[:-2]
"""
