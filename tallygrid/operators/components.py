"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; set one only where none is set (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            path = tempfile.mkdtemp(prefix="tallygrid-")
        spark.sparkContext.setCheckpointDir(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that its lineage ends and lost executors cost no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component = the smallest node reachable.

    Null ends and self loops add nothing. Each round is partial aggregates and equi joins on the node, so a node
    with very many edges is summed map-side and its join is one that adaptive execution may split. Rounds grow with
    the logarithm of the diameter; going past max_rounds raises instead of returning a wrong answer.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col("u") != F.col("v"))
    e = cut(e.distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = cut(small.select("p.u", "p.v").where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
        if before == now:
            roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
