"""Result rows that arrive as files: the batch summaries as streams, exactly once by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallygrid.operators.components import cut
from tallygrid.operators.summary import run_columns


def results(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def flush(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """ST1: what has arrived so far, appended to Parquet."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(rows: DataFrame) -> DataFrame:
    """ST2: A1 by group, for update mode (see `upsert`) or complete mode."""
    return rows.groupBy("task_group").agg(*run_columns())


def retry_state(log: DataFrame) -> DataFrame:
    """ST3: attempts, last error and whether it is done, by item."""
    return log.groupBy("item_id").agg(F.count("*").alias("attempts"), F.max_by("error", "attempt").alias("last_error"), (F.max("ok") == 1).alias("done"))


def first_only(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """ST4: the first row of each key to arrive; state older than the watermark goes."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that has arrived, through the stream, as Parquet below path: a folder for each batch, so that a batch that is
    repeated replaces itself. In complete mode the last batch holds the whole result, in append mode all batches do."""

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    found = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def current(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of a table that `upsert` has written: of each bucket the newest version (of a batch below `before`)."""
    parts = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])
    own = spark.read.schema(parts).parquet(path)
    own = own if before is None else own.where(F.col("batch") < before)
    newest = own.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return own.join(newest.hint("merge"), ["bucket", "batch"], "left_semi").select(*schema.names, "bucket")


def upsert(rows: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """ST2: an aggregate in update mode, kept as a table below path: a batch's groups replace those of the same keys.

    Only buckets that hold a changed group are written again, as path/batch=<id>/bucket=<b>. A batch reads what was there
    before it and replaces itself when it is repeated, so that a restart changes nothing.
    """
    spark, schema = rows.sparkSession, rows.schema
    spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])).write.mode("append").partitionBy("batch", "bucket").parquet(path)

    def write(batch: DataFrame, k: int) -> None:
        new = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long")))
        touched = new.select("bucket").distinct()
        old = current(batch.sparkSession, path, schema, k).join(touched.hint("merge"), "bucket", "left_semi")
        kept = old.join(new.select(*keys).hint("merge"), keys, "left_anti").select(*schema.names, "bucket")
        kept.unionByName(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={k}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return current(spark, path, schema).drop("bucket")
