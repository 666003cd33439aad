"""Sinks: the record formats, written by all tasks; a folder of part files each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.text import first_id, missing
from tallygrid.operators.canon import keep_last, numbered
from tallygrid.operators.summary import grouped_summary


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK1, SNK3, SNK6, SNK7: nulls are written; append adds files, nothing is read back."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK2: header, every field quoted, quotes doubled, missing values as ""."""
    rows.na.fill("").write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_shards(rows: DataFrame, path: str, order: str, rows_per_shard: int, shards_per_task: int = 32) -> None:
    """SNK4, W4: folders shard=k of rows_per_shard rows in the order of a unique long.

    Tasks go with the number of files, as opening them takes the time; left to adaptive execution, which looks at bytes, one
    task would write thousands of small files.
    """
    tasks = max(1, -(-rows.count() // (rows_per_shard * shards_per_task)))
    own = numbered(rows, order, "_index").withColumn("shard", F.expr(f"_index div {rows_per_shard}")).drop("_index")
    own.repartition(tasks, "shard").sortWithinPartitions("shard", order).write.partitionBy("shard").parquet(path)


def shard_info(spark: SparkSession, path: str) -> DataFrame:
    """SNK4: (shard, file, rows, row_groups) of each Parquet file below path.

    Files are listed by Spark, their contents are left out of the scan, and tasks read the footers: bytes go with the number
    of files and columns, not with the rows. Stores that Arrow has no file system for are an error.
    """

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in batch.column(0).to_pylist():
                store, name = (pafs.LocalFileSystem(), re.sub("^file:/*", "/", file)) if file.startswith("file:") else pafs.FileSystem.from_uri(quote(file, safe=":/@"))
                with store.open_input_file(name) as opened:
                    own = pq.read_metadata(opened)
                out.append((file, own.num_rows, own.num_row_groups))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "rows", "row_groups"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    found = files.select("path").mapInArrow(footers, "file string, rows long, row_groups long")
    return found.select(F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long").alias("shard"), "file", "rows", "row_groups")


def write_eval_outputs(rows: DataFrame, path: str) -> None:
    """SNK7: the rows in path/results and their run summary, one JSON line with totals, by_group and by_type, in path/summary."""
    write_jsonl(rows, f"{path}/results")
    counts = lambda level, name: F.map_from_entries(F.collect_list(F.when(F.col("level") == level, F.struct(name, "total")))).alias(f"by_{name[5:]}")
    total = lambda c, name: F.max(F.when(F.col("level") == 3, F.col(c))).alias(name)
    own = grouped_summary(rows).agg(total("total", "total"), total("passed", "pass"), total("failed", "fail"), total("errors", "error"), counts(1, "task_group"), counts(2, "task_type"))
    own.withColumn("results_path", F.lit(f"{path}/results")).write.json(f"{path}/summary")


def dataset_info(exports: DataFrame, modes: list[str]) -> DataFrame:
    """SNK5: rows by mode, in one row; exports: mode. Unknown modes are dropped; none left is an error."""
    known = [m for m in dict.fromkeys(x.strip().lower() for x in modes) if m in ("edit", "conversation", "chat", "video")]
    if not known:
        raise ValueError("no known mode")
    return exports.agg(*(F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in known), F.count_if(F.col("mode").isin(known)).alias("n_total"))


def question_manifest(entries: DataFrame) -> DataFrame:
    """SNK8: by file name the last row that has a name, a question and an answer; id from id, index or question_id, else the name."""
    own = entries.withColumn("answer", F.coalesce(missing("correct_answer"), missing("answer")))
    own = own.where("length(filename) > 0 and length(question) > 0 and length(answer) > 0")
    own = own.withColumn("id", F.coalesce(first_id("id", "index", "question_id"), F.col("filename"))).select("filename", "id", "question", "answer", "pos")
    return keep_last(own, ["filename"]).drop("pos")
