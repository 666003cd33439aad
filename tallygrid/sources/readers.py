"""Sources: typed reads of the record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUESTION = "struct<question:string,answer:string,correct_answer:string,image:string,filename:string,id:string>"


def raw_records(spark: SparkSession, root: str, file: str = "data.json") -> DataFrame:
    """SRC1: (metadata_path, task_dir, task, pos, record) of every object in the JSON arrays below root; others are skipped.

    A file that isn't a JSON array fails the read. Records stay JSON text: keys with null values are kept apart from missing ones.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", file).text(root)
    files = files.withColumn("metadata_path", F.col("_metadata.file_path")).withColumn("list", F.from_json("value", "array<string>"))
    listed = F.when(F.col("list").isNull() | ~F.ltrim("value").startswith("["), F.raise_error(F.concat(F.lit("not a list: "), F.col("metadata_path"))).cast("array<string>")).otherwise(F.col("list"))
    rows = files.select("metadata_path", F.posexplode(listed).alias("pos", "record")).where(F.ltrim("record").startswith("{"))
    folder = F.regexp_extract("metadata_path", "^(.*)/[^/]*$", 1)
    return rows.select("metadata_path", folder.alias("task_dir"), F.substring_index(folder, "/", -1).alias("task"), "pos", "record")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC2: blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC3"""
    return spark.read.schema(schema).option("multiLine", True).json(path).dropna("all")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: header, all strings."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def questions(text: DataFrame, column: str = "value") -> DataFrame:
    """SRC5: (filename, question, answer, image) of a map of file names or of a list; both spellings of the answer are read."""
    answer = lambda s: F.coalesce(s["correct_answer"], s["answer"])
    as_map = text.where(F.ltrim(column).startswith("{")).select(F.explode(F.from_json(column, f"map<string,{QUESTION}>")).alias("filename", "q"))
    as_list = text.where(F.ltrim(column).startswith("[")).select(F.explode(F.from_json(column, f"array<{QUESTION}>")).alias("q")).select("q.filename", "q")
    return as_map.unionByName(as_list).select("filename", F.col("q.question").alias("question"), answer(F.col("q")).alias("answer"), F.col("q.image").alias("image"))


def inner_payload(outer: str) -> Column:
    """SRC7: the JSON text in `stdout` of a JSON text, null wherever either can't be read."""
    inner = F.try_variant_get(F.try_parse_json(F.col(outer)), "$.stdout", "string")
    return F.try_parse_json(inner)


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SRC6: paths below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def grid_tasks(spark: SparkSession, path: str, shots: int = 0) -> DataFrame:
    """SRC10: first `shots` training pairs (0: all) and the first test pair of each task file."""
    pair = "struct<input:array<array<int>>,output:array<array<int>>>"
    own = spark.read.schema(f"train array<{pair}>, test array<{pair}>").option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return own.select("file", (F.slice("train", 1, shots) if shots else F.col("train")).alias("train"), F.get("test", 0).alias("test"))
