"""Sharding by proportional stratified interleaving; only DataFrame functions.

Rows are shuffled by a seeded hash of their doc_id and ranked within their source. The fractional rank (rank - 1/2) / size
of the source puts all sources side by side between 0 and 1; in that order rows are numbered and the numbers cut into
equal runs, so every shard has the mixture of the whole and row counts differ by one at most (law `rows`).

No source is ever sorted in one task: hashes are cut into SLICES slices, slice sizes (a small table) are summed up to
offsets, and rows are numbered within their slice only; the same again with slices of the fractional rank. Only ids,
sources, sizes and checksums are shuffled; texts meet their numbers in one join at the end, where they are wanted.

Rows: a null text counts as empty, a null source as the source "". Rows without a doc_id are told apart by a hash of their
texts, so that they don't meet in one slice. Repeated rows are numbered one by one, very long texts dealt out like others.
An empty table gives no rows. Columns of docs that clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import cut, read

SHARDS, SLICES, SEED = 16, 4096, "interleave-1"
ADDED = ("shard", "slot")
#: SQL for what names a row: its doc_id, else a hash of its text.
NAME = "coalesce(cast(doc_id as string), concat('#', md5(cast(coalesce(text, '') as binary))))"


def shuffle_key(seed: str, *ids: str) -> str:
    """SQL for a hash of 60 bits of the seed and the ids as text."""
    own = ", ".join(f"coalesce(cast({x} as string), '')" for x in ids)
    return f"cast(conv(substr(md5(concat_ws(':', '{seed}', {own})), 1, 15), 16, 10) as bigint)"


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    if shards < 1:
        raise ValueError("one shard at least")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.expr("coalesce(cast(source as string), '')").alias("source"),
        F.expr("coalesce(octet_length(text), 0) + 1L").alias("size"),
        F.expr("crc32(cast(coalesce(text, '') as binary))").alias("text_crc32"),
        F.expr(shuffle_key(seed, NAME)).alias("h"),
    ).withColumn("slice", F.expr(f"h div {(1 << 60) // SLICES}"))
    sums = rows.groupBy("source", "slice").agg(F.count("*").alias("n"))
    of = W.partitionBy("source")
    sums = sums.select("source", "slice", (F.sum("n").over(of.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(of).alias("n_source"))
    order = W.partitionBy("source", "slice").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.join(sums.hint("merge"), ["source", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(order))
    ranked = ranked.withColumn("part", F.expr("(2 * rank - 1) / (2 * n_source)"))
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", "source", "h", "part").withColumn("slice", F.expr(f"cast(floor(part * {SLICES}) as int)")))
    steps = ranked.groupBy("slice").agg(F.count("*").alias("n"))  # SLICES rows at most
    steps = steps.select("slice", (F.sum("n").over(W.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("n_all"))
    order = W.partitionBy("slice").orderBy("part", "source", "h", "doc_id", "text_crc32", "size")
    out = ranked.join(steps.hint("merge"), "slice").withColumn("number", F.col("before") + F.row_number().over(order) - 1)
    out = out.withColumn("shard", F.expr(f"cast(number * {shards} div n_all as int)"))
    return out.select("doc_id", "size", "text_crc32", "shard", F.expr(f"number - (shard * n_all + {shards - 1}) div {shards}").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """docs, with its columns, and the shard and slot of each row."""
    docs = docs.drop(*ADDED)
    own = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_crc": F.expr("crc32(cast(coalesce(text, '') as binary))"), "_size": F.expr("coalesce(octet_length(text), 0) + 1L")})
    named = lambda df: df.withColumns({"_known": F.col("_id").isNotNull(), "_name": F.coalesce("_id", "_crc")})
    numbered = lambda df, *tie: named(df).withColumn("_copy", F.row_number().over(W.partitionBy("_known", "_name").orderBy("_crc", "_size", *tie)))
    found = numbered(assign(docs, shards, seed).toDF("_id", "_size", "_crc", *ADDED), *ADDED)
    own = numbered(own)
    same = ["_known", "_name", "_copy"]
    return own.join(found.select(*same, *ADDED).hint("merge"), same).select(*docs.columns, *ADDED)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One folder for each shard, rows in slot order, in files of at most rows_per_file rows."""
    spread = sharded.withColumn("_file", F.expr(f"slot div {rows_per_file}")).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    spread.drop("_file").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 goes over the hexadecimal digits of the text's bytes, low digit of each byte first, by a table of 16 entries.
ORACLE = """
WITH tab AS (
  SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(octet_length(encode(text)), 0) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS x,
    CAST('0x' || substr(md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
c AS (
  SELECT d.* EXCLUDE (x), xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x)), lambda i: CAST(strpos('0123456789ABCDEF', x[i - i % 2 + 2 - i % 2]) - 1 AS BIGINT))),
    lambda a, b: xor(t[xor(a, b) % 16 + 1], a // 16)), 4294967295) AS text_crc32 FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) AS k, count(*) OVER (PARTITION BY source) AS ns FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * k - 1 AS DOUBLE) / CAST(2 * ns AS DOUBLE), source, h, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM r),
s AS (SELECT *, p * 16 // n AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(p - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
