"""Queries of sources, sinks and streams: tables are written in a format and read back, in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import summary
from tallygrid.plans import record_queries
from tallygrid.plans.fixtures import duck, fixture, table
from tallygrid.plans.record_queries import shared_folder
from tallygrid.plans.registry import query
from tallygrid.sources import readers, sinks
from tallygrid.streaming import results, retries


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 > 0 THEN source END AS source FROM documents")
def src2_snk1_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "if(doc_id % 3 > 0, source, null) as source")
    sinks.write_jsonl(own, path := shared_folder(spark))
    return readers.jsonl(spark, path, own.schema)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'a\"b, ' || lang AS quoted, source FROM documents")
def src4_snk2_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as doc_id", "concat('a\"b, ', lang) as quoted", "source")
    sinks.write_csv(own, path := shared_folder(spark))
    return readers.csv(spark, path)


#: Ids whose records share a file.
IN_FILE = 1000


@query("SELECT doc_id, lang FROM documents")
def src3_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy(F.expr(f"doc_id div {IN_FILE}")).agg(F.to_json(F.collect_list(F.struct("doc_id", "lang"))).alias("value"))
    own.select("value").write.option("maxRecordsPerFile", 1).text(path := shared_folder(spark))
    return readers.json_array(spark, path, "doc_id long, lang string")


@query("SELECT lang AS task, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def src1_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("lang", F.expr(f"doc_id div {IN_FILE} as part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "source"))).alias("value"))
    docs.select("lang", "value").write.partitionBy("lang").option("maxRecordsPerFile", 1).text(path := shared_folder(spark))
    own = readers.raw_records(spark, path, "part-*")
    return own.groupBy(F.substring_index("task", "=", -1).alias("task")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("record", "$.doc_id").cast("long")).alias("ids"))


@query("SELECT label, 2 AS shots, count(*) % 7 AS width FROM embeddings GROUP BY 1")
def src10_grid_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count("*") % 7).cast("int").alias("w"))
    pair = F.struct(F.array(F.array("label", "w")).alias("input"), F.array(F.array("w")).alias("output"))
    own.select(F.array(pair, pair, pair).alias("train"), F.array(pair).alias("test")).repartition(10).write.option("maxRecordsPerFile", 1).json(path := shared_folder(spark))
    out = readers.grid_tasks(spark, path, 2)
    return out.select(F.col("test.input")[0][0].alias("label"), F.size("train").alias("shots"), F.col("test.output")[0][0].cast("long").alias("width"))


@query("SELECT CAST(count(*) * 2 AS BIGINT) AS n, CAST(sum(doc_id) * 2 AS BIGINT) AS ids FROM documents")
def snk6_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, path = table(spark, sf_dir, "documents").select("doc_id"), shared_folder(spark)
    sinks.write_jsonl(own, path)
    sinks.write_jsonl(own, path, "append")
    return readers.jsonl(spark, path, own.schema).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = record_queries.voted(spark, sf_dir).select("attempt", "puzzle_id", "task_group", F.col("ok").alias("offline_pass"), F.lit("").alias("error"))
    own.repartition(8, "attempt").write.json(path := shared_folder(spark))
    return results.results(spark, path, own.schema, 2)


@query(f"SELECT attempt, ok AS offline_pass FROM {record_queries.PASSED}")
def st1_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark)
    results.flush(attempts_stream(spark, sf_dir), out, shared_folder(spark)).awaitTermination()
    return spark.read.parquet(out).select("attempt", "offline_pass")


@query(record_queries.A1_BY_GROUP)
def st2_running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.drain(results.running_summary(attempts_stream(spark, sf_dir)), shared_folder(spark), shared_folder(spark), "complete")


@query(record_queries.A1_BY_GROUP)
def st2_upserted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed groups only, batch by batch."""
    return results.upsert(results.running_summary(attempts_stream(spark, sf_dir)), shared_folder(spark), shared_folder(spark), ["task_group"])


TIMED = """(SELECT user_id AS item_id, event_id AS attempt, CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 1 ELSE 0 END AS ok, concat('err-', event_type) AS error, ts FROM events)"""
DAY = 86_400_000


@query(f"""WITH a AS (SELECT *, epoch_ms(ts) AS ms FROM {TIMED}), b AS (SELECT *, coalesce(lag(ok) OVER w = 1 OR ms - lag(ms) OVER w > {DAY}, true) AS starts FROM a WINDOW w AS (PARTITION BY item_id ORDER BY ms, attempt)),
c AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY item_id ORDER BY ms, attempt) AS run FROM b),
d AS (SELECT item_id, run, count(*) AS attempts, arg_max(error, (ms, attempt)) AS last_error, max(ok) = 1 AS done, max(ms) AS ms FROM c GROUP BY 1, 2)
SELECT item_id, attempts, last_error, done, CASE WHEN done THEN 'done' ELSE 'timeout' END AS reason FROM d
WHERE done OR ms + {DAY} <= (SELECT max(ms) FROM a) OR run < (SELECT max(run) FROM d e WHERE e.item_id = d.item_id)""")
def st3_settled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts arrive in two parts, each drained with the same checkpoint; what no attempt follows for a day times out."""
    own = table(spark, sf_dir, "events").selectExpr("user_id as item_id", "event_id as attempt", "if(event_type = 'signup' and user_id % 2 = 0, 1, 0) as ok", "concat('err-', event_type) as error", "cast(ts as timestamp) as ts")
    low, high = own.agg(F.min("ts"), F.max("ts")).first()
    path, out, checkpoint = (shared_folder(spark) for _ in range(3))
    for part in (F.col("ts") <= low + (high - low) / 2, F.col("ts") > low + (high - low) / 2):
        own.where(part).repartition(4).write.mode("append").parquet(path)
        stream = spark.readStream.schema(own.schema).parquet(path)
        found = retries.drain_settled(stream, DAY, out, checkpoint)
    return found


@query(f"SELECT item_id, count(*) AS attempts, arg_max(error, attempt) AS last_error, max(ok) = 1 AS done FROM {duck('retry')} GROUP BY 1")
def st3_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "retry")
    own.repartition(8, "item_id", "attempt").write.json(path := shared_folder(spark))
    return results.drain(results.retry_state(results.results(spark, path, own.schema, 2)), shared_folder(spark), shared_folder(spark), "complete")


@query("SELECT user_id, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1")
def st4_first_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    own.repartition(4).write.json(path := shared_folder(spark))
    first = results.first_only(results.results(spark, path, own.schema, 100), ["user_id"], "ts", "365 days")
    return results.drain(first, shared_folder(spark), shared_folder(spark)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT {record_queries.COUNTS} FROM {record_queries.REC}")
def snk7_eval_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = record_queries.eval_records(spark, sf_dir)
    sinks.write_eval_outputs(own, path := shared_folder(spark))
    return summary.run_summary(readers.jsonl(spark, f"{path}/results", own.schema))


@query(f"""SELECT 'group' AS level, coalesce(nullif(task_group, ''), 'unknown') AS name, count(*) AS n FROM {record_queries.REC} GROUP BY 2 UNION ALL SELECT 'type', coalesce(nullif(task_type, ''), 'unknown'), count(*) FROM {record_queries.REC} GROUP BY 2
UNION ALL SELECT 'all', 'total', count(*) FROM {record_queries.REC} UNION ALL SELECT 'all', 'pass', count(*) FILTER (p) FROM {record_queries.REC}""")
def snk7_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary file, read back."""
    sinks.write_eval_outputs(record_queries.eval_records(spark, sf_dir), path := shared_folder(spark))
    own = readers.jsonl(spark, f"{path}/summary", "total long, pass long, by_group map<string,long>, by_type map<string,long>")
    entries = lambda level, m: F.transform(F.map_entries(m), lambda e: F.struct(F.lit(level).alias("level"), e["key"].alias("name"), e["value"].alias("n")))
    rows = F.concat(entries("group", "by_group"), entries("type", "by_type"), entries("all", F.create_map(F.lit("total"), "total", F.lit("pass"), "pass")))
    return own.select(F.inline(rows))


@query(f"SELECT task_type, count(*) AS n_records FROM {record_queries.C0} GROUP BY 1")
def q5_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading the report raises if a task type hasn't the records that the samples table promises."""
    own = fixture(spark, sf_dir, "samples").select("task_type")
    promised = table(spark, sf_dir, "documents").groupBy(F.expr("element_at(array('maze_square', 'color_grid', 'midpoint', 'unknown_task'), int(doc_id % 4 + 1))").alias("task_type")).agg(F.count("*").alias("n"))
    report = summary.generation_report(own, own, own, promised)
    return report.select("task_type", "n_records")
