"""Queries of sources, canonicalisation, joins, votes, summaries, windows, sets and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import rewards as R
from tallygrid.functions import text as T
from tallygrid.operators import canon, export, gates, sequences, summary, synth, votes
from tallygrid.operators.components import shared_path as shared_folder
from tallygrid.plans.fixtures import duck, fixture, table
from tallygrid.plans.registry import query
from tallygrid.plans.text_queries import LETTER, PLAIN, squeeze
from tallygrid.sources import readers, sinks

S, AT, CELLS, RETRY = duck("samples"), duck("attempts"), duck("cells"), duck("retry")
ANSWER = "case when doc % 3 > 0 then concat('opt ', doc % 9) end"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as JSON text: keys that a record lacks are left out, null values stay."""
    own = fixture(spark, sf_dir, "samples").withColumn("doc", F.col("pos"))
    entry = lambda k, v, when: F.when(F.expr(when), F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")))
    fields = F.array(
        entry("id", "id", "doc % 13 > 0"), entry("task_type", "task_type", "true"), entry("correct_option", "correct_option", "doc % 4 = 2"), entry("ti2i_prompt", "ti2i_prompt", "has_ti2i = 1"),
        entry("prompt", "prompt", "true"), entry("image", "image", "true"), entry("solution_image_path", "solution_image_path", "doc % 17 > 0"), entry("answer", ANSWER, "doc % 4 = 1"),
        entry("ti2t_answer", "concat('Answer: ', doc % 9, '.')", "doc % 4 = 1 and doc % 2 = 1 and doc % 7 > 0"), entry("solution_path_cell_ids", "concat('[1, ', doc % 7, ']')", "doc % 8 = 0"),
    )
    return own.select("pos", "doc", F.to_json(F.map_from_entries(F.array_compact(fields)), {"ignoreNullFields": "false"}).alias("record"), F.lit("data").alias("task"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows that are kept, with the prompts of the four modes."""
    own = canon.canonical(records(spark, sf_dir), F.lit("/root/x/../set"), parsed="fields").where("reject_reason is null")
    modes = {m: canon.prompt_for(F.col("fields"), m, F.col("prompts"), F.col("prompt_train")) for m in canon.PROMPT_KEYS}
    return canon.pin(own, modes).withColumns({"answer_text": canon.value(F.col("fields"), "answer"), "raw_answer": canon.value(F.col("fields"), "ti2t_answer")})


#: The same rows in SQL, from the fixture alone.
C0 = rf"""(SELECT pos, pos AS doc, task_type, prompt, image, CASE WHEN pos % 17 > 0 THEN solution_image_path END AS sol,
  CASE WHEN pos % 4 = 1 THEN 'visual_puzzle' WHEN pos % 4 = 2 THEN 'eyeballing' WHEN pos % 4 = 0 THEN 'maze' END AS g,
  CASE WHEN pos % 13 > 0 THEN id ELSE task_type || ':' || coalesce(image, '') END AS sid,
  CASE WHEN has_ti2i = 1 THEN nullif(trim(ti2i_prompt), '') ELSE prompt END AS ti2i, prompt AS ti2v,
  CASE pos % 4 WHEN 0 THEN CASE WHEN pos % 8 = 0 THEN '[1, ' || pos % 7 || ']' END WHEN 2 THEN CASE WHEN length(correct_option) = 1 THEN upper(correct_option) END
    WHEN 1 THEN CASE WHEN pos % 3 > 0 THEN 'opt ' || pos % 9 WHEN pos % 2 = 1 AND pos % 7 > 0 THEN CAST(pos % 9 AS VARCHAR) END END AS solution FROM {S})"""
C1 = f"""(SELECT *, CASE WHEN g IS NULL THEN 'no task group' WHEN image IS NULL OR sol IS NULL THEN 'missing asset' WHEN solution IS NULL THEN 'no answer' END AS why FROM {C0})"""
KEPT = f"(SELECT *, '/root/set/' || image AS puzzle_image, '/root/set/' || sol AS solution_image FROM {C1} WHERE why IS NULL)"


@query(f"SELECT pos, ti2i, ti2v, CAST(NULL AS VARCHAR) AS ti2t FROM {C0}")
def p1_resolve_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = canon.record_map("record")
    return records(spark, sf_dir).select("pos", *(canon.resolve_prompt(m, k).alias(k) for k in ("ti2i", "ti2v", "ti2t")))


@query(f"SELECT pos, coalesce(ti2v, ti2i) AS prompt_raw FROM {C0}")
def p2_raw_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("pos", canon.raw_prompt(canon.record_map("record")).alias("prompt_raw"))


@query(f"SELECT pos, g AS task_group FROM {C0}")
def p3_task_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("pos", canon.task_group(canon.record_map("record"), "task").alias("task_group"))


@query(f"SELECT pos, sid AS sample_id, g AS task_group, why AS reject_reason, '/root/set/' || image AS puzzle_image, '/root/set/' || sol AS solution_image, CASE WHEN g <> 'maze' THEN solution END AS correct_option FROM {C1}")
def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canon.canonical(records(spark, sf_dir), F.lit("/root/x/../set"))
    return own.select("pos", "sample_id", "task_group", "reject_reason", "puzzle_image", "solution_image", "correct_option")


@query(f"SELECT pos, ti2v, ti2i, CAST(NULL AS VARCHAR) AS ti2t, CAST(NULL AS VARCHAR) AS ti2ti FROM {KEPT}")
def p5_prompt_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("pos", *canon.PROMPT_KEYS)


@query(f"SELECT pos, g AS task_group FROM {KEPT} WHERE g IN ('maze', 'eyeballing')")
def p6_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.select_tasks(samples(spark, sf_dir), None, ["maze", "eyeballing"], []).select("pos", "task_group")


@query(f"SELECT pos, CASE WHEN pos % 3 = 0 THEN 'r' || pos ELSE image END AS image FROM {S}")
def p7_reasoning_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case pos % 3 when 0 then concat('r', pos) when 1 then '' end")
    return fixture(spark, sf_dir, "samples").select("pos", canon.reasoning_image(given, "image").alias("image"))


@query(f"SELECT pos, CASE pos % 4 WHEN 0 THEN '/abs/' || pos || '.png' WHEN 1 THEN '/b/' || pos || '.png' WHEN 2 THEN '/a/' || pos || '.png' ELSE '/a/b/c/' || pos || '.png' END AS path FROM {S}")
def p8_absolute_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat(case pos % 4 when 0 then '/abs/x/../' when 1 then '../../b/./' when 2 then '../' else 'c//' end, pos, '.png')")
    return fixture(spark, sf_dir, "samples").select("pos", canon.absolute(path, F.lit("/a/b")).alias("path"))


@query(f"""SELECT pos, CASE WHEN pos % 9 = 0 THEN '/abs/' || pos || '.png' WHEN image IS NULL THEN NULL WHEN pos % 800 % 3 = 1 THEN '/root/files/' || image ELSE '/root/set/' || image END AS path,
  CASE WHEN pos % 9 = 0 THEN pos % 2 = 0 WHEN image IS NOT NULL THEN pos % 800 % 3 < 2 END AS found FROM {S}""")
def p8_existing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images below the dataset's root, else beside its file, else nowhere; some absolute ones, of which half exist."""
    own = fixture(spark, sf_dir, "samples").withColumn("image", F.expr("if(pos % 9 = 0, concat('/abs/', pos, '.png'), image)"))
    files = fixture(spark, sf_dir, "samples").selectExpr("inline(array(struct(if(pos % 800 % 3 = 0, concat('/root/set/puzzles/', pos % 800, '.png'), concat('/root/files/puzzles/', pos % 800, '.png')) as path, pos % 800 % 3 < 2 as there), struct(concat('/abs/', pos, '.png') as path, pos % 18 = 0 as there), struct(if(pos % 800 % 6 = 0, concat('/root/files/puzzles/', pos % 800, '.png'), null) as path, true as there)))")
    out = canon.resolve_assets(own, files.where("there and path is not null").select("path"), "image", F.lit("/root/set"), F.lit("/root/files/data.json"))
    return out.select("pos", "path", "found")


@query(f"""SELECT pos, array_to_string(list_filter([CASE WHEN pos % 13 > 0 THEN 'id' END, 'image', CASE WHEN pos % 17 > 0 THEN 'solution_image_path' END, CASE WHEN has_ti2i = 1 THEN 'ti2i_prompt' END,
  CASE WHEN pos % 4 = 1 AND pos % 7 > 0 THEN 'ti2t_answer' END], lambda k: k IS NOT NULL), ',') AS keys, image FROM {S}""")
def p9_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = canon.prune(canon.record_map("record"))
    return records(spark, sf_dir).select("pos", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), canon.value(m, "image").alias("image"))


@query(f"SELECT pos, CASE WHEN trim(coalesce(ti2i_prompt, '')) <> '' THEN ti2i_prompt ELSE prompt END AS prompt FROM {S}")
def p10_first_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "samples").select("pos", canon.first_prompt("ti2i_prompt", "prompt").alias("prompt"))


@query(f"SELECT pos, array_to_string(list_filter(['id', 'question', 'prompt', 'answer'], lambda k: NOT (k = 'prompt' OR (k = 'id' AND pos % 13 > 0) OR (k = 'answer' AND pos % 4 = 1))), ',') AS missing FROM {S}")
def p11_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("pos", F.array_join(canon.missing_fields(canon.record_map("record")), ",").alias("missing"))


OPTION = f"CASE WHEN regexp_full_match(trim(coalesce(t, '')), '\\p{{L}}') THEN upper(trim(t)) ELSE {LETTER} END"


@query(f"SELECT attempt, {OPTION} AS letter FROM (SELECT attempt, text_option AS t FROM {AT})")
def p12_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "attempts").select("attempt", T.option("text_option").alias("letter"))


@query(f"SELECT attempt, CASE attempt % 4 WHEN 0 THEN 'T' WHEN 1 THEN CASE WHEN attempt % 8 < 4 THEN 'x' END WHEN 2 THEN 'c' END AS source, CASE WHEN attempt % 3 = 0 THEN 'spoken' ELSE 'predicted' END AS order_source FROM {AT}")
def p13_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "attempts").selectExpr("attempt", "if(attempt % 4 = 0, 'T', null) as transcript", "if(attempt % 8 = 1, 'x', null) as text", "'c' as content", "attempt % 4 < 2 as has_video", "if(attempt % 3 = 0, array(null, null), array(null, 'red')) as predicted")
    source = canon.text_source("transcript", "text", "content", ~F.col("has_video") & (F.col("attempt") % 4 == 2))
    return own.select("attempt", source.alias("source"), F.when(F.exists("predicted", lambda x: x.isNotNull()), "predicted").otherwise("spoken").alias("order_source"))


@query(f"SELECT puzzle_id, attempt, pos, expected FROM {CELLS} WHERE is_clue = 0 AND pos % 4 > 0")
def p14_attempt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "cells")
    payload = own.groupBy("puzzle_id", "attempt").agg(F.to_json(F.collect_list(F.struct(F.expr("if(pos % 4 = 0, null, pos)").alias("row"), F.col("pos").alias("col"), "expected", (F.col("is_clue") == 1).alias("is_clue")))).alias("payload"))
    return sequences.attempt_cells(payload, ["puzzle_id", "attempt"]).select("puzzle_id", "attempt", F.col("col").alias("pos"), "expected")


# Sources and sinks


@query("SELECT 'f' || doc_id AS filename, lang || '?' AS question, source AS answer, CAST(NULL AS VARCHAR) AS image FROM documents")
def src5_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("f", F.expr("concat('f', doc_id)"))
    one = docs.where("doc_id % 2 = 0").select(F.to_json(F.create_map("f", F.struct(F.concat("lang", F.lit("?")).alias("question"), F.col("source").alias("correct_answer")))).alias("value"))
    two = docs.where("doc_id % 2 = 1").select(F.to_json(F.array(F.struct(F.col("f").alias("filename"), F.concat("lang", F.lit("?")).alias("question"), F.col("source").alias("answer")))).alias("value"))
    return readers.questions(one.unionByName(two))


LIST = duck("listing")


@query(f"""SELECT sample_id, arg_min(path, r * 1000 + length(path)) AS candidate FROM (SELECT sample_id, path, CASE WHEN ends_with(path, '/output.png') THEN 0 WHEN ends_with(path, '/generated.png') THEN 1
  WHEN ends_with(path, '.png') THEN 2 ELSE 3 END AS r FROM {LIST}) GROUP BY sample_id""")
def src6_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    return canon.best_candidate(docs, fixture(spark, sf_dir, "listing"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(props->>'k' AS BIGINT) END AS k FROM events")
def src7_inner_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("outer", F.expr("if(event_id % 3 = 0, 'no json', to_json(named_struct('stdout', props)))"))
    return own.select("event_id", F.try_variant_get(readers.inner_payload("outer"), "$.k", "bigint").alias("k"))


@query(f"SELECT id, max(pos) AS pos FROM {S} GROUP BY id")
def src8_last_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canon.require(fixture(spark, sf_dir, "samples"), F.col("id").isNotNull(), "metadata without an id")
    return canon.keep_last(own.select("id", "pos", F.col("pos").alias("at")), ["id"], "at").select("id", "pos")


@query(f"SELECT pos, task_type FROM {KEPT} WHERE task_type IN ('color_grid', 'midpoint') AND g IN ('eyeballing', 'visual_puzzle') AND task_type <> 'color_grid'")
def src9_select_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.select_tasks(samples(spark, sf_dir), ["color_grid", "midpoint", "nowhere"], ["eyeballing", "visual_puzzle"], ["color_grid"]).select("pos", "task_type")


@query(f"SELECT sid AS id, solution_image AS image, puzzle_image AS edit_image, ti2i AS prompt FROM {KEPT} WHERE ti2i IS NOT NULL")
def snk3_edit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.edit_pairs(samples(spark, sf_dir)).select("id", "image", "edit_image", "prompt")


@query("SELECT r // 50 AS shard, count(*) AS rows, 1 AS files, 1 AS row_groups FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1")
def snk4_shard_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang"), path := shared_folder(spark), "doc_id", 50)
    return sinks.shard_info(spark, path).groupBy("shard").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("row_groups").alias("row_groups"))


@query(f"SELECT count(*) FILTER (ti2i IS NOT NULL) AS n_edit, count(*) AS n_chat, count(*) FILTER (ti2i IS NOT NULL) + count(*) AS n_total FROM {KEPT}")
def snk5_dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir).select(F.explode(F.array_compact(F.array(F.when(F.col("ti2i").isNotNull(), "edit"), F.lit("chat")))).alias("mode"))
    return sinks.dataset_info(own, [" Edit", "chat", "nothing"])


@query("""SELECT filename, id, question, answer FROM (SELECT 'v' || doc_id % 60 AS filename, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS VARCHAR) WHEN doc_id % 2 > 0 THEN lang ELSE 'v' || doc_id % 60 END AS id, lang AS question, source AS answer,
  row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id % 5 > 0) WHERE k = 1""")
def snk8_question_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("concat('v', doc_id % 60) as filename", "doc_id % 4 as id", "if(doc_id % 2 > 0, lang, '') as index", "cast(null as string) as question_id", "lang as question", "if(doc_id % 5 = 0, '', source) as answer", "cast(null as string) as correct_answer", "doc_id as pos")
    return sinks.question_manifest(own)


# Joins


@query(f"SELECT d.doc_id, s.task_type, CASE WHEN s.id IS NULL THEN 'Missing sample' END AS error FROM documents d LEFT JOIN (SELECT id, max(task_type) AS task_type FROM {S} GROUP BY id) s ON s.id = 's' || d.doc_id")
def j1_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = fixture(spark, sf_dir, "samples").groupBy("id").agg(F.max("task_type").alias("task_type"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('s', doc_id)").alias("id"))
    return canon.metadata_join(own, meta).select("doc_id", "task_type", "error")


@query("""WITH i AS (SELECT doc_id AS pos, doc_id % 150 AS sample_id, CASE WHEN doc_id % 2 = 0 THEN 'e' END AS error, lang AS prediction_text, max(doc_id) OVER (PARTITION BY doc_id % 150) AS last FROM documents),
o AS (SELECT doc_id % 90 AS sample_id, arg_max(doc_id % 3, doc_id) AS v, arg_max(CASE WHEN doc_id % 4 = 0 THEN 'off' || doc_id % 7 END, doc_id) AS error, arg_max(CASE WHEN doc_id % 5 = 0 THEN source END, doc_id) AS t FROM documents GROUP BY 1)
SELECT i.pos, i.sample_id, CASE WHEN i.pos = last AND o.v IS NOT NULL THEN CASE o.v WHEN 0 THEN true WHEN 1 THEN false END END AS offline_pass,
  CASE WHEN i.pos = last THEN coalesce(o.error, i.error) ELSE i.error END AS error, CASE WHEN i.pos = last THEN coalesce(o.t, i.prediction_text) ELSE i.prediction_text END AS prediction_text FROM i LEFT JOIN o USING (sample_id)""")
def j2_merge_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    inference = docs.selectExpr("doc_id as pos", "doc_id % 150 as sample_id", "if(doc_id % 2 = 0, 'e', null) as error", "lang as prediction_text", "cast(null as boolean) as offline_pass", "cast(null as string) as offline_metrics")
    offline = docs.selectExpr("doc_id as pos", "doc_id % 90 as sample_id", "case doc_id % 3 when 0 then true when 1 then false end as offline_pass", "cast(null as string) as offline_metrics", "if(doc_id % 4 = 0, concat('off', doc_id % 7), '') as error", "if(doc_id % 5 = 0, source, '') as prediction_text")
    return canon.merge_offline(inference, offline).select("pos", "sample_id", "offline_pass", "error", "prediction_text")


@query("SELECT doc_id, url FROM documents JOIN pages ON doc_id = page_id")
def j3_file_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('v', doc_id, '.mp4')").alias("video_filename"))
    questions = table(spark, sf_dir, "pages").select(F.expr("concat('v', page_id, '.mp4')").alias("video_filename"), "url")
    return sequences.join_by_file(videos, questions, "video_filename").select("doc_id", "url")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'puzzles/' || doc_id % 3 || '__a' || doc_id || '.png' WHEN 1 THEN doc_id % 3 || '__a.png' WHEN 2 THEN doc_id % 3 || '__' || doc_id || '.png' WHEN 3 THEN 'a/b/' || doc_id % 3 || '__c.png' ELSE '' END AS new_path FROM documents""")
def j4_remap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "case doc_id % 5 when 0 then concat('puzzles/a', doc_id, '.png') when 1 then 'a.png' when 2 then concat('/abs/x/', doc_id, '.png') when 3 then 'a/b/c.png' else '' end as path"
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 3 as worker", path)
    return canon.remap_paths(own, "path", "worker").select("doc_id", "new_path")


@query("""SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN 'puzzles/w' || doc_id % 3 || '__' || doc_id || '.png' ELSE 'puzzles/' || doc_id || '.png' END AS image, 'w' || doc_id % 3 || '__s.png' AS solution,
  '["w' || doc_id % 3 || '__s.png","' || CASE WHEN doc_id % 2 = 0 THEN 'puzzles/w' || doc_id % 3 || '__' || doc_id || '.png' ELSE 'puzzles/' || doc_id || '.png' END || '","gone.png"]' AS images,
  'w' || doc_id % 3 || '__s.png' AS answer_image, lang AS answer_text, source AS note FROM documents""")
def j4_remap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("doc_id as pos", "concat('w', doc_id % 3) as worker", "concat('puzzles/', doc_id, '.png') as image", "lang", "source")
    record = F.struct("image", F.lit("s.png").alias("solution_image_path"), F.array(F.lit("s.png"), F.col("image"), F.lit("gone.png")).alias("images"), F.struct(F.lit("s.png").alias("image"), F.col("lang").alias("text")).alias("ti2ti_answer"), F.col("source").alias("note"))
    files = own.where("pos % 2 = 0").select("worker", F.col("image").alias("path")).unionByName(own.select("worker", F.lit("s.png").alias("path")))
    m = F.col("remapped")
    out = canon.remap_records(own.select("pos", "worker", F.to_json(record).alias("record")), files)
    answer = lambda k: F.get_json_object(canon.value(m, "ti2ti_answer"), f"$.{k}").alias(f"answer_{k}")
    return out.select("pos", canon.value(m, "image").alias("image"), canon.value(m, "solution_image_path").alias("solution"), canon.value(m, "images").alias("images"), answer("image"), answer("text"), canon.value(m, "note").alias("note"))


@query(f"SELECT item_id, count(*) AS attempts, arg_max(error, attempt) AS last_error FROM {RETRY} GROUP BY item_id HAVING max(ok) = 0")
def j5_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "retry")
    return canon.pending(log.select("item_id").distinct(), log)


@query(f"""SELECT path_id, pos, a.truth_cell AS expected, b.pred_cell AS actual, a.truth_cell IS NOT DISTINCT FROM b.pred_cell AS same FROM
  (SELECT path_id, pos, max(truth_cell) AS truth_cell FROM {duck('paths')} GROUP BY ALL) a FULL JOIN (SELECT path_id, pos + path_id % 3 - 1 AS pos, max(pred_cell) AS pred_cell FROM {duck('paths')} GROUP BY ALL) b USING (path_id, pos)""")
def j12_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that begin a place early, in time or late, so that either side has places that the other lacks."""
    own = fixture(spark, sf_dir, "paths")
    late = own.withColumn("pos", F.expr("pos + path_id % 3 - 1"))
    return sequences.aligned(own.withColumnRenamed("truth_cell", "cell"), late.withColumnRenamed("pred_cell", "cell"), ["path_id", "pos"], "cell")


@query(f"SELECT puzzle_id, attempt, pos, coalesce(predicted = expected, false) AS is_correct FROM {CELLS}")
def j13_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, keys = fixture(spark, sf_dir, "cells"), ["puzzle_id", "attempt", "pos"]
    return sequences.judged_cells(own.select(*keys, "expected"), own.where("predicted is not null").select(*keys, "predicted"), keys)


@query(f"""SELECT puzzle_id, CASE WHEN puzzle_id % 3 = 0 THEN 'unmatched' WHEN puzzle_id % 3 = 1 THEN 'not monochrome' ELSE 'kept' END AS state, count(*) AS n FROM {CELLS} GROUP BY 1, 2""")
def j14_vote_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "cells")
    meta = rows.select("puzzle_id").distinct().where("puzzle_id % 3 > 0").selectExpr("puzzle_id", "puzzle_id % 3 = 2 as monochrome")
    state = F.when(F.col("monochrome").isNull(), "unmatched").when(~F.col("monochrome"), "not monochrome").otherwise("kept")
    return rows.join(meta, "puzzle_id", "left").groupBy("puzzle_id", state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 256 AS DOUBLE) WHEN 1 THEN CAST((doc_id + 1) % 256 AS DOUBLE) END AS red FROM documents""")
def j14_base_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of cells without a colour, with two values, and with three."""
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", """case doc_id % 4 when 0 then concat('{"colored_cells":[{"row":1},{"color":[1,2]},{"color":[', doc_id % 256, ',2,3]},{"color":[9,9,9]}]}')
      when 1 then concat('{"colored_cells":[{"color":[', (doc_id + 1) % 256, ',0,0]}]}') when 2 then '{"colored_cells":[{"color":"red"}]}' else '{}' end as record""")
    return own.select("doc_id", votes.base_colour("record")[0].alias("red"))


# Votes and summaries


def _opt(c: str) -> str:
    return OPTION.replace("(t,", f"({c},").replace("trim(t)", f"trim({c})").replace("coalesce(t, '')", f"coalesce({c}, '')")


VOTED = f"""(SELECT attempt, arg_min(opt, (-n) * 100 + r) AS voted FROM (SELECT attempt, opt, count(*) AS n, min(r) AS r FROM (
  SELECT attempt, 0 AS r, {_opt('image_option')} AS opt FROM {AT} UNION ALL SELECT attempt, 1, {_opt('video_option')} FROM {AT} UNION ALL SELECT attempt, 2, {_opt('text_option')} FROM {AT}
  UNION ALL SELECT attempt, 3, {_opt('transcribe_option')} FROM {AT}) WHERE opt IS NOT NULL GROUP BY ALL) GROUP BY attempt)"""
PASSED = f"(SELECT a.*, voted, CASE WHEN attempt % 10 = 0 THEN attempt % 20 = 0 ELSE coalesce(CASE WHEN attempt % 10 = 1 THEN 'A' ELSE voted END = correct_option, false) END AS ok FROM {AT} a LEFT JOIN {VOTED} USING (attempt))"


def channel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.channel_votes(fixture(spark, sf_dir, "attempts"), ["attempt", "puzzle_id", "task_group", "correct_option"])


def explicit(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"explicit": F.expr("if(attempt % 10 = 0, attempt % 20 = 0, cast(null as boolean))"), "transcribed": F.expr("if(attempt % 10 = 1, 'A', '')")})


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = explicit(channel_votes(spark, sf_dir))
    return own.withColumn("ok", R.option_pass(F.col("explicit"), F.col("transcribed"), "voted", "correct_option")).drop("explicit", "transcribed")


@query(f"SELECT attempt, voted FROM {AT} LEFT JOIN {VOTED} USING (attempt)")
def a5_channel_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.channel_votes(fixture(spark, sf_dir, "attempts"), ["attempt"])


@query(f"SELECT attempt, voted, ok FROM {PASSED}")
def r8_option_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voted(spark, sf_dir).select("attempt", "voted", "ok")


REC = f"(SELECT task_group, 'type' || puzzle_id % 7 AS task_type, CASE WHEN attempt % 11 > 0 THEN ok END AS p, CASE WHEN attempt % 13 = 0 THEN 'bad' ELSE '' END AS e FROM {PASSED})"
COUNTS = "count(*) AS total, count(*) FILTER (p) AS passed, count(*) FILTER (NOT p) AS failed, count(*) FILTER (e <> '') AS errors"


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voted(spark, sf_dir).selectExpr("task_group", "concat('type', puzzle_id % 7) as task_type", "if(attempt % 11 > 0, ok, null) as offline_pass", "if(attempt % 13 = 0, 'bad', if(attempt % 2 = 0, '', null)) as error")


A1_BY_GROUP = f"SELECT task_group, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, CAST(0 AS BIGINT) AS errors FROM {PASSED} GROUP BY 1"


@query(f"SELECT {COUNTS} FROM {REC}")
def a1_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_summary(eval_records(spark, sf_dir))


@query(f"SELECT task_group, task_type, CAST(grouping(task_group) * 2 + grouping(task_type) AS INTEGER) AS level, {COUNTS} FROM {REC} GROUP BY GROUPING SETS ((task_group), (task_type), ())")
def a2_grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.grouped_summary(eval_records(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (p) AS correct, round(count(*) FILTER (p) / count(*), 9) AS accuracy FROM {REC}")
def a3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_records(spark, sf_dir).agg(*summary.accuracy(F.col("offline_pass"))).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (last_frame_judgment = 'yes') AS last_frame, count(*) FILTER (audio_judgment = 'yes') AS audio,
  count(*) FILTER (last_frame_judgment = 'yes' AND audio_judgment = 'yes') AS "both", count(*) FILTER (last_frame_judgment = 'yes' OR audio_judgment = 'yes') AS "any" FROM {duck('judged')} WHERE status = 'completed')
SELECT metric, correct, total, round(correct / total, 9) AS accuracy FROM c UNPIVOT (correct FOR metric IN (last_frame, audio, "both", "any"))""")
def a4_judged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.judged_metrics(fixture(spark, sf_dir, "judged")).withColumn("accuracy", F.round("accuracy", 9))


def strict_sql(rows: str) -> str:
    return f"(SELECT puzzle_id, pos, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(CASE WHEN n = top THEN predicted END) END AS voted FROM (SELECT *, max(n) OVER (PARTITION BY puzzle_id, pos) AS top FROM (SELECT puzzle_id, pos, predicted, count(*) FILTER (predicted IS NOT NULL) AS n FROM {rows} GROUP BY ALL) WHERE predicted IS NOT NULL) GROUP BY puzzle_id, pos)"


OPEN = f"(SELECT * FROM {CELLS} WHERE is_clue = 0)"


@query(f"SELECT puzzle_id, pos, voted FROM (SELECT DISTINCT puzzle_id, pos FROM {OPEN}) LEFT JOIN {strict_sql(OPEN)} USING (puzzle_id, pos)")
def a6_strict_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(fixture(spark, sf_dir, "cells").where("is_clue = 0"), ["puzzle_id", "pos"], "predicted")


@query(f"SELECT puzzle_id, pos, arg_min(predicted, CASE WHEN predicted IS NOT NULL THEN first - n * 1000 END) AS voted FROM (SELECT puzzle_id, pos, predicted, count(*) AS n, min(attempt) AS first FROM {OPEN} GROUP BY ALL) GROUP BY puzzle_id, pos")
def a7_first_seen_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(fixture(spark, sf_dir, "cells").where("is_clue = 0"), ["puzzle_id", "pos"], "predicted", "attempt")


@query(f"SELECT puzzle_id, arg_min(l, (-n) * 1000 + ascii(l)) AS voted FROM (SELECT puzzle_id, image_option AS l, count(*) AS n FROM {AT} GROUP BY ALL) GROUP BY puzzle_id")
def a8_frame_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.frame_vote(fixture(spark, sf_dir, "attempts"), ["puzzle_id"], "image_option")


SCORED = f"""(SELECT c.puzzle_id, c.pos, t.expected, v.voted, coalesce(v.voted = t.expected, false) AS vote_right, count(*) AS n_attempts, count(*) FILTER (c.predicted = t.expected) AS n_right FROM {OPEN} c
  JOIN (SELECT puzzle_id, pos, arg_min(expected, attempt) AS expected FROM {OPEN} GROUP BY ALL) t USING (puzzle_id, pos) LEFT JOIN {strict_sql(OPEN)} v USING (puzzle_id, pos) GROUP BY ALL)"""


@query(f"SELECT puzzle_id, count(*) AS n_positions, round(count(*) FILTER (vote_right) / count(*), 9) AS vote_rate, round(sum(n_right) / sum(n_attempts), 9) AS attempt_rate, CAST(grouping(puzzle_id) AS INTEGER) AS overall FROM {SCORED} GROUP BY GROUPING SETS ((puzzle_id), ())")
def a9_vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = votes.vote_report(votes.scored_cells(fixture(spark, sf_dir, "cells")))
    return out.withColumns({c: F.round(c, 9) for c in ("vote_rate", "attempt_rate")})


@query(f"SELECT n_positions, count(*) AS n_puzzles, round(sum(v) / sum(n_positions), 9) AS vote_rate, round(sum(r) / sum(a), 9) AS attempt_rate FROM (SELECT puzzle_id, count(*) AS n_positions, count(*) FILTER (vote_right) AS v, sum(n_right) AS r, sum(n_attempts) AS a FROM {SCORED} GROUP BY 1) GROUP BY 1")
def a10_vote_report_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = votes.vote_report_by_size(votes.scored_cells(fixture(spark, sf_dir, "cells")))
    return out.withColumns({c: F.round(c, 9) for c in ("vote_rate", "attempt_rate")})


@query(f"SELECT puzzle_id, attempt, bool_and(coalesce(predicted = expected, false)) AS right FROM {CELLS} GROUP BY ALL")
def a11_whole_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.whole_sequences(fixture(spark, sf_dir, "cells"))


FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, g, puzzle_image ORDER BY pos) AS k FROM {KEPT}) WHERE k = 1)"


@query(f"""SELECT task_type, n_records, coalesce(n_canonical, 0) AS n_canonical, coalesce(n_kept, 0) AS n_kept, coalesce(n_canonical - n_kept, 0) AS n_dropped FROM (SELECT task_type, count(*) AS n_records FROM {C0} GROUP BY 1)
  LEFT JOIN (SELECT task_type, count(*) AS n_canonical FROM {KEPT} GROUP BY 1) USING (task_type) LEFT JOIN (SELECT task_type, count(*) AS n_kept FROM {FIRST} GROUP BY 1) USING (task_type)""")
def a20_generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canon.canonical(records(spark, sf_dir), F.lit("/root/set"))
    kept = own.where("reject_reason is null")
    expected = own.groupBy("task_type").agg(F.count("*").alias("n"))
    return summary.generation_report(own, kept, canon.keep_first(kept, ["sample_id", "task_group", "puzzle_image"]), expected)


@query(f"""SELECT task_type, count(*) AS n_records, count(*) FILTER (why IS NULL) AS n_canonical, count(*) FILTER (why IS NULL AND k = 1) AS n_kept, count(*) FILTER (why IS NULL AND k > 1) AS n_dropped
  FROM (SELECT *, row_number() OVER (PARTITION BY why IS NULL, sid, g, image ORDER BY pos) AS k FROM {C1}) GROUP BY 1""")
def a20_checked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report out of the metrics of one write; the expected counts are those of the documents."""
    own = canon.canonical(records(spark, sf_dir), F.lit("/root/set"))
    own = gates.with_repeats(own, ["sample_id", "task_group", "puzzle_image"], F.col("reject_reason").isNull())
    kinds = table(spark, sf_dir, "documents").groupBy(F.expr("element_at(array('maze_square', 'color_grid', 'midpoint', 'unknown_task'), int(doc_id % 4 + 1))").alias("t")).count()
    expected = {r.t: r["count"] for r in kinds.collect()}  # four rows
    rules = {"rejected": F.col("reject_reason").isNotNull(), "repeated": F.col("repeated")}
    counts = gates.write_checked(own, shared_folder(spark), {"no type": F.col("task_type").isNull()}, rules, "task_type", sorted(expected))
    gates.expect(counts, expected)
    written = [(k, counts[k]["records"], counts[k]["kept"]) for k in expected]
    by_rule = gates.dropped_by(counts, sorted(expected), list(rules))
    rows = [(k, n, n - by_rule[k]["rejected"], kept, by_rule[k]["repeated"]) for k, n, kept in written]
    return spark.createDataFrame(rows, "task_type string, n_records long, n_canonical long, n_kept long, n_dropped long")


@query("SELECT label AS task, count(*) AS processed, round(sum(d), 6) AS total, round(avg(d), 6) AS average, sum(count(*)) OVER (ORDER BY label) AS processed_so_far, round(sum(sum(d)) OVER (ORDER BY label), 6) AS total_so_far FROM (SELECT label, CAST(vec_id % 17 AS DOUBLE) / 4 AS d FROM embeddings) GROUP BY label")
def a14_distance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.distance_report(table(spark, sf_dir, "embeddings").select(F.col("label").alias("task"), ((F.col("vec_id") % 17).cast("double") / 4).alias("distance")))
    return out.withColumns({c: F.round(c, 6) for c in ("total", "average", "total_so_far")})


# Windows, order, sets


@query(f"SELECT pos, sid AS sample_id FROM {FIRST}")
def w1_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.keep_first(samples(spark, sf_dir), ["sample_id", "task_group", "puzzle_image"]).select("pos", "sample_id")


@query("""SELECT doc_id AS pos, CASE WHEN k = 0 THEN b ELSE printf('%s__%02d', b, k) END AS id FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY lang, b ORDER BY doc_id) - 1 AS k FROM
  (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN printf('%s-%05d', lang, doc_id) WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 9 = 1 THEN ' a ' ELSE 'i' || doc_id % 30 END AS b FROM documents))""")
def w2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("doc_id as pos", "lang as task", "case when doc_id % 8 = 0 then '' when doc_id % 8 = 4 then null when doc_id % 9 = 0 then ' ' when doc_id % 9 = 1 then ' a ' else concat('i', doc_id % 30) end as id")
    return canon.repair_ids(own).select("pos", "id")


@query("SELECT doc_id, printf('row_%06d', row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def w3_default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canon.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return own.select("doc_id", F.format_string("row_%06d", "index").alias("id"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS shard FROM events")
def w4_shard_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canon.numbered(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return own.select("event_id", F.expr("index div 300").alias("shard"))


@query(f"SELECT puzzle_id, pos, arg_min(expected, attempt) AS expected FROM {CELLS} GROUP BY ALL")
def w5_first_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_known(fixture(spark, sf_dir, "cells"), ["puzzle_id", "pos"], "expected", "attempt")


FR = duck("frames")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture without the vectors. A few labels hold all rows, so that frames are numbered in ranges, not in a task a label."""
    own = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), "vec_id")
    return canon.numbered(own, "vec_id", "frame_idx", keys=("video_id",))


@query(f"SELECT video_id, arg_min(vec_id, frame_idx) AS first, arg_max(vec_id, frame_idx) AS last FROM {FR} GROUP BY 1")
def w6_first_last_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ends(frames(spark, sf_dir), ["video_id"], "vec_id", "frame_idx")


@query(f"SELECT video_id, vec_id FROM {FR} WHERE frame_idx % 3 = 0")
def w7_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.strided(frames(spark, sf_dir), "frame_idx", 3).select("video_id", "vec_id")


@query(f"SELECT path_id, array_to_string(list_slice(list(truth_cell ORDER BY p), 1, 3), ',') AS cells FROM (SELECT path_id, truth_cell, min(pos * 100 + truth_cell) AS p FROM {duck('paths')} GROUP BY 1, 2) GROUP BY 1")
def w8_ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sequences.in_order(fixture(spark, sf_dir, "paths"), ["path_id"], "truth_cell", "pos", "c")
    return own.select("path_id", F.array_join(F.transform(sequences.first_mentions("c", 3), lambda x: x.cast("string")), ",").alias("cells"))


@query(f"SELECT item_id, max(attempt) AS attempt, arg_max(error, attempt) AS error FROM {RETRY} GROUP BY 1")
def w9_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "retry").withColumn("at", F.col("attempt"))
    return canon.keep_last(own, ["item_id"], "at").select("item_id", "attempt", "error")


@query("SELECT l_orderkey, min(gap) AS gap, coalesce(min(gap) >= 5, true) AS ok FROM (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS gap FROM lineitem) GROUP BY 1")
def w10_edge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.edge_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 5)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def s1_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id").orderBy("event_id").limit(25)


@query(f"SELECT path_id, array_to_string(list(truth_cell ORDER BY pos DESC, truth_cell DESC), ',') AS cells FROM {duck('paths')} GROUP BY 1")
def s2_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sequences.in_order(fixture(spark, sf_dir, "paths"), ["path_id"], "truth_cell", "pos", "c", descending=True)
    return own.select("path_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cells"))


@query("""SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:1:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), doc_id) - 1 AS position FROM documents) WHERE position >= 10""")
def s3_epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 1, 10, slice_rows=1000)


@query("SELECT task_type, count(*) AS n FROM (SELECT 'a' AS task_type FROM documents UNION ALL SELECT 'b' FROM pages) GROUP BY 1")
def u1_union_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "documents").select(F.lit("a").alias("task_type"))
    return one.unionByName(table(spark, sf_dir, "pages").select(F.lit("b").alias("task_type"))).groupBy("task_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def u2_union_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return one.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query(f"SELECT task_group, attempt, ok FROM {PASSED}")
def u3_union_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = voted(spark, sf_dir)
    parts = [own.where(F.col("task_group") == g).select("task_group", "attempt", "ok") for g in ("eyeballing", "maze", "visual_puzzle")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en')")
def u4_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("lang").distinct()
    return own.join(own.where("lang = 'en'"), "lang", "left_anti")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def u5_content_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


# Exports


@query(f"SELECT sid AS id, ti2i AS prompt, solution_image AS image, puzzle_image AS edit_image, task_type, g AS task_group FROM {KEPT} WHERE ti2i IS NOT NULL")
def e1_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.edit_pairs(samples(spark, sf_dir))


@query(f"""SELECT 'v/' || pos || '.mp4' AS video, ti2v AS prompt, task_type, g AS task_group, sid AS id,
  CASE WHEN pos % 2 = 0 THEN CASE WHEN pos % 5 = 0 THEN 'said ' || pos WHEN pos % 5 = 1 THEN 'asked' WHEN pos % 5 = 2 THEN 'model' ELSE '' END ELSE '' END AS ti2ti_text, CASE WHEN pos % 2 = 0 THEN solution_image ELSE '' END AS ti2ti_image FROM {KEPT} WHERE pos % 3 = 0""")
def e2_video_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir).withColumns({
        "solution_video": F.expr("if(pos % 3 = 0, concat('v/', pos, '.mp4'), null)"), "ti2ti": F.expr("if(pos % 2 = 0, 'edit', null)"),
        "record": F.expr("""case pos % 5 when 0 then to_json(named_struct('ti2ti_answer', named_struct('text', concat(' said ', pos)), 'ti2t_answer', 'no'))
          when 1 then '{"ti2ti_answer":{"text":" "},"ti2t_answer":" asked ","vlm_answer":"no"}' when 2 then '{"ti2ti_answer":{},"ti2t_answer":"","vlm_answer":"model"}' else '{"answer":"no"}' end"""),
    })
    return export.video_rows(own)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of which some have a ti2t prompt, some a blank or no one, with answers of their own, blank ones and none."""
    own = samples(spark, sf_dir).drop("ti2t")
    return own.withColumns({
        "ti2t": F.expr("case pos % 5 when 0 then concat('ask ', pos) when 1 then 'Which one?' when 2 then '' when 4 then concat(' find ', pos) end"),
        "reasoning_image": F.expr("if(pos % 3 = 0, concat('/root/set/why/', pos, '.png'), puzzle_image)"),
        "solution_video": F.expr("if(pos % 3 = 0, concat('v/', pos, '.mp4'), null)"),
        "record": F.expr("""case pos % 7 when 0 then to_json(named_struct('ti2t_answer', concat(' So it is ', pos, '. '))) when 1 then '{"ti2t_answer": " "}' when 2 then '{"ti2t_answer": null}' else '{}' end"""),
    })


#: What the exporters make of them.
ASKED = f"""(SELECT *, CASE pos % 5 WHEN 0 THEN 'ask ' || pos WHEN 1 THEN 'Which one?' WHEN 4 THEN ' find ' || pos END AS ti2t, CASE WHEN pos % 3 = 0 THEN '/root/set/why/' || pos || '.png' ELSE puzzle_image END AS reasoning,
  CASE WHEN pos % 7 = 0 THEN 'So it is ' || pos || '.' ELSE solution END AS answer FROM {KEPT})"""
HUMAN = f"'<image> ' || ti2t || '{T.SFT_SUFFIX}'"


@query(f"SELECT sid AS id, md5({HUMAN}) AS asked, answer AS answered, reasoning AS image, solution FROM {ASKED} WHERE ti2t IS NOT NULL")
def e3_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = export.chat_rows(asked(spark, sf_dir), "sft")
    return own.select("id", F.md5(F.col("messages")[0]["content"]).alias("asked"), F.col("messages")[1]["content"].alias("answered"), F.col("images")[0].alias("image"), "solution")


@query(f"SELECT sid AS sample_id, answer AS answer_text, md5(puzzle_image) AS first_image, md5(solution_image) AS second_image, ti2i AS instruction FROM {ASKED} WHERE ti2i IS NOT NULL")
def e4_edit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = asked(spark, sf_dir)
    paths = own.select(F.col("puzzle_image").alias("path")).unionByName(own.select(F.col("solution_image").alias("path"))).distinct()
    out = export.edit_shards(export.edit_rows(own), paths.withColumn("content", F.col("path").cast("binary")))
    return out.select("sample_id", "answer_text", F.md5(F.col("image_list")[0]).alias("first_image"), F.md5(F.col("image_list")[1]).alias("second_image"), F.col("instruction_list")[0][0].alias("instruction"))


@query(f"SELECT sid AS id, reasoning AS image, solution, {HUMAN} AS human, answer AS gpt FROM {ASKED} WHERE ti2t IS NOT NULL")
def e5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = export.conversations(asked(spark, sf_dir))
    return out.select("id", "image", "solution", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query(f"""SELECT 'pairs' AS mode, sid AS id, solution_image AS image, ti2i AS asked, CAST(NULL AS VARCHAR) AS answered FROM {ASKED} WHERE ti2i IS NOT NULL
  UNION ALL SELECT 'video', sid, 'v/' || pos || '.mp4', ti2v, NULL FROM {ASKED} WHERE pos % 3 = 0
  UNION ALL SELECT 'chat_sft', sid, reasoning, {HUMAN}, answer FROM {ASKED} WHERE ti2t IS NOT NULL
  UNION ALL SELECT 'chat_grpo', sid, reasoning, '<image> ' || ti2t || '{T.GRPO_SUFFIX}', NULL FROM {ASKED} WHERE ti2t IS NOT NULL
  UNION ALL SELECT 'edit', sid, puzzle_image, ti2i, answer FROM {ASKED} WHERE ti2i IS NOT NULL
  UNION ALL SELECT 'vlm', sid, reasoning, {HUMAN}, answer FROM {ASKED} WHERE ti2t IS NOT NULL""")
def e_all_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E5, written in one pass and read back from their folders."""
    path = shared_folder(spark)
    export.write_exports(asked(spark, sf_dir), path, ["Pairs", "video", "chat_sft", " CHAT_GRPO", "edit", "vlm", "vlm", "gif"])
    turn = "messages array<struct<role string, content string>>, images array<string>"
    read = lambda mode, schema, *columns: export.read_export(spark, path, mode, schema).selectExpr(f"'{mode}' as mode", *columns)
    parts = [
        read("pairs", "id string, image string, prompt string", "id", "image", "prompt as asked", "cast(null as string) as answered"),
        read("video", "id string, video string, prompt string", "id", "video", "prompt", "null"),
        read("chat_sft", f"id string, {turn}", "id", "images[0]", "messages[0].content", "messages[1].content"),
        read("chat_grpo", f"id string, {turn}", "id", "images[0]", "messages[0].content", "get(messages, 1).content"),
        read("edit", "sample_id string, puzzle_image string, instruction string, answer_text string", "sample_id", "puzzle_image", "instruction", "answer_text"),
        read("vlm", "id string, image string, conversations array<struct<`from` string, value string>>", "id", "image", "conversations[0].value", "conversations[1].value"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


# Options


def drawn(answer: str, pool: str) -> str:
    """Options in SQL: the answer and three others of a pool, both in the order of a seeded hash."""
    order = lambda items, seed: f"list_transform(list_sort(list_transform({items}, lambda x: {{'h': md5({seed} || ':' || doc_id || ':' || x), 'x': x}})), lambda s: s.x)"
    others = f"list_slice({order(f'list_filter({pool}, lambda y: y <> {answer})', chr(39) + '7' + chr(39))}, 1, 3)"
    return f"array_to_string({order(f'list_append({others}, {answer})', chr(39) + '7:order' + chr(39))}, ',')"


POOL = ["red", "green", "blue", "teal", "pink", "gold"]


@query(f"SELECT doc_id, {drawn('a', str(POOL))} AS options FROM (SELECT doc_id, {POOL}[doc_id % 6 + 1] AS a FROM documents)")
def n1_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.lit(POOL), (F.col("doc_id") % 6 + 1).cast("int")).alias("a"))
    return own.select("doc_id", F.array_join(synth.options(F.col("a"), F.lit(POOL), 4, 7, F.col("doc_id")), ",").alias("options"))


@query(f"SELECT doc_id, {drawn('a', 'range(CASE WHEN a <= 10 THEN 10 WHEN a <= 100 THEN 100 ELSE 1000 END)')} AS options FROM (SELECT doc_id, doc_id % 120 AS a FROM documents)")
def n2_numeric_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 120).cast("int").alias("a"))
    found = synth.numeric_options(F.col("a"), 4, 7, F.col("doc_id"))
    return own.select("doc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("options"))
