"""Queries of text functions and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import rewards as R
from tallygrid.functions import text as T
from tallygrid.plans.fixtures import duck, fixture, table
from tallygrid.plans.registry import query


def sql_map(values: dict) -> str:
    return "MAP {" + ", ".join(f"{k!r}: {v!r}" for k, v in values.items()) + "}"


A = duck("answers")
VARIANTS = sql_map({v: k for k, vs in T.SPELLINGS.items() for v in vs})
WORDS = sql_map({k: v[0] for k, v in T.SPELLINGS.items()})
LETTER = f"""coalesce(({VARIANTS})[list_filter(list_transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z]+(?:-[A-Za-z]+)?'), lambda w: upper(w)), lambda w: ({VARIANTS})[w] IS NOT NULL)[1]],
  list_filter(list_transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z]+(?:-[A-Za-z]+)?'), lambda w: upper(w)), lambda w: length(w) = 1)[1])"""


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


PLAIN = rf"""(SELECT *, {squeeze(r"regexp_replace(regexp_replace(regexp_replace(coalesce(p, ''), '\s*Speak out[^.]*\.[^.]*\.', '', 'gi'), '\s*In portrait[^.]*\.', '', 'gi'), '\s*Static camera\.', '', 'gi')")} AS u FROM
  (SELECT doc_id, lang, source, CASE doc_id % 4 WHEN 0 THEN 'Mark  it. Speak out the letter. Loudly. In Portrait, please. ' || source WHEN 1 THEN source || '  STATIC camera.' WHEN 2 THEN ' ' END AS p FROM documents))"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("case doc_id % 4 when 0 then concat('Mark  it. Speak out the letter. Loudly. In Portrait, please. ', source) when 1 then concat(source, '  STATIC camera.') when 2 then ' ' end")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", p.alias("p"))


@query(f"SELECT doc_id, {LETTER} AS letter FROM {A}")
def t1_spelled_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.spelled_letter("t").alias("letter"))


@query(f"SELECT doc_id, ({WORDS})[{LETTER}] AS word FROM {A}")
def t2_spelled_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.spelled_word("t").alias("word"))


@query(f"SELECT doc_id, CASE WHEN u <> '' AND NOT ends_with(u, '.') THEN u || '.' ELSE u END AS plain FROM {PLAIN}")
def t3_plain_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("doc_id", T.plain_prompt("p").alias("plain"))


@query(f"SELECT doc_id, md5({squeeze('text')}) AS digest FROM documents")
def t4_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse("text")).alias("digest"))


@query(f"""SELECT doc_id, mode, CASE WHEN c = '' OR contains(lower(c), 'provided puzzle image') THEN c ELSE coalesce(({sql_map(T.PREFIXES)})[mode], '') || c END AS prompt FROM
  (SELECT doc_id, {squeeze('q')} AS c, mode FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The  Provided Puzzle Image of ' || source WHEN 1 THEN ' see ' || lang END AS q FROM documents),
  (SELECT unnest(['ti2v', 'ti2i', 'ti2t', 'ti2ti', 'x']) AS mode))""")
def t5_image_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("case doc_id % 3 when 0 then concat('The  Provided Puzzle Image of ', source) when 1 then concat(' see ', lang) end")
    docs = table(spark, sf_dir, "documents").select("doc_id", q.alias("q"), F.explode(F.lit(["ti2v", "ti2i", "ti2t", "ti2ti", "x"])).alias("mode"))
    return docs.select("doc_id", "mode", T.image_prompt("q", F.col("mode")).alias("prompt"))


BODY = r"(SELECT *, CASE WHEN lower(s) LIKE 'answer:%' THEN trim(substr(s, 8)) ELSE s END AS b FROM (SELECT doc_id, trim(coalesce(t, '')) AS s FROM {}))".format(A)


@query(f"SELECT doc_id, CASE WHEN s = '' THEN '' ELSE 'Answer: ' || CASE WHEN regexp_matches(b, '^[A-Za-z]') THEN upper(substr(rtrim(b, '.'), 1, 1)) || substr(rtrim(b, '.'), 2) ELSE rtrim(b, '.') END || '.' END AS sentence FROM {BODY}")
def t6_answer_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.answer_sentence("t").alias("sentence"))


@query(f"SELECT doc_id, trim(rtrim(b, '.')) AS body FROM {BODY}")
def t7_answer_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.answer_body("t").alias("body"))


@query(f"""SELECT doc_id, g, CASE WHEN g = 'maze' THEN '{T.MAZE_PROMPT}' WHEN w = '' THEN '' ELSE CASE WHEN g = 'visual_puzzle' THEN '{T.PREFIXES["ti2v"]}' ELSE '{T.PREFIXES["ti2i"]}' END || w END AS prompt FROM
  (SELECT doc_id, g, CASE WHEN g = 'eyeballing' THEN CASE WHEN u <> '' AND NOT ends_with(u, '.') THEN u || '.' ELSE u END ELSE {squeeze('p')} END AS w FROM {PLAIN}, (SELECT unnest(['maze', 'eyeballing', 'visual_puzzle', 'other']) AS g))""")
def t8_training_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).withColumn("g", F.explode(F.lit(["maze", "eyeballing", "visual_puzzle", "other"])))
    return own.select("doc_id", "g", T.training_prompt("g", "p").alias("prompt"))


@query(f"""SELECT conv_id, turn, md5('<image> ' || question || CASE WHEN conv_id % 2 = 0 THEN '{T.SFT_SUFFIX}' ELSE '{T.GRPO_SUFFIX}' END) AS digest FROM {duck('replies')} r""")
def t9_chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("conv_id") % 2 == 0, "sft").otherwise("grpo")
    return fixture(spark, sf_dir, "replies").select("conv_id", "turn", F.md5(T.chat_prompt("question", mode)).alias("digest"))


CAM = [s.replace("'", "''") for s in T.CAMERA]


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN ends_with(s, '{c}') THEN trim(substr(s, 1, length(s) - {len(c)}))" for c in CAM)} ELSE s END AS prompt FROM
  (SELECT doc_id, trim('go ' || source || CASE doc_id % 6 {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CAM))} ELSE '' END) AS s FROM documents)""")
def t10_without_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = " ".join(f"when {k} then '{c}'" for k, c in enumerate(T.CAMERA))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_camera(F.expr(f"concat('go ', source, case doc_id % 6 {ends} else '' end)")).alias("prompt"))


def reward_answer_sql(t: str) -> str:
    parts = f"string_split(coalesce({t}, ''), '<answer>')"
    return rf"trim(CASE WHEN len({parts}) > 1 AND contains({parts}[-1], '</answer>') THEN string_split({parts}[-1], '</answer>')[1] ELSE coalesce({t}, '') END)"


def free_text_sql(t: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower({reward_answer_sql(t)}), '^answer\s*:\s*', ''), E' \t\r\n\"''`.,;:!?()[]{{}}'), '\s+', ' ', 'g')"


@query(f"SELECT doc_id, {reward_answer_sql('t')} AS answer FROM {A}")
def t11_reward_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.reward_answer("t").alias("answer"))


TAGGED = r"(SELECT doc_id, CASE WHEN len(p) > 1 AND contains(lower(p[-1]), '</answer>') THEN trim(substr(p[-1], 1, strpos(lower(p[-1]), '</answer>') - 1)) END AS answer FROM (SELECT doc_id, regexp_split_to_array(t, '(?i)<answer>') AS p FROM {}))".format(A)


@query(f"SELECT * FROM {TAGGED}")
def t12_tagged_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.tagged_answer("t").alias("answer"))


@query(f"SELECT doc_id, {free_text_sql('t')} AS answer FROM {A}")
def t13_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.free_text("t").alias("answer"))


NUMS = sql_map({w: n for n, w in enumerate(T.NUMBERS)})


@query(rf"""SELECT doc_id, CAST(coalesce(TRY_CAST(list_filter(regexp_extract_all(o, '\b\d+\b'), lambda x: true)[-1] AS BIGINT), ({NUMS})[list_filter(regexp_extract_all(lower(o), '[a-z]+'), lambda w: ({NUMS})[w] IS NOT NULL)[-1]]) AS BIGINT) AS n FROM
  (SELECT doc_id, CASE WHEN contains(t, '**') THEN array_to_string(regexp_extract_all(t, '\*\*(.*?)\*\*', 1), ' ') ELSE coalesce(t, '') END AS o FROM {A})""")
def t14_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.last_number("t").alias("n"))


PALETTE = ["red", "yellow", "blue", "magenta"]


@query(f"""SELECT doc_id, array_to_string(list_slice(list_filter(o, lambda c, i: list_position(o, c) = i), 1, 3), ',') AS colours FROM
  (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(string_split(coalesce(t, ''), '</think>')[-1]), '[a-z]+'), lambda w: ({sql_map(T.COLOURS)})[w]), lambda c: c IN ('red', 'yellow', 'blue')) AS o FROM {A})""")
def t15_colour_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", F.array_join(T.colour_order("t", F.lit(PALETTE[:3])), ",").alias("colours"))


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches({reward_answer_sql('t')}, '\[.*?\]') THEN array_to_string(list_filter(list_transform(string_split(regexp_extract({reward_answer_sql('t')}, '\[(.*?)\]', 1), ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^-*[0-9]+$')), ',') END AS first_path,
  array_to_string(list_transform(list_filter(string_split(regexp_extract_all(coalesce(t, ''), '\[\s*(\d+(?:\s*,\s*\d+)*\s*,?\s*)\]', 1)[-1], ','), lambda x: trim(x) <> ''), lambda x: trim(x)), ',') AS last_path FROM {A}""")
def t16_integer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return fixture(spark, sf_dir, "answers").select("doc_id", joined(T.reward_path("t")).alias("first_path"), joined(T.last_path("t")).alias("last_path"))


@query(rf"SELECT doc_id, nullif(regexp_extract(coalesce(t, ''), '\((https?://[^\s)]+)\)', 1), '') AS url FROM {A}")
def t17_linked_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.linked_url("t").alias("url"))


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 'entry_' || CAST(doc_id AS VARCHAR) ELSE s END || '.mp4' AS name FROM (SELECT doc_id, trim(regexp_replace(coalesce(t, ''), '[^0-9A-Za-z_-]+', '_', 'g'), '_') AS s FROM {A})")
def t18_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", T.file_name("t", "doc_id").alias("name"))


@query(f"SELECT image_id, frame_idx, y, x, CASE WHEN x % 5 > 0 THEN printf('#%02x%02x%02x', r, g, b) END AS hex FROM {duck('pixels')}")
def t19_hex_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.when(F.col("x") % 5 > 0, F.array("r", "g", "b")).otherwise(F.array("r", "g"))
    return fixture(spark, sf_dir, "pixels").select("image_id", "frame_idx", "y", "x", T.hex_colour(rgb).alias("hex"))


@query(f"SELECT conv_id, turn, md5(question || CASE WHEN conv_id % 3 > 0 THEN E'\\nOptions: ' || 'yes' || ', ' || 'no ' || turn ELSE '' END || E'{T.ANSWER_TEMPLATE.encode('unicode_escape').decode()}') AS digest FROM {duck('replies')} r")
def t20_question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.expr("if(conv_id % 3 > 0, array('yes', concat('no ', turn)), cast(array() as array<string>))")
    return fixture(spark, sf_dir, "replies").select("conv_id", "turn", F.md5(T.question_text("question", options)).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_filter(['Use the provided visual puzzle image as the starting frame.', q, 'Go.', 'Static camera.'], lambda p: p <> ''), ' ') AS ti2v,
  'Use the provided visual puzzle image as input. ' || q || ' Replace only the missing question-mark region with the correct answer while keeping every other shape unchanged. Output the solved image.' AS ti2i,
  'Use the provided visual puzzle image to solve the task. ' || q || CASE WHEN o <> '' THEN ' Options: [' || o || ']. Answer with exactly one option.' ELSE ' Answer with the final answer only.' END AS ti2t,
  'Use the provided visual puzzle image as input. ' || q || CASE WHEN o <> '' THEN ' Options: [' || o || ']. First determine the correct option, then replace only the missing question-mark region with that answer while keeping every other shape unchanged. Output the solved image.'
    ELSE ' First determine the missing answer, then replace only the missing question-mark region with that answer while keeping every other shape unchanged. Output the solved image.' END AS ti2ti
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Which ' || lang || '?' END AS q, CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source ELSE '' END AS o FROM documents)""")
def t21_puzzle_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 5 = 0, ' ', concat(' Which ', lang, '? ')) as q", "if(doc_id % 2 = 0, array(lang, ' ', source), null) as o")
    return own.select("doc_id", *(c.alias(k) for k, c in T.puzzle_prompts("q", "o", "Go. ", " Static camera.").items()))


@query(f"SELECT conv_id, turn, md5('Question: ' || question || E'\\n\\nCorrect answer: ' || turn || E'\\n\\nTranscript: ' || completion) AS request, CASE WHEN conv_id % 4 = 0 THEN 'error' WHEN conv_id % 4 < 3 THEN 'yes' ELSE 'no' END AS verdict FROM {duck('replies')} r")
def t22_judging(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.expr("case conv_id % 4 when 1 then 'Yes.' when 2 then 'well, YES' when 3 then 'No' end")
    return fixture(spark, sf_dir, "replies").select("conv_id", "turn", F.md5(T.judge_request("question", F.col("turn").cast("string"), "completion")).alias("request"), T.judge_verdict(response).alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS VARCHAR) WHEN doc_id % 2 > 0 THEN lang ELSE source END AS id FROM documents")
def t23_first_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_id(F.col("doc_id") % 3, F.expr("if(doc_id % 2 > 0, lang, '')"), "source").alias("id"))


PATHS = f"(SELECT path_id, list(truth_cell ORDER BY pos, truth_cell, pred_cell) AS truth, list(pred_cell ORDER BY pos, truth_cell, pred_cell) AS pred FROM {duck('paths')} GROUP BY path_id)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("pos", "truth_cell", "pred_cell")))
    return fixture(spark, sf_dir, "paths").groupBy("path_id").agg(cells.alias("c")).select("path_id", F.col("c.truth_cell").alias("truth"), F.col("c.pred_cell").alias("pred"))


@query(f"""SELECT path_id, g, solution, CASE WHEN path_id % 3 = 0 THEN 'Up ' || path_id ELSE solution END AS answer FROM (
  SELECT path_id, g, CASE g WHEN 'maze' THEN '[' || array_to_string(truth, ', ') || ']' WHEN 'eyeballing' THEN 'AB' ELSE 'ab' END AS solution FROM {PATHS}, (SELECT unnest(['maze', 'eyeballing', 'visual_puzzle']) AS g))""")
def t24_solution_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = paths(spark, sf_dir).withColumn("g", F.explode(F.lit(["maze", "eyeballing", "visual_puzzle"])))
    given = F.expr("case path_id % 3 when 0 then concat(' Up ', path_id, '\n') when 1 then ' ' end")
    return own.select("path_id", "g", T.solution_text("g", "truth", F.lit(" ab ")).alias("solution"), T.answer_text(given, "g", "truth", F.lit("ab ")).alias("answer"))


SOL = "CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN lang ELSE 'yes' END"


@query(f"SELECT doc_id, CAST(CASE WHEN NOT regexp_matches(p, '^[a-z]$') THEN -1 WHEN p = {free_text_sql(SOL)} THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM (SELECT doc_id, lang, {free_text_sql('t')} AS p FROM {A})")
def r1_option_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", R.option_reward("t", F.expr(SOL)).alias("reward"))


@query(f"""SELECT path_id, CAST(CASE WHEN truth = pred THEN 1 ELSE round(least(n, pre + suf) / n, 9) END AS DOUBLE) AS reward FROM (
  SELECT *, len(truth) AS n, coalesce(list_position(list_transform(range(1, len(truth) + 1), lambda i: truth[i] <> pred[i]), true) - 1, len(truth)) AS pre,
    coalesce(list_position(list_transform(range(1, len(truth) + 1), lambda i: truth[-i] <> pred[-i]), true) - 1, len(truth)) AS suf FROM {PATHS})""")
def r2_path_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda c: c.cast("string")), ", "), F.lit("]"))
    completion = F.concat(F.lit("so <answer>"), listed(F.col("pred")), F.lit("</answer>"))
    return paths(spark, sf_dir).select("path_id", F.round(R.path_reward(completion, listed(F.col("truth"))), 9).alias("reward"))


@query(f"SELECT doc_id, CAST(CASE WHEN p = '' THEN -1 WHEN p = {free_text_sql(SOL)} THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM (SELECT doc_id, lang, {free_text_sql('t')} AS p FROM {A})")
def r3_text_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", R.text_reward("t", F.expr(SOL)).alias("reward"))


@query(f"SELECT doc_id, CAST(CASE WHEN trim(coalesce(t, '')) <> '' THEN 0.1 ELSE 0 END AS DOUBLE) AS reward FROM {A}")
def r4_format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", R.format_reward("t").alias("reward"))


@query(f"""SELECT doc_id, score, score >= 0.999 AS passed FROM (SELECT doc_id, CAST(CASE WHEN s = '' THEN NULL WHEN s = '[1, 2]' THEN CASE WHEN NOT regexp_matches(ra, '\\[.*?\\]') THEN -1 ELSE round(2 / 3, 9) END
    WHEN length(s) > 1 THEN CASE WHEN p = '' THEN -1 WHEN p = s THEN 1 ELSE 0 END ELSE CASE WHEN NOT regexp_matches(p, '^[a-z]$') THEN -1 WHEN p = lower(s) THEN 1 ELSE 0 END END AS DOUBLE) AS score
  FROM (SELECT doc_id, {free_text_sql('t')} AS p, {reward_answer_sql('t')} AS ra, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'b' WHEN 3 THEN lang ELSE 'B' END AS s FROM {A}))""")
def r5_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("case doc_id % 5 when 0 then ' ' when 1 then '[1, 2]' when 2 then 'b' when 3 then lang else 'B' end")
    own = fixture(spark, sf_dir, "answers").select("doc_id", F.round(R.reward("t", s), 9).alias("score"))
    return own.withColumn("passed", R.passes("score"))


@query(f"SELECT doc_id, coalesce(lower(answer) = CASE WHEN doc_id % 2 = 0 THEN lower(lang) ELSE 'b' END, false) AS hit FROM {TAGGED} JOIN documents USING (doc_id)")
def r6_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "answers").select("doc_id", R.exact_match("t", F.expr("if(doc_id % 2 = 0, lang, 'B ')")).alias("hit"))


@query("""SELECT event_id, NOT o AND s AND g AND c AS passed, CASE WHEN o THEN 'Red path overlaps walls.' WHEN NOT s THEN 'Red path does not reach the start.' WHEN NOT g THEN 'Red path does not reach the goal.'
  WHEN NOT c THEN 'Red path is not continuous between start and goal.' ELSE 'Red path successfully connects start to goal.' END AS message
FROM (SELECT event_id, event_id % 7 = 0 AS o, event_id % 5 > 0 AS s, event_id % 3 > 0 AS g, event_id % 2 > 0 AS c FROM events)""")
def r7_maze_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 7 = 0 as o", "event_id % 5 > 0 as s", "event_id % 3 > 0 as g", "event_id % 2 > 0 as c")
    return own.select("event_id", R.maze_pass("o", "s", "g", "c").alias("passed"), R.maze_message("o", "s", "g", "c").alias("message"))
