"""Raw task records to canonical samples: prompts, routing, gates, ids, dedup, and the joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.text import answer_body, blank, missing, present, strip, training_prompt
from tallygrid.operators.components import cut

# Names of the ten pattern tasks.
PATTERN_TASKS = [
    "color_grid", "color_hexagon", "color_overlap_squares", "color_size", "polygon_sides_color", "rectangle_height_color", "shape_reflect",
    "shape_size_grid", "size_cycle", "size_grid",
]
#: Mode: keys of which the first present one decides, and keys of which the first non-blank one is taken otherwise.
PROMPT_KEYS = {
    "ti2v": (["ti2v_prompt"], ["prompt"]),
    "ti2i": (["ti2i_prompt"], ["ti2v_prompt", "prompt"]),
    "ti2t": (["ti2t_prompt"], ["vlm_prompt", "gpt5_prompt"]),
    "ti2ti": (["ti2ti_prompt"], ["ti2t_prompt", "vlm_prompt", "gpt5_prompt"]),
}
REQUIRED = ["id", "question", "prompt", "answer"]
# Keys that a pattern record keeps, and keys that hold paths of a record's files.
PATTERN_KEYS = [
    "id", "ti2v_prompt", "ti2i_prompt", "ti2t_prompt", "ti2ti_prompt", "ti2t_answer", "ti2ti_answer", "image", "reasoning_image", "solution_image_path",
    "solution_video_path", "video_fps", "video_num_frames",
]
PATH_KEYS = ["image", "reasoning_image", "solution_image_path", "solution_video_path", "video", "puzzle", "solution"]


def record_map(json: str | Column) -> Column:
    """A record's keys with their values as text; keys with null values stay, so presence and value are told apart."""
    return F.from_json(json, "map<string,string>")


def has(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def value(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def pin(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that are worked out once: through a generator of one row, as filters above a plain projection
    would get a copy of every long expression that they look at."""
    rows = rows.drop(*columns)
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def resolve_prompt(m: Column, mode: str) -> Column:
    """P1"""
    primary, fallback = PROMPT_KEYS[mode]
    out = F.coalesce(*(present(value(m, k)) for k in fallback))
    for key in reversed(primary):
        out = F.when(has(m, key), present(value(m, key))).otherwise(out)
    return out


def raw_prompt(m: Column) -> Column:
    """P2"""
    return strip(F.coalesce(*(resolve_prompt(m, k) for k in ("ti2v", "ti2i", "ti2t")), missing(value(m, "prompt")), F.lit("")))


def task_type(m: Column, name: str | Column) -> Column:
    return F.coalesce(missing(value(m, "task_type")), F.col(name) if isinstance(name, str) else name, F.lit(""))


def task_group(m: Column, name: str | Column) -> Column:
    """P3; null where a record belongs to no group."""
    kind = task_type(m, name)
    return F.when(kind.isin(PATTERN_TASKS), "visual_puzzle").when(has(m, "correct_option"), "eyeballing").when(has(m, "solution_path_cell_ids") | kind.startswith("maze"), "maze")


def absolute(path: Column, base: str | Column) -> Column:
    """Absolute paths as they are, others below base; . and .. are folded."""
    root = F.col(base) if isinstance(base, str) else base
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path)), "/")
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(fold, "/"))


def resolve_assets(rows: DataFrame, files: DataFrame, column: str, root: Column, file: Column, key: str = "pos") -> DataFrame:
    """Rows with `path`, where the asset of a column is, and `found`, whether there is such a file; null without an asset.

    Absolute paths stay. Others are looked for below the dataset's root, then in the folder of its file; what is nowhere
    counts as below the root. files: (path) of all files. Candidates meet the listing in one equi join, which Spark may
    filter beforehand; neither side is broadcast. key is unique.
    """
    given = missing(F.col(column))
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    places = F.when(given.startswith("/"), F.array(given)).otherwise(F.array(absolute(given, root), absolute(given, folder)))
    own = rows.where(given.isNotNull()).select(key, F.posexplode(places).alias("_place", "_path"))
    there = files.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    own = own.join(there.hint("merge"), "_path", "left").withColumn("_missed", F.col("_there").isNull())
    best = own.groupBy(key).agg(F.min(F.struct("_missed", "_place", "_path")).alias("_best"))
    out = rows.drop("path", "found").join(best.hint("merge"), key, "left")
    return out.withColumns({"path": F.col("_best._path"), "found": ~F.col("_best._missed")}).drop("_best")


def canonical(records: DataFrame, base: str | Column, name: str | Column = "task", parsed: str | None = None) -> DataFrame:
    """Records (record: JSON text) with the canonical columns and reject_reason, null for rows that are kept.

    parsed: name of a column that keeps the record as a map, so that what comes after needn't parse it again.
    """
    m, rows = F.col("_m"), pin(records, {"_m": record_map("record")})
    path = lambda x: F.when(missing(x).isNotNull(), absolute(x, base))
    image = missing(value(m, "image"))
    ids = F.from_json(value(m, "solution_path_cell_ids"), "array<string>")
    maze_ids = F.when(value(m, "solution_path_cell_ids").rlike(r"^\s*\["), F.transform(ids, lambda c: c.try_cast("int")))
    pattern = F.coalesce(present(value(m, "answer")), missing(answer_body(F.get_json_object(value(m, "ti2ti_answer"), "$.text"))), missing(answer_body(value(m, "ti2t_answer"))))
    chosen = F.upper(strip(blank(value(m, "correct_option"))))
    rows = rows.withColumns({"task_group": task_group(m, name), "task_type": task_type(m, name)})
    group = F.col("task_group")
    rows = pin(rows, {
        "sample_id": F.coalesce(missing(value(m, "id")), F.concat(F.col("task_type"), F.lit(":"), blank(value(m, "image")))),
        "prompts": F.struct(*(resolve_prompt(m, k).alias(k) for k in PROMPT_KEYS)),
        "prompt_raw": raw_prompt(m),
        "puzzle_image": path(image),
        "reasoning_image": path(F.coalesce(missing(value(m, "reasoning_image")), image)),
        "solution_image": path(missing(value(m, "solution_image_path"))),
        "solution_video": path(F.coalesce(missing(value(m, "solution_video_path")), missing(value(m, "video")))),
        "path_cell_ids": F.when(group == "maze", maze_ids),
        "correct_option": F.when(group == "visual_puzzle", pattern).when(group == "eyeballing", F.when(F.length(chosen) == 1, chosen)),
    })
    no_answer = F.when(group == "maze", F.col("path_cell_ids").isNull()).otherwise(F.col("correct_option").isNull())
    reason = F.when(m.isNull(), "not a record").when(group.isNull(), "no task group").when(F.col("puzzle_image").isNull() | F.col("solution_image").isNull(), "missing asset").when(no_answer, "no answer")
    return rows.withColumns({"prompt_train": training_prompt("task_group", "prompt_raw"), "reject_reason": reason}).withColumns({} if parsed is None else {parsed: m}).drop("_m")


def prompt_for(m: Column, mode: str, prompts: Column, prompt_train: Column) -> Column:
    """P5: the prompt of a mode for a canonical row; m: its raw record. A key that is there but blank disables a mode, not ti2v."""
    legacy = lambda *keys: F.coalesce(*(present(value(m, k)) for k in keys))
    off = F.coalesce(has(m, f"{mode}_prompt") & present(value(m, f"{mode}_prompt")).isNull(), F.lit(False))
    own = {
        "ti2v": [prompts["ti2v"], legacy("ti2v_prompt", "prompt"), missing(prompt_train)],
        "ti2i": [prompts["ti2i"], legacy("ti2i_prompt"), prompts["ti2v"], legacy("ti2v_prompt", "prompt"), missing(prompt_train)],
        "ti2t": [prompts["ti2t"], legacy("ti2t_prompt", "vlm_prompt", "gpt5_prompt")],
        "ti2ti": [prompts["ti2ti"], legacy("ti2ti_prompt"), prompts["ti2t"], legacy("ti2t_prompt", "vlm_prompt", "gpt5_prompt")],
    }[mode]
    found = F.coalesce(*map(missing, own))
    return found if mode == "ti2v" else F.when(~off, found)


def first_prompt(*columns: str) -> Column:
    """P10: first of the columns that isn't blank."""
    return F.coalesce(*(F.when(strip(c) != "", F.col(c)) for c in columns))


def prune(m: Column) -> Column:
    """A pattern record with the keys of PATTERN_KEYS only; keys with null values stay."""
    return F.map_filter(m, lambda k, _: k.isin(PATTERN_KEYS))


def reasoning_image(given: str | Column, image: str | Column) -> Column:
    """The reasoning image, else the puzzle's."""
    return F.coalesce(missing(given), F.col(image) if isinstance(image, str) else image)


def text_source(transcript: str | Column, text: str | Column, content: str | Column, usable: Column) -> Column:
    """The transcript, else the text, else the content where it is usable."""
    named = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(named(transcript), named(text), F.when(usable, named(content)))


def missing_fields(m: Column) -> Column:
    """Required fields that a record lacks."""
    return F.array_except(F.lit(REQUIRED), F.map_keys(m))


def keep_first(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row by position of each key; a key is one small group, however many keys there are."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def keep_last(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """W9, SRC8: the last row by position of each key, without a sort: one aggregate of whole rows."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_row")).select(*keys, "_row.*")


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """rows; reading one that lacks the condition raises."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def repair_ids(rows: DataFrame, task: str = "task", order: str = "pos") -> DataFrame:
    """Ids that are null or '' become task-00000 by position, the k-th repeat of an id gets __0k. order must be unique in a task."""
    own = rows.withColumn("_base", F.coalesce(missing("id"), F.format_string("%s-%05d", F.col(task), F.col(order))))
    k = F.row_number().over(W.partitionBy(task, "_base").orderBy(order)) - 1
    return own.withColumn("_k", k).withColumn("id", F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.format_string("%s__%02d", "_base", "_k"))).drop("_base", "_k")


def numbered(rows: DataFrame, order: str, name: str = "index", most: int = 1_000_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """A column with the row's place in ascending order of a unique long, from 0, without one task that sorts all rows; with
    keys, its place among the rows of its key, however few keys there are.

    Rows are cut into ranges of about `most` rows, written to the shared checkpoint folder, so that a range is the same
    each time it is read; the sizes of the ranges, one row each (and key), are summed up to offsets.
    """
    parts = max(1, -(-rows.count() // most))
    own = cut(rows.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    sizes = own.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_p_{k}") for k in keys), (F.sum("_n").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = own.withColumn("_rn", F.row_number().over(W.partitionBy("_part", *keys).orderBy(order)))
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys)]
    return own.join(before.hint("merge"), same).select(*rows.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name))


def merge_offline(inference: DataFrame, offline: DataFrame) -> DataFrame:
    """Metrics and pass overwritten where an offline row exists, error and prediction_text only by non-empty ones.

    Of repeated inference ids only the last row (by pos) is updated; repeated offline rows apply in turn (by pos).
    """
    by = W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = lambda c: F.max_by(F.when(F.length(c) > 0, F.col(c)), F.when(F.length(c) > 0, F.col("pos")))
    off = offline.groupBy("sample_id").agg(F.max_by(F.struct("offline_pass", "offline_metrics"), "pos").alias("o"), last("error").alias("o_error"), last("prediction_text").alias("o_text"))
    own = inference.withColumn("_last", F.max("pos").over(by) == F.col("pos")).join(off, "sample_id", "left")
    hit = F.col("_last") & F.col("o").isNotNull()
    out = own.withColumns({
        "offline_pass": F.when(hit, F.col("o.offline_pass")).otherwise(F.col("offline_pass")),
        "offline_metrics": F.when(hit, F.col("o.offline_metrics")).otherwise(F.col("offline_metrics")),
        "error": F.coalesce(F.when(hit, F.col("o_error")), F.col("error")),
        "prediction_text": F.coalesce(F.when(hit, F.col("o_text")), F.col("prediction_text")),
    })
    return out.select(*inference.columns)


def pending(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items that no attempt has settled, with the number of attempts and the last error."""
    state = log.groupBy("item_id").agg(F.max("ok").alias("_ok"), F.count("*").alias("attempts"), F.max_by("error", "attempt").alias("last_error"))
    out = items.join(state, "item_id", "left").where("coalesce(_ok, 0) = 0").drop("_ok")
    return out.withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))


def remap_path(path: Column, worker: Column) -> Column:
    """worker__file in the folder of a relative path, or without a folder for an absolute one; null and '' stay."""
    name = F.concat(worker.cast("string"), F.lit("__"), F.substring_index(path, "/", -1))
    folder = F.when(path.startswith("/"), F.lit("")).otherwise(F.regexp_extract(path, "^(.*/)[^/]*$", 1))
    return F.when(F.length(path) > 0, F.concat(folder, name)).otherwise(path)


def remap_paths(rows: DataFrame, path: str, worker: str) -> DataFrame:
    """new_path of a column of paths whose files exist; the same path of a worker always gets the same name."""
    return rows.withColumn("new_path", remap_path(F.col(path), F.col(worker)))


def remap_records(records: DataFrame, files: DataFrame, key: str = "pos", worker: str = "worker") -> DataFrame:
    """Records (key, worker, record) with a map `remapped` of the record's keys, in which the paths of files that exist
    are renamed: those of PATH_KEYS, of the list `images` and of `ti2ti_answer.image`. Lists and objects stay JSON text.

    files: (worker, path) of existing files. A path without one is left alone. key is unique.
    """
    m = F.col("_m")
    rows = pin(records, {"_m": record_map("record")})
    rows = pin(rows, {"_images": F.from_json(value(m, "images"), "array<string>"), "_answer": F.from_json(value(m, "ti2ti_answer"), "map<string,string>")})
    held = F.array_compact(F.array_union(F.array(*(value(m, k) for k in PATH_KEYS), F.try_element_at("_answer", F.lit("image"))), F.coalesce("_images", F.array().cast("array<string>"))))
    there = files.select(F.col(worker).alias("_worker"), F.col("path").alias("_path")).distinct()
    found = rows.select(key, F.col(worker).alias("_worker"), F.explode(F.array_distinct(held)).alias("_path")).join(there.hint("merge"), ["_worker", "_path"])
    names = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_path", remap_path(F.col("_path"), F.col("_worker"))))).alias("_names"))
    new = lambda p: F.coalesce(F.try_element_at("_names", p), p)
    renamed = F.transform_values(m, lambda k, v: (
        F.when(v.isNull(), v).when(k.isin(PATH_KEYS), new(v)).when((k == "images") & F.col("_images").isNotNull(), F.to_json(F.transform("_images", new)))
        .when((k == "ti2ti_answer") & F.col("_answer").isNotNull(), F.to_json(F.transform_values("_answer", lambda n, x: F.when((n == "image") & x.isNotNull(), new(x)).otherwise(x)), {"ignoreNullFields": "false"})).otherwise(v)
    ))
    out = rows.join(names.hint("merge"), key, "left").withColumn("_names", F.coalesce("_names", F.create_map().cast("map<string,string>")))
    return out.select(*records.columns, renamed.alias("remapped"))


def metadata_join(rows: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """Rows with their metadata; error says where there is none. meta has one row for each key."""
    out = rows.join(meta.withColumn("_hit", F.lit(1)), key, "left")
    return out.withColumn("error", F.when(F.col("_hit").isNull(), "Missing sample")).drop("_hit")


def select_tasks(rows: DataFrame, names: list[str] | None, groups: list[str] | None, exclude: list[str]) -> DataFrame:
    """SRC9, P6, U4"""
    out = rows if names is None else rows.where(F.col("task_type").isin(names))
    out = out if groups is None else out.where(F.col("task_group").isin(groups))
    return out.where(~F.col("task_type").isin(exclude)) if exclude else out


def best_candidate(samples: DataFrame, listing: DataFrame, kinds: tuple[str, ...] = ("png", "jpg", "jpeg", "webp")) -> DataFrame:
    """SRC6, J3: path of each sample's file: fixed names first, then any png, then any jpg, then names made of the id."""
    name = F.substring_index("path", "/", -1)
    rank = F.when(name == "output.png", 0).when(name == "generated.png", 1).when(name.endswith(".png"), 2).when(name.endswith(".jpg"), 3)
    rank = rank.when(F.array_contains(F.array(*(F.concat(F.col("sample_id").cast("string"), F.lit(f".{k}")) for k in kinds)), name), 4)
    found = listing.withColumn("_rank", rank).where("_rank is not null").groupBy("sample_id").agg(F.min_by("path", F.struct("_rank", "path")).alias("candidate"))
    return samples.join(found.hint("merge"), "sample_id", "left")
