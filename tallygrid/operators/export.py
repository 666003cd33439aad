"""Training-set projections of canonical samples, one by one or all of them out of one scan.

An export is a condition and the columns of its rows, so that `fan_out` can work out any number of them beside each other.
Rows that lack what a format needs are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallygrid.functions.text import answer_text, blank, chat_prompt, missing, present, solution_text

Export = tuple[Column, list[Column]]


def _raw(path: str) -> Column:
    return F.get_json_object("record", f"$.{path}")


def _solution() -> Column:
    return solution_text("task_group", "path_cell_ids", "correct_option")


def _answer() -> Column:
    return answer_text(_raw("ti2t_answer"), "task_group", "path_cell_ids", "correct_option")


def _pairs() -> Export:
    return F.col("ti2i").isNotNull(), [F.col("sample_id").alias("id"), F.col("ti2i").alias("prompt"), F.col("solution_image").alias("image"), F.col("puzzle_image").alias("edit_image"), F.col("task_type"), F.col("task_group")]


def _video() -> Export:
    text = F.coalesce(present(_raw("ti2ti_answer.text")), present(F.coalesce(missing(_raw("ti2t_answer")), missing(_raw("vlm_answer")))))
    both = lambda c: F.when(F.col("ti2ti").isNotNull(), blank(c)).otherwise("")
    columns = [F.col("solution_video").alias("video"), F.col("ti2v").alias("prompt"), F.col("task_type"), F.col("task_group"), F.col("sample_id").alias("id"), both(text).alias("ti2ti_text"), both("solution_image").alias("ti2ti_image")]
    return F.col("ti2v").isNotNull() & (F.length("solution_video") > 0), columns


def _chat(mode: str) -> Export:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = turn("user", chat_prompt("ti2t", F.lit(mode)))
    messages = F.array(user, turn("assistant", _answer())) if mode == "sft" else F.array(user)
    return missing("ti2t").isNotNull(), [F.col("sample_id").alias("id"), messages.alias("messages"), F.array("reasoning_image").alias("images"), _solution().alias("solution"), F.col("task_type"), F.col("task_group")]


def _edit() -> Export:
    return missing("ti2i").isNotNull(), [*map(F.col, ("sample_id", "task_group", "task_type")), _answer().alias("answer_text"), F.col("puzzle_image"), F.col("solution_image"), F.col("ti2i").alias("instruction")]


def _vlm() -> Export:
    said = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    turns = F.array(said("human", chat_prompt("ti2t", F.lit("sft"))), said("gpt", _answer()))
    return missing("ti2t").isNotNull(), [F.col("sample_id").alias("id"), F.col("reasoning_image").alias("image"), F.col("task_group"), F.col("task_type"), _solution().alias("solution"), turns.alias("conversations")]


#: The exports by name.
EXPORTS: dict[str, Callable[[], Export]] = {"pairs": _pairs, "video": _video, "chat_sft": lambda: _chat("sft"), "chat_grpo": lambda: _chat("grpo"), "edit": _edit, "vlm": _vlm}


def export(samples: DataFrame, name: str) -> DataFrame:
    keep, columns = EXPORTS[name]()
    return samples.where(keep).select(*columns)


def edit_pairs(samples: DataFrame) -> DataFrame:
    """Target image, input image, prompt."""
    return export(samples, "pairs")


def video_rows(samples: DataFrame) -> DataFrame:
    """Needs a video and a prompt. Where the text-and-image mode is on, the text is that of the raw record's
    ti2ti_answer, else its ti2t_answer or, where that is null or '', its vlm_answer; without white space at the ends."""
    return export(samples, "video")


def chat_rows(samples: DataFrame, mode: str) -> DataFrame:
    """The ti2t prompt as a user turn, and in sft mode the preferred answer as the assistant's; samples without that prompt have no row."""
    if mode not in ("sft", "grpo"):
        raise ValueError(f"unknown mode {mode!r}")
    return export(samples, f"chat_{mode}")


def edit_rows(samples: DataFrame) -> DataFrame:
    """E4 before the images are read: paths of input and target, instruction and preferred answer."""
    return export(samples, "edit")


def edit_shards(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Image bytes [input, target] with instruction and answer; rows: of `edit_rows`; files: path, content."""
    content = lambda name: files.select(F.col("path").alias(f"_{name}"), F.col("content").alias(name)).hint("merge")
    own = rows.join(content("a"), F.col("puzzle_image") == F.col("_a")).join(content("b"), F.col("solution_image") == F.col("_b"))
    return own.select("sample_id", "task_group", "task_type", "answer_text", F.array("a", "b").alias("image_list"), F.array(F.array("instruction")).alias("instruction_list"))


def conversations(samples: DataFrame) -> DataFrame:
    """E5: the ti2t prompt as a human turn with the sft suffix, the preferred answer as the model's, over the image for reasoning."""
    return export(samples, "vlm")


def known_exports(modes: list[str]) -> list[str]:
    """The modes that there are, once each, whatever their case; none left is an error."""
    known = [m for m in dict.fromkeys(x.strip().lower() for x in modes) if m in EXPORTS]
    if not known:
        raise ValueError(f"no known mode; there are {sorted(EXPORTS)}")
    return known


def fan_out(samples: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, value): the rows of all exports that are asked for as JSON lines, out of one scan of the samples.

    Each sample yields an array with a line for each export that takes it; a union would scan once a branch.
    """
    lines = []
    for name in known_exports(modes):
        keep, columns = EXPORTS[name]()
        lines.append(F.when(keep, F.struct(F.lit(name).alias("mode"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))))
    return samples.select(F.inline(F.array_compact(F.array(*lines))))


def write_exports(samples: DataFrame, path: str, modes: list[str], rows_per_file: int = 100_000) -> None:
    """JSON lines in path/mode=<mode> for each known mode, written in one pass by dynamic partitions."""
    fan_out(samples, modes).write.partitionBy("mode").option("maxRecordsPerFile", rows_per_file).text(path)


def read_export(spark: SparkSession, path: str, mode: str, schema: str | StructType) -> DataFrame:
    """The rows of one export that was written; only its folder is read, and none is an empty table."""
    lines = spark.read.schema("value string, mode string").text(path).where(F.col("mode") == mode)
    return lines.select(F.from_json("value", schema).alias("_r")).select("_r.*")
