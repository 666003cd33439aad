"""Extension points: vote rules by name, SQL names for expressions, and model calls over request tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.rewards import option_pass
from tallygrid.functions.text import STRIPPED
from tallygrid.operators import votes

Scorer = Callable[[DataFrame], DataFrame]


def option_scorer(rows: DataFrame) -> DataFrame:
    """offline_pass of rows with explicit, transcribed, voted and correct_option."""
    return rows.withColumn("offline_pass", option_pass(F.col("explicit"), F.col("transcribed"), "voted", "correct_option"))


#: Task group -> scorer of its rows; users add their own.
SCORERS: dict[str, Scorer] = {"eyeballing": option_scorer, "maze": option_scorer, "visual_puzzle": option_scorer}


def score(rows: DataFrame, columns: list[str], scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """The rows of each task group through its scorer, united; groups without one are left out."""
    parts = [scorer(rows.where(F.col("task_group") == group)).select(*columns) for group, scorer in sorted((SCORERS if scorers is None else scorers).items())]
    if not parts:
        raise ValueError("no scorer")
    return reduce(DataFrame.unionByName, parts)


#: Rule name -> (rows, keys, value) -> (keys, voted); `attempt` orders the rows.
VOTES: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "strict": lambda rows, keys, value: votes.majority(rows, keys, value),
    "first_seen": lambda rows, keys, value: votes.majority(rows, keys, value, "attempt"),
    "least": votes.frame_vote,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPACE, _EDGES, _ANSWER, _LETTER, _LIST, _WHOLE, _NUMBER = map(_quoted, (r"(?U)\s+", r"(?U)^\s+|\s+$", r"(?U)^answer\s*:\s*", r"^\p{L}$", r"(?s)\[(.*?)\]", r"^\[.*\]$", r"^-*[0-9]+$"))

#: Expressions that SQL users call by name, in an order in which each only names those before it.
SQL_FUNCTIONS = {
    "reward_format": ("t STRING", "DOUBLE", f"CASE WHEN regexp_replace(coalesce(t, ''), {_SPACE}, '') <> '' THEN 0.1D ELSE 0D END"),
    "is_wall": ("r BIGINT, g BIGINT, b BIGINT", "BOOLEAN", "greatest(r, g, b) <= 40"),
    "is_maze_red": ("r BIGINT, g BIGINT, b BIGINT", "BOOLEAN", "r >= 150 AND r - greatest(g, b) >= 70"),
    "reward_answer": ("t STRING", "STRING", f"""regexp_replace(CASE WHEN contains(t, '<answer>') AND contains(substring_index(t, '<answer>', -1), '</answer>')
        THEN substring_index(substring_index(t, '<answer>', -1), '</answer>', 1) ELSE coalesce(t, '') END, {_EDGES}, '')"""),
    "free_text": ("t STRING", "STRING", f"regexp_replace(btrim(regexp_replace(lower(reward_answer(t)), {_ANSWER}, ''), {_quoted(STRIPPED)}), {_SPACE}, ' ')"),
    "reward_option": ("completion STRING, solution STRING", "DOUBLE", f"CASE WHEN NOT free_text(completion) RLIKE {_LETTER} THEN -1D WHEN upper(free_text(completion)) = upper(free_text(solution)) THEN 1D ELSE 0D END"),
    "reward_text": ("completion STRING, solution STRING", "DOUBLE", "CASE WHEN free_text(completion) = '' THEN -1D WHEN free_text(completion) = free_text(solution) THEN 1D ELSE 0D END"),
    "answer_path": ("t STRING", "ARRAY<BIGINT>", f"""CASE WHEN reward_answer(t) RLIKE {_LIST} AND NOT exists(filter(transform(split(regexp_extract(reward_answer(t), {_LIST}, 1), ','), x -> trim(x)), x -> x RLIKE {_NUMBER}), x -> try_cast(x AS BIGINT) IS NULL)
        THEN transform(filter(transform(split(regexp_extract(reward_answer(t), {_LIST}, 1), ','), x -> trim(x)), x -> x RLIKE {_NUMBER}), x -> try_cast(x AS BIGINT)) END"""),
    "same_start": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", """coalesce(nullif(array_position(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> NOT (x <=> y)), true), 0) - 1, least(size(a), size(b)))"""),
    "score_path": ("pred ARRAY<BIGINT>, truth ARRAY<BIGINT>", "DOUBLE", """CASE WHEN truth IS NULL THEN -1D WHEN size(truth) = 0 THEN 0D WHEN pred IS NULL THEN -1D WHEN pred = truth THEN 1D
        ELSE try_divide(cast(least(size(truth), same_start(pred, truth) + same_start(reverse(pred), reverse(truth))) AS DOUBLE), greatest(size(truth), size(pred))) END"""),
    "reward_path": ("completion STRING, solution STRING", "DOUBLE", f"score_path(answer_path(completion), CASE WHEN trim(solution) RLIKE {_WHOLE} THEN from_json(solution, 'array<bigint>') END)"),
}


def register_sql(spark: SparkSession) -> None:
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def call_model(requests: DataFrame, call: Callable[[list[str]], list[str]], key: str, text: str = "request", attempts: int = 3) -> DataFrame:
    """(key, response, error, attempts) of a request table; `call` takes a batch of texts. A batch that keeps failing
    gives null responses with the last error, so that pending() picks its rows up again."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            error, found, n = None, [None] * len(batch), 0
            for n in range(1, attempts + 1):
                try:
                    found, error = call(batch[text].tolist()), None
                    break
                except Exception as e:  # a failed call is a row's state, not the job's
                    error = str(e)
            yield batch[[key]].assign(response=found, error=error, attempts=n)

    kind = dict(requests.dtypes)[key]
    return requests.select(key, text).mapInPandas(run, f"`{key}` {kind}, response string, error string, attempts int")


def vote(rows: DataFrame, keys: list[str], value: str, rule: str) -> DataFrame:
    if rule not in VOTES:
        raise ValueError(f"no vote rule {rule!r}; there are {sorted(VOTES)}")
    return VOTES[rule](rows, keys, value).withColumn("rule", F.lit(rule))
