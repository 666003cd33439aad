"""Gates in front of a written table: rows are checked, counted and written in one pass, and bad ones are all reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class BadRows(ValueError):
    """Raised after the pass: counts by problem, and the folder in which every bad row stands with its problems."""

    def __init__(self, counts: dict[str, int], path: str):
        super().__init__(f"bad rows: {', '.join(f'{n} {k}' for k, n in counts.items() if n)}; all of them are in {path}")
        self.counts, self.path = counts, path


def with_repeats(rows: DataFrame, keys: list[str], among: Column, order: str = "pos") -> DataFrame:
    """A column `repeated`: true for rows of `among` that aren't the first by position of their key."""
    place = F.row_number().over(W.partitionBy(among, *keys).orderBy(order))
    return rows.withColumn("repeated", among & (place > 1))


def write_checked(rows: DataFrame, path: str, problems: dict[str, Column], drops: dict[str, Column] | None = None, by: str | None = None, groups: list[str] = ()) -> dict[str, dict[str, int]]:
    """Rows without problems to path/state=kept, those that a rule of `drops` takes out to path/state=dropped, and
    those with a problem to path/state=bad, each with the names of what applies; then the counts.

    All counts come from observed metrics of the one write: 'all', and with `by` each of the named groups (a known, short
    list; rows of other groups are in 'all' only). A null condition doesn't apply. Writing goes to its end before anything
    is raised, so that every bad row is reported, not just the first.
    """
    drops = drops or {}
    named = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))) if rules else F.array().cast("array<string>")
    marked = rows.withColumns({"problems": named(problems), "dropped_by": named(drops)})
    state = F.when(F.size("problems") > 0, "bad").when(F.size("dropped_by") > 0, "dropped").otherwise("kept")
    marked = marked.withColumn("state", state)
    scopes = {"all": F.lit(True)} | {g: F.col(by).eqNullSafe(g) for g in groups}
    counts = {}
    for k, scope in enumerate(scopes.values()):
        counts[f"{k}:records"] = F.count_if(scope)
        counts |= {f"{k}:{s}": F.count_if(scope & (F.col("state") == s)) for s in ("kept", "dropped", "bad")}
        counts |= {f"{k}:bad:{p}": F.count_if(scope & F.array_contains("problems", p)) for p in problems} | {f"{k}:dropped:{d}": F.count_if(scope & F.array_contains("dropped_by", d)) for d in drops}
    seen = Observation()
    marked.observe(seen, *(c.alias(k) for k, c in counts.items())).write.partitionBy("state").parquet(path)
    found = {g: {k.split(":", 1)[1]: int(v) for k, v in seen.get.items() if k.split(":", 1)[0] == str(i)} for i, g in enumerate(scopes)}
    if found["all"]["bad"]:
        raise BadRows({p: found["all"][f"bad:{p}"] for p in problems}, f"{path}/state=bad")
    return found


def expect(counts: dict[str, dict[str, int]], expected: dict[str, int]) -> None:
    """Q5: every group has the number of records that was promised; all differences are named."""
    wrong = [f"{g}: {counts.get(g, {}).get('records', 0)} records, not {n}" for g, n in sorted(expected.items()) if counts.get(g, {}).get("records", 0) != n]
    if wrong:
        raise ValueError("; ".join(wrong))


def dropped_by(counts: dict[str, dict[str, int]], groups: list[str], rules: list[str]) -> dict[str, dict[str, int]]:
    """Rows of each group that each rule took out; a row that two rules take out counts for both."""
    return {g: {r: counts[g][f"dropped:{r}"] for r in rules} for g in groups}
