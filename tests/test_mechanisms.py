"""Checked writes, resumable orders, masks, upserts, settled items and footers: what the registered queries don't show."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import gates, grid, sequences, synth
from tallygrid.sources import sinks
from tallygrid.streaming import results, retries


def test_bad_rows_are_all_reported(spark, tmp_path):
    own = spark.createDataFrame([(k, "ab"[k % 2], None if k % 3 == 0 else k, k // 4) for k in range(20)] + [(20, None, 5, 9)], "pos int, kind string, n int, grp int")
    rules = {"no n": F.col("n").isNull(), "small": F.col("n") < 3}
    with pytest.raises(gates.BadRows, match="7 no n, 2 small") as found:
        gates.write_checked(own, f"{tmp_path}/a", rules)
    assert found.value.counts == {"no n": 7, "small": 2}
    bad = spark.read.parquet(found.value.path)
    assert sorted((r.pos, *r.problems) for r in bad.collect()) == sorted([(k, "no n") for k in range(0, 20, 3)] + [(1, "small"), (2, "small")])
    repeats = gates.with_repeats(own, ["grp"], F.col("n").isNotNull())
    counts = gates.write_checked(repeats, f"{tmp_path}/b", {"late": F.col("pos") > 99}, {"repeated": F.col("repeated"), "no n": F.col("n").isNull()}, "kind", ["a", "b", "c"])
    assert counts["all"] == {"records": 21, "kept": 6, "dropped": 15, "bad": 0, "bad:late": 0, "dropped:repeated": 8, "dropped:no n": 7}
    assert (counts["a"]["records"], counts["b"]["records"], counts["c"]["records"]) == (10, 10, 0)
    kept = spark.read.parquet(f"{tmp_path}/b/state=kept")
    assert sorted(r.pos for r in kept.collect()) == [1, 4, 8, 13, 16, 20] and kept.columns[:4] == own.columns
    gates.expect(counts, {"a": 10, "b": 10})
    with pytest.raises(ValueError, match="b: 10 records, not 11; d: 0 records, not 1"):
        gates.expect(counts, {"a": 10, "b": 11, "d": 1})


def test_checked_write_scans_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    own = spark.range(50).mapInArrow(touch, "id long")
    gates.write_checked(own, f"{tmp_path}/x", {"none": F.col("id") < 0}, {"odd": F.col("id") % 2 == 1})
    assert seen.value == 50


@pytest.mark.parametrize("slice_rows", [1, 7, 100, 10_000])
def test_epochs_go_on_by_number(spark, slice_rows):
    own = spark.range(1000).withColumnRenamed("id", "k")
    whole = [r.k for r in synth.epoch_order(own, "k", 5, 2, slice_rows=slice_rows).orderBy("position").collect()]
    assert sorted(whole) == list(range(1000)) and whole != sorted(whole)
    assert whole == [r.k for r in own.withColumn("h", synth.epoch_key("k", 5, 2)).orderBy("h", "k").collect()]
    for skip in (0, 1, 499, 999, 1000, 5000):
        rest = synth.epoch_order(own.repartition(5), "k", 5, 2, skip, slice_rows).orderBy("position").collect()
        assert [r.k for r in rest] == whole[skip:] and [r.position for r in rest] == list(range(min(skip, 1000), 1000))
    assert [r.k for r in synth.epoch_order(own, "k", 5, 3).orderBy("position").collect()] != whole
    assert synth.epoch_order(own.limit(0), "k", 5, 3).count() == 0


def test_valid_grids_by_masks(spark):
    base = [[(r % 3 * 3 + r // 3 + c) % 9 + 1 for c in range(9)] for r in range(9)]
    grids = {"good": base}
    for name, (r, c, v) in {"repeat": (0, 0, base[0][1]), "zero": (3, 3, 0), "ten": (8, 8, 10), "null": (4, 4, None), "far": (2, 2, 66)}.items():
        own = [row[:] for row in base]
        own[r][c] = v
        grids[name] = own
    swapped = [row[:] for row in base]
    swapped[0], swapped[3] = swapped[3], swapped[0]  # rows and columns are right, boxes aren't
    rows = [(k, r, c, v) for k, g in (grids | {"boxes": swapped}).items() for r, row in enumerate(g) for c, v in enumerate(row)]
    rows += [("short", r, c, base[r][c]) for r in range(9) for c in range(9) if (r, c) != (5, 5)] + [("twice", r, c, base[r][c]) for r in range(9) for c in range(9)] + [("twice", 0, 0, base[0][0])]
    rows += [("off", r, c if (r, c) != (1, 1) else 9, base[r][c]) for r in range(9) for c in range(9)]
    found = {r.puzzle_id: r.valid for r in grid.valid_grids(spark.createDataFrame(rows, "puzzle_id string, row int, col int, value int"), 9).collect()}
    assert found == {k: k == "good" for k in ("good", "repeat", "zero", "ten", "null", "far", "boxes", "short", "twice", "off")}
    for n in (8, 64):
        with pytest.raises(ValueError):
            grid.valid_grids(spark.createDataFrame(rows, "puzzle_id string, row int, col int, value int"), n)


def test_upsert_of_changed_groups(spark, tmp_path):
    """Two drains; the second writes the buckets of its own groups only, and a repeated batch changes nothing."""
    source, table, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "table", "checkpoint"))
    schema = "task_group string, offline_pass boolean, error string"

    def drain(rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        return results.upsert(results.running_summary(results.results(spark, source, schema)), table, checkpoint, ["task_group"], 16)

    first = drain([(f"g{k % 6}", k % 3 == 0, "") for k in range(60)])
    assert {r.task_group: r.total for r in first.collect()} == {f"g{k}": 10 for k in range(6)}
    before = {p.name for p in (tmp_path / "table").glob("batch=*")}
    second = drain([("g1", True, "x"), ("new", None, "")])
    found = {r.task_group: (r.total, r.errors) for r in second.collect()}
    assert found == {f"g{k}": (10, 0) for k in (0, 2, 3, 4, 5)} | {"g1": (11, 1), "new": (1, 0)}
    late = [p for p in (tmp_path / "table").glob("batch=*") if p.name not in before]
    assert len(late) == 1 and 1 <= len(list(late[0].glob("bucket=*"))) <= 2
    newest = results.current(spark, table, second.schema).collect()
    spark.read.schema(second.schema).parquet(str(late[0])).count()
    assert sorted(map(str, newest)) == sorted(map(str, results.current(spark, table, second.schema).collect()))
    assert {r.task_group: r.total for r in results.current(spark, table, second.schema, int(late[0].name[6:])).collect()} == {f"g{k}": 10 for k in range(6)}
    assert second.count() == 7 and drain([("g1", True, "")]).where("task_group = 'g1'").first().total == 12


def sessions(rows, gap, most):
    """The rules, attempt by attempt: settled rows and items that are left, by the last moment of all."""
    out, left, end = [], set(), max(r[4] for r in rows)
    for item in {r[0] for r in rows}:
        seen = None
        for _, attempt, ok, error, at in sorted((r for r in rows if r[0] == item), key=lambda r: (r[4], r[1])):
            if seen and at > seen[2] + gap:
                out.append((item, seen[0], seen[1], False, "timeout"))
                seen = None
            seen = ((seen[0] if seen else 0) + 1, error, at)
            if ok or seen[0] >= most:
                out.append((item, seen[0], seen[1], bool(ok), "done" if ok else "attempts"))
                seen = None
        if seen and seen[2] + gap <= end:
            out.append((item, seen[0], seen[1], False, "timeout"))
        elif seen:
            left.add(item)
    return sorted(out), left


def test_settled_items_leave_no_state(spark, tmp_path):
    """A restart from the checkpoint between two drains; the store holds the items that aren't settled, and no others."""
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k % 9, k, int(rng.random() < 0.15), f"e{k % 4}", int(k * 1000 + rng.randrange(900))) for k in range(150) if not (k % 9 == 3 and k > 60)]
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for part in (rows[:70], rows[70:]):
        own = spark.createDataFrame([(*r[:4], start + datetime.timedelta(milliseconds=r[4])) for r in part], "item_id long, attempt long, ok int, error string, ts timestamp")
        own.repartition(3).write.mode("append").parquet(source)
        found = retries.drain_settled(spark.readStream.schema(own.schema).parquet(source), 20_000, out, checkpoint, max_attempts=4)
    settled, left = sessions(rows, 20_000, 4)
    assert sorted((r.item_id, r.attempts, r.last_error, r.done, r.reason) for r in found.collect()) == settled
    assert {x[4] for x in settled} == {"done", "attempts", "timeout"} and left
    held = spark.read.format("statestore").option("stateVarName", "attempts").load(checkpoint)
    assert {r.key.item_id for r in held.collect()} == left


def test_footers_are_read_not_rows(spark, tmp_path):
    sinks.write_shards(spark.range(1000).withColumn("text", F.repeat(F.md5(F.col("id").cast("string")), 200)), f"{tmp_path}/s p=1", "id", 300)
    found = sinks.shard_info(spark, f"{tmp_path}/s p=1")
    assert sorted((r.shard, r.rows, r.row_groups) for r in found.collect()) == [(0, 300, 1), (1, 300, 1), (2, 300, 1), (3, 100, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_many_small_shards_are_written_by_many_tasks(spark, tmp_path):
    sinks.write_shards(spark.range(300), f"{tmp_path}/s", "id", 1, shards_per_task=32)
    written = sinks.shard_info(spark, f"{tmp_path}/s").collect()
    assert sorted((r.shard, r.rows) for r in written) == [(k, 1) for k in range(300)]
    assert len({r.file.rsplit("/", 1)[1].split("-")[1] for r in written}) > 5


def test_sequences(spark):
    own = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (1, 3, "a"), (2, 5, None)], "k int, pos int, v string")
    assert {r.k: r.v for r in sequences.first_known(own, ["k"], "v", "pos").collect()} == {1: "a", 2: None}
    assert {r.k: (r.first, r.last) for r in sequences.ends(own, ["k"], "v", "pos").collect()} == {1: ("a", "a"), 2: (None, None)}
    listed = sequences.in_order(own, ["k"], "v", "pos", "c").select("k", sequences.first_mentions("c", 2).alias("c"))
    assert {r.k: r.c for r in listed.collect()} == {1: ["a", None], 2: [None]}
    assert [r.v for r in sequences.strided(own.where("k = 1"), "pos", 3).collect()] == ["a", "a"] and sequences.strided(own, "pos", 0).count() == 5
    late = own.withColumn("pos", F.col("pos") + 1)
    found = {(r.k, r.pos): (r.expected, r.actual, r.same) for r in sequences.aligned(own, late, ["k", "pos"], "v").collect()}
    assert found == {(1, 0): ("a", None, False), (1, 1): (None, "a", False), (1, 2): ("b", None, False), (1, 3): ("a", "b", False), (1, 4): (None, "a", False), (2, 5): (None, None, True), (2, 6): (None, None, True)}
    given = ['[{"row": 1, "col": 2, "expected": 3, "is_clue": false}, {"row": null, "col": 2, "expected": 3}, {"row": 1, "col": 3, "expected": null}, {"row": 0, "col": 0, "expected": 1, "is_clue": true}]', "broken", None]
    cells = sequences.attempt_cells(spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, payload string"), ["k"])
    assert sorted((r.k, r.row, r.col, r.expected or 0) for r in cells.collect()) == [(0, 1, 2, 3), (0, 1, 3, 0)]
    gaps = sequences.edge_gaps(spark.createDataFrame([(1, 1.0), (1, 7.0), (1, 9.5), (2, 4.0)], "k int, x double"), ["k"], "x", 3)
    assert {r.k: (r.gap, r.ok) for r in gaps.collect()} == {1: (2.5, False), 2: (None, True)}
