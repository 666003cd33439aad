"""Ties, nulls, blanks and malformed input: the rules that the given tables don't show."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import geometry as G
from tallygrid.functions import pixels as P
from tallygrid.functions import rewards as R
from tallygrid.functions import text as T
from tallygrid.operators import canon, components, export, grid, summary, synth, votes
from tallygrid.sources import readers, sinks


def column(spark, values, expression, kind="string"):
    own = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in own.orderBy("i").select(expression.alias("x")).collect()]


def test_spelled_letter(spark):
    given = [None, "", "I pick a", "alpha-bravo then Golf", "X-ray", "alpha-bravo b", "juliett", "no letters 12"]
    assert column(spark, given, T.spelled_letter("t")) == [None, None, "I", "G", "X", "B", "J", None]


def test_answers(spark):
    given = [None, "<answer>a</answer> <answer> b </answer> c", "</answer><answer>x", "<ANSWER>Q</ANSWER>", " z\t"]
    assert column(spark, given, T.reward_answer("t")) == ["", "b", "</answer><answer>x", "<ANSWER>Q</ANSWER>", "z"]
    assert column(spark, given, T.tagged_answer("t")) == [None, "b", None, "Q", None]
    assert column(spark, ["Answer: 'Yes'.", "(B)", "  two\n words ", None], T.free_text("t")) == ["yes", "b", "two words", ""]
    assert column(spark, ["answer: yes..", "", None, "éa"], T.answer_sentence("t")) == ["Answer: Yes.", "", "", "Answer: Éa."]


def test_numbers_and_paths(spark):
    assert column(spark, ["**3** of 9", "seven or Twelve", "x1y", None, "** ** none"], T.last_number("t")) == [3, 12, None, None, None]
    assert column(spark, ["[1, x, 2] [3]", "no", "[--5]", "[]", "<answer>[7]</answer>[8]"], T.reward_path("t")) == [[1, 2], None, None, [], [7]]


def test_path_reward(spark):
    own = spark.createDataFrame([("[1,2,3]", "[1,2,3]"), ("[1,9,3]", "[1,2,3]"), ("none", "[1]"), ("[1]", "[]"), ("[1]", "oops"), ("[1,1]", "[1]"), ("[--5]", "[5]")], "c string, s string")
    assert [round(r[0], 4) for r in own.select(R.path_reward("c", "s")).collect()] == [1.0, round(2 / 3, 4), -1.0, 0.0, -1.0, 0.5, -1.0]


def test_path_reward_is_bounded_and_matches_a_loop(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 2) for _ in range(rng.randint(0, 6))], [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]) for _ in range(150)]

    def one(pred, truth):
        if not truth:
            return 0.0
        if pred == truth:
            return 1.0
        start = next((i for i, (a, b) in enumerate(zip(pred, truth)) if a != b), min(len(pred), len(truth)))
        end = next((i for i, (a, b) in enumerate(zip(pred[::-1], truth[::-1])) if a != b), min(len(pred), len(truth)))
        return min(len(truth), start + end) / max(len(truth), len(pred))

    own = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(rows)], "i int, c string, s string")
    found = [r[0] for r in own.orderBy("i").select(R.path_reward("c", "s")).collect()]
    assert found == pytest.approx([one(*r) for r in rows])


def test_channel_vote_ties(spark):
    own = spark.createDataFrame([(1, "a", "b", "b", None), (2, "a", "b", None, None), (3, None, "", " ", None), (4, "c", "a", "a", "c")], "k int, image_option string, video_option string, text_option string, transcribe_option string")
    assert {r.k: r.voted for r in votes.channel_votes(own, ["k"]).collect()} == {1: "B", 2: "A", 3: None, 4: "C"}


def test_majorities(spark):
    own = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (2, 2, "x"), (3, 0, None), (4, 3, "x"), (4, 1, "y")], "k int, attempt int, v string")
    as_map = lambda df: {r.k: r.voted for r in df.collect()}
    assert as_map(votes.majority(own, ["k"], "v")) == {1: None, 2: "x", 3: None, 4: None}
    assert as_map(votes.majority(own, ["k"], "v", "attempt")) == {1: "x", 2: "x", 3: None, 4: "y"}
    assert as_map(votes.frame_vote(own, ["k"], "v")) == {1: "x", 2: "x", 3: None, 4: "x"}
    assert as_map(votes.majority(own.repartition(1), ["k"], "v", "attempt")) == as_map(votes.majority(own.repartition(8), ["k"], "v", "attempt"))


def test_summary_is_tri_state(spark):
    own = spark.createDataFrame([(True, ""), (False, "bad"), (None, None)], "offline_pass boolean, error string")
    assert summary.run_summary(own).first()[:] == (3, 1, 1, 1)
    assert summary.run_summary(own.limit(0)).first()[:] == (0, 0, 0, 0)
    assert own.limit(0).agg(*summary.accuracy(F.col("offline_pass"))).first()[:] == (0, 0, 0.0)


def test_presence_and_null(spark):
    given = ['{"ti2i_prompt": null, "prompt": "p"}', '{"prompt": " p "}', '{"ti2i_prompt": " q "}', "broken", "{}"]
    assert column(spark, given, canon.resolve_prompt(canon.record_map("t"), "ti2i")) == [None, "p", "q", None, None]


def test_repaired_ids(spark):
    own = spark.createDataFrame([(0, "t", "a"), (1, "t", "a"), (2, "t", None), (3, "t", " "), (4, "t", "a")], "pos int, task string, id string")
    assert [r.id for r in canon.repair_ids(own).orderBy("pos").collect()] == ["a", "a__01", "t-00002", " ", "a__02"]


def test_keep_first_is_idempotent(spark):
    own = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "pos int, k string")
    once = canon.keep_first(own, ["k"])
    assert sorted(r.pos for r in once.collect()) == sorted(r.pos for r in canon.keep_first(once, ["k"]).collect()) == [1, 2]
    assert sorted(r.pos for r in canon.keep_last(own.withColumn("at", F.col("pos")), ["k"], "at").collect()) == [2, 3]


def test_numbered(spark):
    own = spark.range(0, 2000, 7).withColumn("id", (F.col("id") * 31) % 2003)
    found = canon.numbered(own, "id", most=30).orderBy("id").collect()
    assert [r["index"] for r in found] == list(range(len(found)))
    assert canon.numbered(own.limit(0), "id").count() == 0


def test_numbered_within_keys(spark):
    """Two keys and no key, cut into many ranges."""
    own = spark.range(300).selectExpr("id * 31 % 307 as id", "if(id % 7 = 0, null, if(id % 3 = 0, 'a', 'b')) as k")
    found = canon.numbered(own, "id", most=20, keys=("k",)).collect()
    assert len(found) == 300
    for k in ("a", "b", None):
        assert [r["index"] for r in sorted((r for r in found if r.k == k), key=lambda r: r.id)] == list(range(sum(r.k == k for r in found)))


@pytest.mark.parametrize("name", ["w6_first_last_frame", "w7_stride"])
def test_frames_are_numbered_within_labels(spark, tmp_path, name):
    """Videos are labels and frames their rows by vec_id, as FIXTURES.md has it, whatever the ids are."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(k * 37 % 401, [0.0], "ab"[k % 5 > 1]) for k in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    places = {v: [i for i, _, x in sorted(rows) if x == v] for v in "ab"}
    expected = [(v, own[0], own[-1]) for v, own in places.items()] if name[1] == "6" else [(v, i) for v, own in places.items() for i in own[::3]]
    found = sorted(r[:] for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert found == sorted(expected) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_require_raises(spark):
    with pytest.raises(Exception, match="no id"):
        canon.require(spark.range(3), F.col("id") > 0, "no id").collect()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_grid_paths_and_regions(spark):
    rows = ["S.#G", ".##.", "...."]
    cells = spark.createDataFrame([(g, y, x) for g in (1, 2) for y, r in enumerate(rows) for x, c in enumerate(r) if c != "#" and not (g == 2 and y == 2)], "grid_id int, y int, x int")
    ends = spark.createDataFrame([(1, 0, 0, 3, 0), (2, 0, 0, 3, 0)], "grid_id int, sx int, sy int, gx int, gy int")
    assert {r.grid_id: r.steps for r in grid.shortest_paths(cells, ends).collect()} == {1: 7, 2: None}
    assert {r.grid_id: r.connected for r in grid.connected(cells, ["grid_id"], ends).collect()} == {1: True, 2: False}


def test_geometry(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    one = spark.range(1)
    a, b, c = p(0, 0), p(4, 0), p(0, 3)
    got = one.select(*G.circumcentre(a, b, c), *G.incentre(a, b, c), *G.orthocentre(a, b, c)).first()
    assert got[:] == pytest.approx((2, 1.5, 2.5, 1, 1, 1, 0, 0))
    flat = one.select(*G.circumcentre(a, b, p(8, 0)), *G.incentre(a, b, p(8, 0)), *G.orthocentre(a, b, p(8, 0))).first()
    assert flat[:] == (0, 0, 0, 0, 0, 0, None, None)


def test_options(spark):
    own = spark.range(40)
    draw = lambda df: {r[0]: r[1] for r in df.select("id", synth.numeric_options(F.col("id") * 9, 5, 3, F.col("id"))).collect()}
    found = draw(own.repartition(1))
    assert found == draw(own.repartition(7))
    assert all(len(set(v)) == 5 and k * 9 in v for k, v in found.items())


def test_sinks_round_trip(spark, tmp_path):
    own = spark.createDataFrame([(1, 'a"b', None), (2, "", "é")], "k int, a string, b string")
    sinks.write_csv(own, f"{tmp_path}/csv")
    assert '"1","a""b",""' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    sinks.write_jsonl(own, f"{tmp_path}/jsonl")
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "jsonl").glob("part*"))
    sinks.write_shards(own, f"{tmp_path}/shards", "k", 1)
    assert sinks.shard_info(spark, f"{tmp_path}/shards").count() == 2


def test_raw_records(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1/data.json").write_text('[{"id": "a"}, 5, {"id": null}]')
    found = readers.raw_records(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.task, r.pos, r.record) for r in found] == [("t1", 0, '{"id":"a"}'), ("t1", 2, '{"id":null}')]
    (tmp_path / "data.json").write_text('{"id": 1}')
    with pytest.raises(Exception, match="not a list"):
        readers.raw_records(spark, str(tmp_path)).collect()


def test_boxes_on_another_canvas(spark):
    own = spark.createDataFrame([(10.0, 10.0, 30.0, 30.0), (10.0, 10.0, 17.0, 30.0), (-5.0, 95.0, 4.0, 120.0), (99.0, 99.0, 99.0, 99.0)], "a double, b double, c double, d double")
    box = lambda *args: [r[:] for r in own.select(*P.scaled_box([F.col(c) for c in "abcd"], *args)).collect()]
    assert box((100, 100), (200, 200)) == [(28, 28, 52, 52), (20, 28, 34, 52), (0, 198, 8, 200), (198, 198, 199, 199)]
    assert box((100, 100), (50, 50), 0)[0] == (5, 5, 15, 15)
    with pytest.raises(ValueError):
        box((0, 1), (1, 1))


def test_canvas_of_a_record(spark):
    given = ['{"canvas_dimensions": [7.5, "9"]}', '{"canvas_dimensions": {"width": 3, "height": 4}}', '{"canvas_dimensions": [0, 4], "canvas_size": 8.5}', '{"canvas_size": -1, "cell_bboxes": [[[0, 0, 5, 6], [1]], [[0, 0, 4, 9, 1]]]}', "{}", None]
    own = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, record string")
    assert [r[:] for r in own.orderBy("k").select(*P.extent("record", (1, 2))).collect()] == [(8, 9), (3, 4), (8, 8), (5, 9), (1, 2), (1, 2)]
    with pytest.raises(Exception, match="no canvas size"):
        own.select(*P.extent("record")).collect()


def test_errors_of_judges_count_as_wrong(spark):
    own = spark.createDataFrame([("yes", "error", "completed"), ("error", "no", "completed"), ("yes", "yes", "failed")], "last_frame_judgment string, audio_judgment string, status string")
    found = {r.metric: (r.correct, r.total) for r in summary.judged_metrics(own).collect()}
    assert found == {"last_frame": (1, 2), "audio": (0, 2), "both": (0, 2), "any": (1, 2)}


def test_exports_in_one_pass(spark, tmp_path):
    fields = "sample_id string, task_type string, task_group string, ti2i string, ti2v string, ti2t string, ti2ti string, puzzle_image string, reasoning_image string, solution_image string, solution_video string, record string, path_cell_ids array<int>, correct_option string"
    rows = [
        ("a", "t", "maze", None, None, "ask me", None, "p", "r", "s", None, '{"ti2t_answer": " Answer: up. "}', [1, 2], None),
        ("b", "t", "eyeballing", "edit", "film", None, None, "p", "r", "s", "v", '{"ti2t_answer": " "}', None, " c "),
        ("c", "t", "visual_puzzle", "edit", None, "", None, "p", "r", "s", "", "{}", None, " c "),
    ]
    own = spark.createDataFrame(rows, fields)
    chat = export.chat_rows(own, "sft").collect()
    assert [(r.id, r.messages[0].content, r.messages[1].content, r.images, r.solution) for r in chat] == [("a", "<image> ask me" + T.SFT_SUFFIX, "Answer: up.", ["r"], "[1, 2]")]
    assert [(r.sample_id, r.answer_text) for r in export.edit_rows(own).orderBy("sample_id").collect()] == [("b", "C"), ("c", "c")]
    export.write_exports(own, f"{tmp_path}/x", ["VLM", "edit ", "nothing", "video"])
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if p.is_dir()) == ["mode=edit", "mode=video", "mode=vlm"]
    assert export.read_export(spark, f"{tmp_path}/x", "vlm", "id string, image string").first()[:] == ("a", "r")
    plan = export.fan_out(own, ["vlm", "edit", "chat_sft"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    with pytest.raises(ValueError):
        export.fan_out(own, ["nothing"])


def test_sums_of_distances_are_exact(spark):
    """The same sum in any order, half up; greys of exactly 245.5 are bright."""
    rows = [(0, 4.503599627370496e6), (1, 0.0005)] + [(k, 3e-10) for k in range(2, 12)]
    for order in ("k", "-k"):
        own = spark.createDataFrame(rows, "k int, d double").coalesce(1).orderBy(F.expr(order))
        assert own.agg(P.total(F.col("d"), 3)).first()[0] == 4503599.628
    edge = spark.createDataFrame([(238, 250, 242), (249, 251, 208), (253, 241, 249), (245, 245, 245)], "r long, g long, b long")
    black = [F.lit(0)] * 3
    assert [(r.g, r.c) for r in edge.select(P.grey().alias("g"), P.coverage([F.col(c) for c in "rgb"], black).alias("c")).collect()] == [(246.0, 1.0)] * 3 + [(245.0, 0.0)]


def test_distances_against_exact_sums(spark, tmp_path):
    """M3 over pixels of which some have a grey of exactly 245.5, against its twin."""
    import duckdb

    import __spark_entry__ as entry

    # r = (37 p + o) % 256, g = (11 p + s) % 256, b = (5 o + n) % 256 for order o, part p, supplier s and line n = 2
    edge = []
    for r, g, b in ((238, 250, 242), (249, 251, 208), (253, 241, 249)):
        o = (b - 2) * pow(5, -1, 256) % 256
        p = (r - o) * pow(37, -1, 256) % 256
        edge.append((o, p, (g - 11 * p) % 256, 2))
    rows = edge + [(o, p, s, 1) for o, p, s, _ in edge]  # frame 1 is darker by one
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    twin = con.execute(entry.oracle_sql()["m3_distances"]).fetchall()
    assert sorted(r[:] for r in entry.queries()["m3_distances"](spark, str(tmp_path)).select("frame_idx", "euclidean", "manhattan", "coverage").collect()) == sorted(twin)
    assert max(r[3] for r in twin) == 3
