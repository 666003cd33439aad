"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from tallygrid.plans.fixtures import TABLES

NAMES = (
    "t1_spelled_letter t3_plain_prompt t6_answer_sentence t8_training_prompt t12_tagged_answer t13_free_text t14_last_number t15_colour_order t16_integer_lists t24_solution_text r1_option_reward r2_path_reward r5_reward "
    "p1_resolve_prompt p4_canonical p5_prompt_for p8_absolute_path p14_attempt_cells src5_questions src6_best_candidate src7_inner_payload snk8_question_manifest j2_merge_offline j5_pending a2_grouped_summary a4_judged_metrics "
    "a5_channel_vote a6_strict_majority a7_first_seen_majority a8_frame_vote a9_vote_report a20_generation_report w2_repair_ids w3_default_ids e3_chat_rows a13_best_frame a16_valid_grids a22_trim_box j7_nearest_palette m9_targets "
    "p12_option p9_prune j4_remap_paths j4_remap_records j14_base_colour e2_video_rows snk4_shard_info snk7_run_summary x1_scorers x4_metrics_by_name st3_retry_state src3_json_array w4_shard_number src6_best_candidate q1_triangle_filter src1_raw_records src4_snk2_csv st2_running_summary st4_first_only"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    cols = sorted(found.columns)
    twin = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert cols == sorted(names)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in found.collect())
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in twin.fetchall())
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
