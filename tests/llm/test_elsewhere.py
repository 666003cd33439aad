"""The operators that run Python on workers, from a folder without the package."""

from test_shipping import run_elsewhere


def test_operators_from_another_folder(tmp_path):
    found = run_elsewhere(tmp_path, ["op3_decontaminate", "op10_near_dedup"])
    assert found["op3_decontaminate"] == found["op10_near_dedup"] > 0
