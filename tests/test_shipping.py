"""Workers find the package wherever the application runs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "checkpoints").getOrCreate()
for name in {names!r}:
    print("ROWS", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def run_elsewhere(folder, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, names=names)], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return {line.split()[1]: int(line.split()[2]) for line in out.stdout.splitlines() if line.startswith("ROWS")}


def test_from_another_folder(tmp_path):
    assert run_elsewhere(tmp_path, ["x5_model_calls", "snk4_shard_info"]) == {"x5_model_calls": 200, "snk4_shard_info": 4}
