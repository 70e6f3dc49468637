"""Operators called directly work from any folder: what workers need is sent to them."""
import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corrobora.operators import similarity
from corrobora.sources import tables
from corrobora.streaming import ledgers
v = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "b", [1.0, 0.01]), (3, "b", [0.0, 1.0])], "vec_id int, branch_id string, embedding array<double>")
assert [tuple(r)[:2] for r in similarity.sim_pairs(v, 0.9).collect()] == [(1, 2)]
e = spark.createDataFrame([("d", "2024", 1, 1, "r")], "domain string, ts string, event_id long, delta int, reason string")
assert ledgers.credibility_fold(e).first()["n"] == 1
assert spark.range(1).select(tables.html_text(F.lit("<p>a &amp; b"), 1)).first()[0] == "a & b"
"""


def test_operators_run_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
