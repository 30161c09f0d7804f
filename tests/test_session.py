"""The shared folder comes from the session, whichever way it was set."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config(
    "spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
spark.sparkContext.setCheckpointDir(sys.argv[1])
from spanlake.plans import registry
from spanlake.session import scratch_path
assert sys.argv[1] in scratch_path(spark, "x")
for name in ("kfold_assign", "model_scores", "roundtrip_splits"):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("WRITTEN", spark.sparkContext.getCheckpointDir())
"""


def test_queries_use_the_folder_given_to_the_context(tmp_path):
    empty = tmp_path / "conf"
    empty.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(empty), "PYTHONPATH": REPO}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], env=env, capture_output=True,
                         text=True, cwd=tmp_path, timeout=600)
    assert "WRITTEN" in run.stdout, run.stderr[-3000:]
