"""Queries in sessions that name no shared folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from gridstone.llm import queries
from gridstone.session import settled
print("rows", queries.QUERIES["op4_substring"](spark, "/root/testdata/sf0.001").count(), settled(spark.range(3)).count())
"""


def test_a_local_session_takes_a_folder_of_its_own(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=240, check=False)
    assert "rows 200 3" in out.stdout, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_told_so():
    from types import SimpleNamespace

    from gridstone.llm.common import shared_dir

    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(spark)
