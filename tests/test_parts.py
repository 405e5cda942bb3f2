"""The library without the text operators: it imports, and its flagship query runs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""
ENTRY = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert e.entry(spark).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_text_operators(tmp_path, pipeline):
    if pipeline and not os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        pytest.skip("the pipeline is not here")
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=left_out)
    assert (copy / "corpus_pipeline.py").exists() == pipeline and not (copy / "tracegrain" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN if pipeline else RUN + ENTRY
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
