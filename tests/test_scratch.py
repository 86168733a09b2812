"""Intermediate tables on a stock session, in a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as entry
print("ROWS", entry.queries()["q13_generated_keys"](spark, "/root/testdata/sf0.001").count())
assert spark.conf.get("spark.checkpoint.dir", None) is None
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    """Spark refuses a change of the setting in a running session; a local one takes a temporary folder instead."""
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and int(said.stdout.rpartition("ROWS")[2]) > 0, said.stderr[-2000:]
    assert any((tmp_path / "lectern-checkpoints").iterdir())
