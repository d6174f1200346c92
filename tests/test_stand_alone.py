"""The driver contract without the llm subpackage: imports, queries and entry."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert 'agg4_histogram' in q and e.oracle_sql(); assert not [n for n in q if n.startswith('op') or n == 'pipeline'], q; print(len(q))"


RUN = """
import tempfile, __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
assert e.entry(s).count() == 4
for name in ("agg4_histogram", "flt6_full_text", "trc1_trace_timeline", "str4_live_tail"):
    assert e.queries()[name](s, "/root/testdata/sf0.001").count() > 0, name
"""


def test_entry_and_queries_run_without_llm(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("left", ["nothing", "corpus_pipeline.py", "empty folder"])
def test_queries_without_llm(tmp_path, left):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if left == "nothing" else []))
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    if left == "empty folder":
        (tmp_path / "repo/sigmill/llm").mkdir()
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
