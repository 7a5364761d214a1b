"""The entry point with all parts, and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from quillspark.plans import oracle, queries
assert set(entry.queries()) == set(queries.QUERIES), sorted(entry.queries())
assert set(entry.oracle_sql()) == set(oracle.SQL)
assert not any(name.startswith(("op", "pipeline")) for name in entry.queries())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.createDataFrame([(0, "One two. Three  four.")], "doc_id long, text string").write.parquet(sys.argv[2] + "/documents.parquet")
assert entry.queries()["mech_double_space"](spark, sys.argv[2]).count() > 0
print("ran")
"""


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_lives_without_corpus_operators(tmp_path, pipeline_too):
    """With both llm folders gone, and corpus_pipeline.py gone or left behind, the other queries import, list and run."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    else:
        (copy / "corpus_pipeline.py").write_text("from quillspark.llm.common import table\n")
        # A folder that deletion has left.
        (copy / "quillspark" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "sf").mkdir()
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(copy), str(tmp_path / "sf")], capture_output=True, text=True, timeout=300, env=environment, cwd=tmp_path)
    assert done.returncode == 0 and "ran" in done.stdout, done.stderr[-2000:]
