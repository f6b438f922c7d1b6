import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
ALONE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = entry.queries()
assert set(entry.oracle_sql()) <= set(names)
assert "pipeline" not in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).count() == 10
assert names["set_union"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_registry_is_consistent():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert "one_hop_aggregate" in names


def test_missing_modules_are_seen_as_missing():
    assert not entry._present("latticework.nothing.here") and not entry._present("nothing_here")


def test_library_stands_without_the_corpus_folders(tmp_path):
    """With both folders deleted the registry loads and graph queries run, whether or not the pipeline file is left."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "latticework" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=copy, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
