"""The entry is imported before any session is there, with or without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
{before}
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and "vector_topk" in q and ("op2_benchmark_decontamination" in q) == {there}
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
import bench
assert all(x in q or x.startswith("op") for x in bench.HEADLINE)
"""
HIDDEN = """
from importlib.machinery import PathFinder
find = PathFinder.find_spec
PathFinder.find_spec = classmethod(lambda cls, name, path=None, target=None: None if name.startswith(("memlake.llm", "corpus_pipeline")) else find(name, path, target))
"""


def run(before: str, there: bool) -> None:
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), before=before, there=there)], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_without_the_training_data_operators():
    run(HIDDEN, False)


def test_entry_before_a_session():
    has = (ROOT / "memlake" / "llm" / "queries.py").exists()
    run("", has)
