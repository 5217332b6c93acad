"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__ as entry

from .conftest import ROOT


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_folders(tmp_path):
    """A copy without obslake/llm, tests/llm and corpus_pipeline.py imports and lists the other queries."""
    import shutil

    shutil.copytree(f"{ROOT}/obslake", tmp_path / "obslake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'current_records' in q and not [k for k in q if k.startswith('op')]; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
