"""The driver's entry module: queries that keep Python functions, one after the other, in two orders."""

from __future__ import annotations

import importlib
import subprocess
import sys

import pytest

NAMES = ["jaro_winkler", "greedy_groups", "patient_similarity", "chunk_merge", "identify_pages", "difflib_ratio"]


@pytest.mark.parametrize("turn", [1, -1])
def test_queries_follow_each_other(spark, sf, turn):
    queries = importlib.import_module("__spark_entry__").queries()
    for name in NAMES[::turn]:
        assert queries[name](spark, sf).count() > 0


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_absence_of_llm_is_passed_over(tmp_path):
    """Without the llm folders the entry imports; with a broken one it fails."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/foliolink", tmp_path / "foliolink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    done = run()
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 60
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run().returncode != 0
