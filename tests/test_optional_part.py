"""The library without its optional part: the entry imports and registers the rest."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 120 and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in q), sorted(q)
assert set(o) <= set(q)
"""


def _tree(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.relpath(os.path.join(d, n), ROOT) in without])
    return tmp_path / "repo"


def _run(where):
    env = os.environ | {"PYTHONPATH": str(where), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=where, env=env, capture_output=True, text=True)


def test_entry_without_operators_and_pipeline(tmp_path):
    done = _run(_tree(tmp_path, "giftrisk/llm", "tests/llm", "corpus_pipeline.py"))
    assert done.returncode == 0, done.stderr


def test_entry_without_operators_but_with_pipeline(tmp_path):
    done = _run(_tree(tmp_path, "giftrisk/llm", "tests/llm"))
    assert done.returncode == 0, done.stderr
