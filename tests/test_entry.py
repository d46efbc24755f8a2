"""The driver contract holds with and without the text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(where):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(*sorted(q)); print(*sorted(o))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=where, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": where})
    assert out.returncode == 0, out.stderr
    return [set(x.split()) for x in out.stdout.splitlines()[-2:]]


def _copy(tmp_path, *without):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".*"))
    for x in without:
        at = to / x
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    return str(to)


def test_every_oracle_has_a_query():
    q, o = _names(ROOT)
    assert o <= q


def test_queries_without_the_text_folders(tmp_path):
    q, o = _names(_copy(tmp_path, "provlake/llm", "tests/llm"))
    assert q and o <= q and "pipeline" not in q and not any(x.startswith("op") and x[2:3].isdigit() for x in q)


def test_queries_without_the_pipeline(tmp_path):
    q, _ = _names(_copy(tmp_path, "corpus_pipeline.py"))
    assert q and "pipeline" not in q
