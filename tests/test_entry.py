"""The entry without the optional parts of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left_out", [("fieldloom/llm",), ("fieldloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, left_out):
    gone = {os.path.join(ROOT, name) for name in left_out}
    for name in ("fieldloom", "corpus_pipeline.py", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        if at in gone or not os.path.exists(at):
            continue
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in gone or n == "__pycache__"])
        else:
            shutil.copy(at, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    queries, optional, twins_known = out.stdout.split()
    assert int(queries) - int(optional) >= 200 and twins_known == "True"
    assert (int(optional) == 0) == ("fieldloom/llm" in left_out or not os.path.exists(os.path.join(ROOT, "fieldloom/llm")))
