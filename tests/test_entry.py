"""The entry loads, with and without the optional operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(*q)"


@pytest.mark.parametrize("without", [(), ("laneflow/llm",), ("corpus_pipeline.py",), ("laneflow/llm", "corpus_pipeline.py")])
def test_loads_from_a_copy(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n.startswith((".", "__pycache__")) or os.path.relpath(os.path.join(folder, n), ROOT) in without])
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "e1_feature_table" in names
    assert ("pipeline" in names) <= (not without)
