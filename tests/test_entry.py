"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder) -> tuple[list[str], list[str]]:
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, check=True).stdout
    return tuple(next(line.split()[1:] for line in out.splitlines() if line.startswith(k)) for k in ("NAMES", "SQL"))


def test_the_rest_stands_alone(tmp_path):
    """Without the operators, their pipeline and their tests, all other queries are there; nothing else imports them."""
    left = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPO, tmp_path / "rest", ignore=left)
    queries, sql = names(tmp_path / "rest")
    assert not [q for q in queries if q.startswith("op") and q[2:3].isdigit()] and "pipeline" not in queries
    assert len(queries) >= 90 and set(sql) <= set(queries)
    for module in ("tarn.cli", "tarn.api", "tarn.streaming.watch", "bench"):
        subprocess.run([sys.executable, "-c", f"import {module}"], cwd=tmp_path / "rest", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "rest")})
