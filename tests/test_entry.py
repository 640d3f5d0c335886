"""The driver's contract, with and without the folder of training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_stands_without_the_folder(tmp_path):
    shutil.copytree(ROOT / "ordina", tmp_path / "ordina", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "lookup_unique" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
    assert set(found) <= set(names(ROOT))
