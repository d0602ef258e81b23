"""The rest of the library works without the training-data subpackage and its tests."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "spanveil", tmp_path / "spanveil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import re, __spark_entry__ as e, bench; q = e.queries(); assert q and 'pipeline' not in q and not any(re.match(r'op\\d+_', n) for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
