"""The library without the folders of the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from catalog import registry; q = e.queries(); assert set(q) == set(registry.QUERIES), sorted(set(q) ^ set(registry.QUERIES)); print(len(q))"


def test_import_without_the_text_operators(tmp_path):
    """With both folders gone, and corpus_pipeline.py there or not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md", "*.txt"))
    for name in ("corpus_pipeline.py", None):
        if name is None and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        found = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
        assert found.returncode == 0, found.stderr
        assert int(found.stdout) > 100
