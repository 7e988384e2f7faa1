"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    """A copy without matchloom/llm and tests/llm, with and without the pipeline's file, still has every other query."""
    shutil.copytree(os.path.join(ROOT, "matchloom"), tmp_path / "matchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])]:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 200 and set(e.oracle_sql()) <= set(n) and not [k for k in n if k.startswith(('op', 'pipeline'))]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
