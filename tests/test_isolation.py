"""The engine without its optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q); print('pipeline' in q, any(x.startswith('op1_') for x in q))"


def asked(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "transitloom"), tmp_path / "transitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert asked(tmp_path) == ["False", "False"]
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        assert asked(tmp_path) == ["False", "False"]
