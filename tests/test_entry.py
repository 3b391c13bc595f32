"""The entry module with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; n = e.queries(); print(len(n), 'pipeline' in n, any(k.startswith('op1_') for k in n), set(e.oracle_sql()) <= set(n))"


@pytest.mark.parametrize("left_out", [("cellpulse/llm", "corpus_pipeline.py"), ("cellpulse/llm",), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_text_operators(tmp_path, left_out):
    away = {os.path.join(ROOT, p) for p in left_out}
    skip = lambda folder, names: [n for n in names if os.path.join(folder, n) in away or n in (".git", "__pycache__", "tests")]
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)
    n, pipeline, text, known = run.stdout.split()
    assert int(n) > 140 and known == "True" and pipeline == "False"
    assert text == str("cellpulse/llm" not in left_out and os.path.isdir(os.path.join(ROOT, "cellpulse/llm")))
