"""The entry module works where the training-data operators, or the pipeline over them, have been deleted."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("gone", [["ravelin/llm"], ["ravelin/llm", "corpus_pipeline.py"]])
def test_without_the_training_data_operators(tmp_path, gone):
    own = tmp_path / "copy"
    shutil.copytree(f"{ROOT}/ravelin", own / "ravelin", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", own)
    for name in gone:
        path = own / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=own, env=os.environ | {"PYTHONPATH": str(own)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= int(said[1]) > 30 and said[2:] == ["False", "False"]
