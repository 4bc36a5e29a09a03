"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SAYS = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def _names(root):
    env = {**os.environ, "PYTHONPATH": str(root), "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=root, env=env, capture_output=True, text=True, check=True)
    return [int(n) for n in run.stdout.split()]


def test_entry_without_the_text_operators(tmp_path):
    """Neither the folder nor the pipeline, then the pipeline alone: the core queries stay."""
    core = shutil.copytree(f"{ROOT}/cohortweave", tmp_path / "cohortweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert not (core / "llm").exists()
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    total, of_text = _names(tmp_path)
    assert total >= 86 and of_text == 0
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert _names(tmp_path) == [total, 0]
