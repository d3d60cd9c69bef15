"""The entry module without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["dossier_spark/llm", "tests/llm"], ["dossier_spark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_without_text_operators(tmp_path, gone):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = repo / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(o) <= set(q), callable(e.entry))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=repo, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr[-2000:]
    n, *rest = run.stdout.split()
    assert int(n) > 140 and rest == ["False", "False", "True", "True"]


def test_the_rest_passes_without_text_operators(tmp_path):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (repo / "corpus_pipeline.py").unlink()
    some = ["tests/test_text.py", "tests/test_retrieval.py", "tests/test_answers.py", "tests/test_named.py"]
    run = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", *some], cwd=repo, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stdout[-3000:]
