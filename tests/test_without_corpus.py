"""The rest of the library, with the corpus operators taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'], set(o) <= set(q))"


@pytest.mark.parametrize("gone", [("tidemark/llm", "tests/llm"), ("tidemark/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_stay_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.suffix == "" else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, rest = said.stdout.split(" ", 1)
    assert int(count) > 30 and rest.strip() == "[] True"


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
