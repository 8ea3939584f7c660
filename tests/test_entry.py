"""The driver's entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def counted(folder) -> list[str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.fixture
def copied(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    return tmp_path / "repo"


def test_entry_works_without_the_optional_folders(copied):
    for name in ("cyclelake/llm", "tests/llm"):
        shutil.rmtree(copied / name, ignore_errors=True)
    (copied / "corpus_pipeline.py").unlink(missing_ok=True)
    queries, sql, operators, pipeline = counted(copied)
    assert int(queries) > 190 and int(sql) >= 180 and (operators, pipeline) == ("0", "False")


def test_entry_works_with_the_pipeline_left_alone(copied):
    shutil.rmtree(copied / "cyclelake/llm", ignore_errors=True)
    assert counted(copied)[2:] == ["0", "False"]


def test_entry_works_without_a_dependency(copied):
    (copied / "ahocorasick.py").write_text("raise ImportError('not installed')\n")
    queries, _, operators, pipeline = counted(copied)
    assert int(queries) > 190 and (operators, pipeline) == ("0", "False")
