"""The entry module with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum((k.startswith('op') and k[2].isdigit()) or k == 'pipeline' for k in q))"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr[-2000:]
    return tuple(map(int, done.stdout.split()))


@pytest.mark.parametrize("gone", [["newslake/llm", "tests/llm"], ["newslake/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_lives_without_optional_parts(tmp_path, gone):
    """With the optional subpackage gone, with or without the pipeline's file, the other queries stay registered."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for name in gone:
        target = copy / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    rest, extra = listed(copy)
    assert rest > 150 and extra == 0
    whole, optional = listed(ROOT)
    assert rest == whole - optional
