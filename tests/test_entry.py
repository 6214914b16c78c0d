"""The driver's contract, with and without the training-data subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "weftwise", tmp_path / "weftwise", ignore=lambda d, _: ["llm", "__pycache__"])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    left = names(tmp_path)
    assert "resolve_by_phone" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]


def test_library_does_not_import_the_subpackage():
    for path in (ROOT / "weftwise").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "weftwise.llm" not in path.read_text(), path
