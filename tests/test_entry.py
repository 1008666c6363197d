"""The entry points, with and without the removable parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_removable_parts(tmp_path):
    shutil.copytree(ROOT / "planloom", tmp_path / "planloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_a_missing_module_within_them_is_an_error(tmp_path):
    shutil.copytree(ROOT / "planloom", tmp_path / "planloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "planloom" / "llm").mkdir()
    (tmp_path / "planloom" / "llm" / "__init__.py").write_text("import no_such_module")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert found.returncode
    assert "no_such_module" in found.stderr
