"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["host", "pages", "titles", "links"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_optional_parts(tmp_path):
    """Without domloom/llm and corpus_pipeline.py the entry still imports, and no other module names them."""
    import shutil

    shutil.copytree(ROOT / "domloom", tmp_path / "domloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    for p in (ROOT / "domloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "domloom.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
