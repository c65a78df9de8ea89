"""The driver's contract, and that the library stands without its text part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_go_together():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120
    for n in (1, 2, 3, 5, 6):
        assert any(k.startswith(f"p{n}_") for k in q)


def test_nothing_outside_the_text_part_imports_it():
    for p in (ROOT / "loomway").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "loomway.llm" not in p.read_text(), p


def test_import_without_the_text_part():
    code = "import sys; sys.modules['loomway.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
