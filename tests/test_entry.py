"""The registry, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_registry_without_training_data_operators():
    code = "import sys; sys.modules['gristmill.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 140 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(ROOT)})


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
