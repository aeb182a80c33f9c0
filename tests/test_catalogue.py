"""Every query with SQL gives the SQL's rows; the others give rows; names and guards of the entry file."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import SF
from embertrail.plans import catalogue

ORACLES = catalogue.oracle_sql()
REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_rows):
    same_rows(catalogue.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_gives_rows(name, spark):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_needs_no_session_and_no_llm(tmp_path):
    """The entry file imports and lists its queries without Spark running, and where the training-data folders are gone."""
    import shutil

    shutil.copytree(REPO / "embertrail", tmp_path / "embertrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q; e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalogue.queries())


def test_nothing_else_imports_llm():
    for p in (REPO / "embertrail").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "embertrail").parts:
            assert "llm" not in p.read_text(), p
    importlib.import_module("embertrail.plans.catalogue")
