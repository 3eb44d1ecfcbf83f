from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path("/root/testdata/sf0.001")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 55


@pytest.mark.skipif(not ROOT.exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_core_does_not_import_the_optional_subpackage():
    package = Path(entry.__file__).parent / "scriptorium"
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert "scriptorium.llm" not in path.read_text(), path
