import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_absent_modules():
    assert entry._optional("tidelake.llm.absent") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("tidelake.plans.absent.more")
