"""The entry points of the driver."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    from tidemark.plans.queries import QUERIES

    monkeypatch.setattr(__spark_entry__, "OWN", "tidemark.absent")
    assert __spark_entry__.queries() == QUERIES
    monkeypatch.setattr(__spark_entry__, "OWN", "tidemark.plans")
    monkeypatch.setitem(sys.modules, "tidemark.plans.sql", None)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.oracle_sql()
