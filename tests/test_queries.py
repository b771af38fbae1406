"""Every core query that has SQL gives what its SQL gives."""

from __future__ import annotations

from pathlib import Path

import pytest
from sqlcheck import TABLES, connection, same

from tidemark.plans.oracle import ORACLE, STATED
from tidemark.plans.queries import QUERIES
from tidemark.plans.queries import STATED as OURS

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables")
#: What SQL can't express: counters of comparisons, labels of nested records.
WITHOUT = {n for n in QUERIES if n.startswith("comparisons_")} | {"p6_operations", "p6_media", "p6_paths"}


@pytest.fixture(scope="module")
def con():
    return connection()


def test_which_queries_have_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT and not set(ORACLE) - set(QUERIES) and STATED == OURS


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0
