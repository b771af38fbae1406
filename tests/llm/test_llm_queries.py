"""Every training-data query that has SQL gives what its SQL gives."""

from __future__ import annotations

from pathlib import Path

import pytest
from sqlcheck import TABLES, connection, same

from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import ORACLE

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_every_problem_with_a_list_of_cases_has_its_query():
    import __spark_entry__

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} <= set(__spark_entry__.queries())
