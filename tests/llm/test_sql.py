from pathlib import Path

import pytest

from factloom.llm.queries import oracle_sql, queries

from ..oracle import SMALL, agree, connection


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    agree(queries()[name](spark, SMALL), oracle_sql()[name], connection())
