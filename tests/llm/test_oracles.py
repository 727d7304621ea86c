"""Queries whose results SQL can state, against that SQL."""

import pytest
from helpers import same

from cladewise.llm import queries


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op8_substring_dedup", "op9_sharding"])
def test_against_sql(spark, data, duck, name):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLE_SQL[name])
