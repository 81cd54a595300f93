"""Every query of the engine against its SQL oracle, on the small tables."""

import pytest
from compare import oracle, rows_of

from linkweave import queries

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_oracle(spark, name):
    df = queries.QUERIES[name](spark, PATH)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE_SQL:
        columns, want, _ = oracle(queries.ORACLE_SQL[name], PATH)
        assert sorted(df.columns) == columns
        assert rows_of(df.columns, rows) == want
