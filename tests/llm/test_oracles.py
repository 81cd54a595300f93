"""The queries that SQL can express against their SQL, on the tables with planted copies, passages and notices."""

import pytest
from compare import oracle, rows_of

from linkweave.llm import registry

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    df = registry.QUERIES[name](spark, PATH)
    rows = df.collect()
    columns, want, _ = oracle(registry.ORACLE_SQL[name], PATH)
    assert rows and sorted(df.columns) == columns
    assert rows_of(df.columns, rows) == want
