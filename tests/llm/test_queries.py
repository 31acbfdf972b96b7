import pytest

from marrow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
