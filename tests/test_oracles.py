import pytest

from scholarlens import registry
from tests.oracles import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, name):
    got = rows_of(registry.queries()[name](spark, sf_dir))
    assert got == oracle_rows(registry.oracle_sql()[name], sf_dir)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
