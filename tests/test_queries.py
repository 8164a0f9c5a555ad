"""Every registered query of the library, against its SQL where it has one."""

import pytest

from plumbline.plans import catalogue

from compare import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, data, duck):
    df = catalogue.QUERIES[name](spark, data)
    if name in catalogue.ORACLE:
        same(df, duck.sql(catalogue.ORACLE[name]))
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
