"""Every query of the catalog against DuckDB over the small tables."""

import pytest

import oracle
from lodestone.plans import catalog

FOLDER = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert oracle.differences(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
