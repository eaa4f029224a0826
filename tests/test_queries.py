"""Every registered query against its SQL, on the smallest tables."""

import pytest

from importlake import plans
from importlake.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        oracle.check(df, con, registry.ORACLES[name])
    else:
        df.collect()


def test_names_have_letter_and_number():
    assert all(n[0].isalpha() and n[1].isdigit() for n in registry.QUERIES)
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 50 and "market_status" in df.columns
