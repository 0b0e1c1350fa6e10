import pytest

from tests import duck
from vaultspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck.same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
