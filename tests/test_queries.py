import pytest
from oracle import expected, rows

from quarry.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == expected(ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).columns[:2] == ["query_id", "doc_id"]
