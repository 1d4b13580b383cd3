import pytest

from tests.oracle import compare
from tidemark.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    q = QUERIES[name]
    if q.sql is None:
        assert q.run(spark, sf_dir).count() > 0
    else:
        compare(spark, sf_dir, q.run, q.sql)
