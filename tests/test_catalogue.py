import pytest

from tests.oracle import duck, spark_rows
from tidemark.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE:
        assert got == duck(SF, ORACLE[name])  # an empty result is right where SQL has none, such as an anti join without strangers
    else:
        assert got[1]
