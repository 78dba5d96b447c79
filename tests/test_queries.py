import os

import pytest

import __spark_entry__ as driver
from check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"

# A cross-section; `check_queries.py 0.01` runs all of them.
NAMES = ["clean_items", "dataset_statistics", "tfidf_weights", "similar_pairs", "llm_fallback", "dbscan", "network_edges"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    matches, *_, difference = compare(
        spark, connect(SF_DIR), name, driver.queries()[name], driver.oracle_sql()[name], SF_DIR
    )
    assert matches, difference


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
