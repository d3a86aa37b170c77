"""Registered llm queries: against SQL, and on empty tables."""

import pytest

from compare import difference, duck
from spendframe.llm.oracles import ORACLES
from spendframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, data, tables):
    assert difference(QUERIES[name](spark, data), tables, ORACLES[name]) is None


@pytest.fixture(scope="module")
def nothing(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(name, spark, nothing):
    assert QUERIES[name](spark, nothing).count() == 0
