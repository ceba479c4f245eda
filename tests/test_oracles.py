"""Every registered query against its SQL, on the given tables."""

import harness
import pytest

import __spark_entry__ as contract

SF_DIR = f"{harness.DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return harness.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert harness.compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert contract.queries()[name](spark, f"{harness.DATA}/sf0.001").count() > 0


def test_entry_gives_one_row_per_conversation(spark):
    df = contract.entry(spark)
    ids = spark.read.parquet(f"{contract.SMOKE_DIR}/conversations.parquet").select("conv_id").distinct()
    assert df.count() == ids.count()
