import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as X  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """The cases as a table with clashing columns, in several partitions."""
    return spark.createDataFrame(X.rows(), X.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.where("1 = 0")
