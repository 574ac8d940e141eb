import os

import pytest
from pyspark import cloudpickle

from passagework.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pytest_collection_modifyitems(items):
    """Functions of test modules travel by value, as workers cannot import them."""
    for module in {item.module for item in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    return local_session("passagework-tests", cores="8")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, name="doc"):
        """Documents from texts, numbered from 1, all in one corpus unless given as (name, text)."""
        named = [(i, *(r if isinstance(r, tuple) else (name, r))) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(named, "doc_id bigint, document_name string, text string")

    return make
