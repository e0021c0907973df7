from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FIXTURES = os.path.join(ROOT, "tests", "fixtures")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from newsloom.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        # Plans show whole paths, however long the temporary folder's is.
        spark__sql__maxMetadataStringLength="2000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def fixture_path():
    return lambda name: os.path.join(FIXTURES, name)


@pytest.fixture
def page(spark):
    """A one-row frame with a fixture page as ``html``."""

    def read(name: str):
        with open(os.path.join(FIXTURES, name), encoding="utf-8") as f:
            return spark.createDataFrame([(1, f.read())], "page_id int, html string")

    return read
