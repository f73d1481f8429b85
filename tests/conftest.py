from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from brightwater.session import local_session

    session = local_session(memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_option(key: str, value: str) -> None:
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield set_option
    for key, value in before.items():
        spark.conf.set(key, value)
