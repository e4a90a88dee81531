from __future__ import annotations

import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegrid.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session("tests", "local[4]", 4, **{"spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def at():
    """An instant from text, in UTC."""
    return lambda text: datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
