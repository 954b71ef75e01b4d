"""One small session for all tests, with a checkpoint folder of its own."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium.session import build_session  # noqa: E402

DATA = os.environ.get("SCRIPTORIUM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip(f"no test tables at {DATA}")
    return DATA
