"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corvane import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session.local(4, 4, "3g", **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield found
    found.stop()
