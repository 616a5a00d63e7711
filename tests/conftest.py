import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runsignal.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def shared(tmp_path_factory):
    """Folder the session names for intermediate tables, as a cluster would."""
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared):
    s = local_session("8", partitions=8, name="tests", **{"spark.checkpoint.dir": f"file://{shared}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
