import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foldsearch.runtime import local_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session("8", **{"spark__sql__warehouse__dir": str(warehouse), "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
