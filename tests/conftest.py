import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import make_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = make_spark()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    from fieldloom.plans.ship import ship_package

    ship_package(session)
    yield session
    session.stop()
