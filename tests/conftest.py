import functools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from laneflow.session import build_session

    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shared_fixtures():
    """One set of fixture tables for all oracle tests."""
    from laneflow.catalog import registry

    registry.Fixtures = functools.cache(registry.Fixtures)
