import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from paperloom.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
