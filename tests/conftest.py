import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarrymill.runtime import local_session

    s = local_session("tests", 8, spark__sql__shuffle__partitions="8")
    yield s
    s.stop()
