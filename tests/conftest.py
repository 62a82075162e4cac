import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quirefold.session import get_session

    s = get_session("tests", cpus="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
