import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from strataloom.session import build_session

    s = build_session("local[4]", "tests", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_data():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the test tables are not here")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
