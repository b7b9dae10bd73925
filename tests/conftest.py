import os

import pytest

from plumbline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", spark__driver__memory="3g", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest test tables, where they are."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
