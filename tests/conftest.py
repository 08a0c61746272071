import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keelson.session import session

    shared = tmp_path_factory.mktemp("shared")
    found = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}", spark__default__parallelism="4")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
