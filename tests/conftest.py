import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaarlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="8", memory="4g", partitions=4)


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path)
