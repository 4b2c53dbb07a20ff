import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("CANVASS_TEST_SF", "/root/testdata/sf0.001")
