import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from canvass.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "canvass-tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def three_rows(spark):
    """Three campaign rows whose encoding is known by hand."""
    # The inputs of known examples.
    rows = [
        (1, 30, "admin.", "single", "secondary", "no", 1000.0, "yes", "no", "cellular", 1, "may", 100, 1, -1, 0, "unknown", "yes"),
        (2, 40, "technician", "married", "tertiary", "no", 2000.0, "no", "yes", "unknown", 15, "jun", 200, 2, 5, 1, "success", "no"),
        (3, 50, "management", "divorced", "primary", "yes", 3000.0, "yes", "no", "telephone", 30, "jul", 300, 3, 10, 2, "failure", "yes"),
    ]
    names = ("contact_id bigint, age int, job string, marital string, education string, `default` string, balance double, "
             "housing string, loan string, contact string, day int, month string, duration int, campaign int, pdays int, "
             "previous int, poutcome string, deposit string")
    return spark.createDataFrame(rows, names)
