import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def series(spark):
    """(ticker, date, close) rows from a mapping of ticker to closes, one bar per day."""
    import datetime as dt

    def make(**closes):
        rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c)) for t, cs in closes.items() for i, c in enumerate(cs)]
        return spark.createDataFrame(rows, "ticker string, date date, close double")

    return make
