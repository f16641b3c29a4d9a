import datetime

import pytest

from brisa.schemas import POLLUTANTS
from brisa.session import local_session, prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = prepare(local_session(8, 4, "brisa-tests", str(tmp_path_factory.mktemp("shared"))))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime.datetime(2024, 1, 1)


def hours(n):
    return START + datetime.timedelta(hours=n)


READING = "series_id bigint, datetime timestamp, aqi double, " + ", ".join(f"{p} double" for p in POLLUTANTS)


@pytest.fixture
def make_readings(spark):
    """Readings from (series, hour offset, aqi); pollutants follow from the offset."""

    def make(rows):
        full = [
            (series, hours(offset), None if aqi is None else float(aqi), *[float(offset % 7 + i) for i in range(8)])
            for series, offset, aqi in rows
        ]
        return spark.createDataFrame(full, READING)

    return make


def same_rows(a, b, digits=9):
    """Both frames hold the same rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)

    def cells(df):
        rows = []
        for row in df.select(columns).collect():
            rows.append(tuple(round(v, digits) if isinstance(v, float) else v for v in row))
        return sorted(rows, key=repr)

    left, right = cells(a), cells(b)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert x == y
