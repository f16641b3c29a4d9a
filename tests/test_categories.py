"""Cut points of categories and alerts."""

import pytest
from pyspark.sql import functions as F

from brisa.functions import categories as C
from brisa.operators import advisory
from tests.conftest import hours

CUTS = [
    (0.99, "Good", "Good"),
    (1.0, "Good", "Good"),
    (1.01, "Moderate", "Fair"),
    (2.0, "Moderate", "Fair"),
    (2.01, "Unhealthy (Sensitive)", "Moderate"),
    (3.0, "Unhealthy (Sensitive)", "Moderate"),
    (3.01, "Unhealthy", "Poor"),
    (4.0, "Unhealthy", "Poor"),
    (4.01, "Hazardous", "Very Poor"),
    (None, None, None),
]
ALERT_VECTORS = [
    (1.5, "good", False),
    (1.99, "good", False),
    (2.0, "moderate", True),
    (2.5, "moderate", True),
    (3.0, "unhealthy_sensitive", True),
    (3.5, "unhealthy_sensitive", True),
    (4.0, "unhealthy", True),
    (4.5, "unhealthy", True),
    (5.0, "hazardous", True),
]


@pytest.fixture
def values(spark):
    return lambda rows: spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, value double")


def test_category_cuts(values):
    df = advisory.add_status(advisory.add_health_category(values(CUTS), F.col("value")), F.col("value"))
    got = [(r["value"], r["aqi_category"], r["status"]) for r in df.orderBy("i").collect()]
    assert got == CUTS


def test_alert_vectors(values):
    df = advisory.alert_level(values(ALERT_VECTORS), F.col("value"))
    assert [(r["value"], r["level"], r["should_alert"]) for r in df.orderBy("i").collect()] == ALERT_VECTORS


def test_status_record(values):
    row = advisory.add_status(values([(4.5,)]), F.col("value")).first()
    assert row["color"] == "darkred"
    assert row["recommendations"][0] == "Avoid all outdoor activities"
    assert len(row["recommendations"]) == 4


def test_gauge(values):
    rows = advisory.add_gauge(values([(-1.0,), (0.2,), (1.0,), (1.2,), (4.2,), (9.0,)]), F.col("value"))
    got = [(r["level"], r["score"]) for r in rows.orderBy("i").collect()]
    assert got == [(1, 0.2), (1, 0.2), (1, 0.2), (2, 0.4), (5, 1.0), (5, 1.0)]


def test_severity_band(values):
    rows = advisory.add_severity(values([(2.0,), (2.5,), (3.5,), (4.5,)]), F.col("value")).orderBy("i")
    assert [r["band"] for r in rows.collect()] == [1, 2, 3, 4]


def test_alert_message(spark):
    df = spark.createDataFrame([(1, hours(5), 5.0), (1, hours(6), 1.0)], "series_id bigint, datetime timestamp, v double")
    alerts = advisory.alert_events(df, F.col("v"), F.lit("Pier 7")).collect()
    assert len(alerts) == 1
    assert alerts[0]["subject"] == "AQI Alert: HAZARDOUS - Pier 7"
    lines = alerts[0]["message"].split("\n")
    assert lines[2:5] == ["Location: Pier 7", "AQI: 5.00", "Time: 2024-01-01 05:00:00"]
    assert lines[-1] == "This is a health emergency. Take immediate precautions."


def test_unknown_alert_level(spark):
    message = C.alert_message(F.lit("none"), F.lit("x"), F.lit(1.0), F.lit(hours(0)))
    assert spark.range(1).select(message.alias("m")).first()["m"] == "Unknown alert level"


def test_staleness(make_readings):
    df = make_readings([(1, 0, 1), (2, 7, 1), (3, 10, 1)])
    stale = {r["series_id"]: r["stale"] for r in advisory.staleness_check(df).collect()}
    assert stale == {1: True, 2: False, 3: False}
    later = advisory.staleness_check(df, F.lit(hours(14)))
    assert all(r["stale"] for r in later.collect())
