"""Reshaping, ordering, newest rows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.registry import query
from brisa.operators import shape
from brisa.plans.readings import readings, table
from brisa.schemas import KEY, PROFILE_POLLUTANTS, TIME


@query(
    "melt_pollutants",
    S.R
    + S.union_all(
        f"SELECT series_id, datetime, '{p}' AS pollutant, {p} AS value FROM r" for p in PROFILE_POLLUTANTS
    ),
)
def _(spark, folder):
    return shape.melt(readings(spark, folder), keep=(KEY, TIME))


@query("order_by_time", f"{S.R} SELECT {S.READING_COLUMNS} FROM r ORDER BY datetime, series_id")
def _(spark, folder):
    return shape.order_by_time(readings(spark, folder))


@query(
    "latest_row",
    f"""{S.R} SELECT {S.READING_COLUMNS} FROM r
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) = 1""",
)
def _(spark, folder):
    return shape.latest_row(readings(spark, folder))


@query(
    "last_n_rows",
    f"""{S.R} SELECT {S.READING_COLUMNS} FROM r
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) <= 24""",
)
def _(spark, folder):
    return shape.last_n_rows(readings(spark, folder), 24)


_HASH = """(((42 + series_id % 2147483647 * 7919 + (epoch(datetime) // 3600)::BIGINT % 2147483647 * 104729)
  % 2147483647) * 1103515245 + 12345) % 2147483647"""
_SAMPLE = f"s AS (SELECT * FROM r ORDER BY {_HASH}, series_id, datetime LIMIT 1000)"


@query("sample_n", f"{S.R}, {_SAMPLE} SELECT {S.READING_COLUMNS} FROM s")
def _(spark, folder):
    return shape.sample_n(readings(spark, folder))


@query(
    "pairwise_points",
    f"{S.R}, {_SAMPLE}"
    + S.union_all(
        f"SELECT series_id, datetime, '{a}' AS column_x, '{b}' AS column_y, {a} AS x, {b} AS y FROM s"
        for i, a in enumerate(PROFILE_POLLUTANTS)
        for b in PROFILE_POLLUTANTS[i + 1 :]
    ),
)
def _(spark, folder):
    return shape.pairwise_points(shape.sample_n(readings(spark, folder)))


@query(
    "preview_rows",
    "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM events ORDER BY event_id LIMIT 5",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", F.col("value"))
    return shape.preview_rows(events, 5, "event_id")
