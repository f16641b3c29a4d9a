"""Categories, advisories and alerts. ``value`` is the 3-row mean on the published 1-5 scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.registry import query
from brisa.catalog.sources import newest_features
from brisa.functions import categories as C
from brisa.operators import advisory
from brisa.operators.forecast import forecast_heuristic
from brisa.operators.shape import latest_row
from brisa.operators.windows import rolling_means
from brisa.plans.readings import readings
from brisa.schemas import KEY, TARGET, TIME


def valued(spark, folder) -> DataFrame:
    smoothed = rolling_means(readings(spark, folder).select(KEY, TIME, TARGET), {"mean": 3})
    return smoothed.select(KEY, TIME, (F.col("mean") + 1).alias("value"))


_V = "series_id, datetime, round(value, 6) AS value"


@query("aqi_category_health", f"{S.V} SELECT {_V}, {S.health('value')} AS aqi_category FROM v")
def _(spark, folder):
    return advisory.add_health_category(valued(spark, folder), F.col("value"))


@query("aqi_status", f"{S.V} SELECT {_V}, {S.fields('value', C.STATUS)} FROM v")
def _(spark, folder):
    return advisory.add_status(valued(spark, folder), F.col("value"))


@query(
    "gauge_score",
    f"{S.V} SELECT {_V}, {S.fields('value', C.GAUGE, ['label', 'color'])}, "
    f"CAST({S.five_way('value', [row['score'] for row in C.GAUGE])} AS DOUBLE) AS score FROM v",
)
def _(spark, folder):
    return advisory.add_gauge(valued(spark, folder), F.col("value")).drop("level")


@query(
    "gauge_level",
    f"{S.V} SELECT {_V}, CAST(least(greatest(ceil(value), 1), 5) AS INTEGER) AS level FROM v",
)
def _(spark, folder):
    return advisory.add_gauge(valued(spark, folder), F.col("value")).select(KEY, TIME, "value", "level")


@query(
    "severity_band",
    f"""{S.V} SELECT {_V}, {S.by_cut("value", [2, 3, 4], [1, 2, 3, 4])} AS band,
        {S.by_cut("value", [2, 3, 4], C.SEVERITY_STYLES)} AS style FROM v""",
)
def _(spark, folder):
    return advisory.add_severity(valued(spark, folder), F.col("value"))


def _advisory_sql() -> str:
    bullets = lambda items: "\n".join(f"• {i}" for i in items)
    heads = [f"{a['title']}\nAQI: " for a in C.ADVISORY]
    tails = [
        f"\nHealth Impacts:\n{bullets(a['impacts'])}\nRecommended Actions:\n{bullets(a['actions'])}"
        for a in C.ADVISORY
    ]
    advisory_text = f"{S.five_way('value', heads)} || printf('%.2f', value) || {S.five_way('value', tails)}"
    return f"{S.V} SELECT {_V}, {S.fields('value', C.ADVISORY)}, {advisory_text} AS advisory FROM v"


@query("advisory_text", _advisory_sql())
def _(spark, folder):
    return advisory.add_advisory(valued(spark, folder), F.col("value"))


HEURISTIC_SQL = f"""{S.R}, latest AS (SELECT series_id, max(datetime) AS datetime, arg_max(aqi, datetime) AS aqi
        FROM r GROUP BY series_id),
      steps AS (SELECT series_id, aqi + 1 AS base, step, CAST(datetime AS DATE) + step AS d
        FROM latest, (VALUES (1), (2), (3)) AS s(step)),
      p AS (SELECT series_id, step, d, round(least(greatest(
          base + CASE WHEN isodow(d) >= 6 THEN 0.2::DOUBLE ELSE -0.1::DOUBLE END + step * 0.1::DOUBLE,
          0.5::DOUBLE), 5.0::DOUBLE), 6) AS predicted_aqi FROM steps)"""


@query(
    "planning_advice",
    f"""{HEURISTIC_SQL}, m AS (SELECT series_id, max(predicted_aqi) AS max_forecast FROM p GROUP BY series_id)
        SELECT series_id, max_forecast, {S.fields("max_forecast", C.PLANNING)} FROM m""",
)
def _(spark, folder):
    forecast = heuristic(spark, folder)
    return advisory.planning_advice(forecast, "predicted_aqi")


def heuristic(spark, folder) -> DataFrame:
    latest = latest_row(readings(spark, folder).select(KEY, TIME, TARGET))
    forecast = forecast_heuristic(latest, F.col(TARGET) + 1)
    return forecast.withColumn("predicted_aqi", F.round("predicted_aqi", 6))


@query(
    "alert_level",
    f"{S.V} SELECT {_V}, {S.alert_level('value')} AS level, value >= 2.0 AS should_alert FROM v",
)
def _(spark, folder):
    return advisory.alert_level(valued(spark, folder), F.col("value"))


def alert_message_sql() -> str:
    branches = []
    for level, parts in C.ALERTS.items():
        bullets = lambda items: "\n".join(f"• {i}" for i in items)
        head = f"{parts['title']}\n\nLocation: "
        tail = (
            f"\n\n{parts['mark']} HEALTH IMPACTS:\n{bullets(parts['impacts'])}"
            f"\n\n🛡️ RECOMMENDED ACTIONS:\n{bullets(parts['actions'])}\n\n{parts['closing']}"
        )
        branches.append(
            f"WHEN level = '{level}' THEN {S.text(head)} || location || '\nAQI: ' || printf('%.2f', value) "
            f"|| '\nTime: ' || strftime(datetime, '%Y-%m-%d %H:%M:%S') || {S.text(tail)}"
        )
    return f"CASE {' '.join(branches)} ELSE '{C.UNKNOWN_ALERT}' END"


ALERTS_SQL = f"""{S.V}, l AS (SELECT *, {S.alert_level("value")} AS level, value >= 2.0 AS should_alert,
        'series ' || series_id AS location FROM v)"""


@query(
    "alert_message",
    f"""{ALERTS_SQL} SELECT series_id, datetime, level,
        'AQI Alert: ' || upper(level) || ' - ' || location AS subject, {alert_message_sql()} AS message FROM l""",
)
def _(spark, folder):
    leveled = advisory.alert_level(valued(spark, folder), F.col("value"))
    location = F.concat(F.lit("series "), F.col(KEY).cast("string"))
    return leveled.select(
        KEY,
        TIME,
        "level",
        C.alert_subject(F.col("level"), location).alias("subject"),
        C.alert_message(F.col("level"), location, F.col("value"), F.col(TIME)).alias("message"),
    )


@query(
    "alert_events",
    f"""{ALERTS_SQL} SELECT {_V}, level, should_alert,
        'AQI Alert: ' || upper(level) || ' - ' || location AS subject, {alert_message_sql()} AS message
        FROM l WHERE should_alert""",
)
def _(spark, folder):
    location = F.concat(F.lit("series "), F.col(KEY).cast("string"))
    return advisory.alert_events(valued(spark, folder), F.col("value"), location)


@query(
    "staleness_check",
    f"""{S.R}, n AS (SELECT series_id, max(datetime) AS newest FROM r GROUP BY series_id),
        a AS (SELECT *, CAST(epoch((SELECT max(datetime) FROM r)) - epoch(newest) AS BIGINT) AS age_seconds FROM n)
        SELECT *, age_seconds > 10800 AS stale FROM a""",
)
def _(spark, folder):
    return advisory.staleness_check(newest_features(spark, folder))
