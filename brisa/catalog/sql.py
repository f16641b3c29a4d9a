"""Pieces of SQL shared by the equal queries."""

from __future__ import annotations

from brisa.functions import categories as C


def _readings(series: str) -> str:
    return f"""
  SELECT {series} AS series_id, datetime,
         LEAST(4.0, FLOOR(round(AVG(value), 6) / 30)) AS aqi,
         round(AVG(value) * 8 + 150, 6) AS co,
         CAST(MIN(k) % 10 AS BIGINT) AS no,
         round(AVG(CASE WHEN event_type <> 'signup' THEN value END), 6) AS no2,
         round(AVG(k), 6) AS o3,
         round(MIN(value) / 4, 6) AS so2,
         round(AVG(value), 6) AS pm2_5,
         round(AVG(value) * 1.5 + AVG(k), 6) AS pm10,
         round(MAX(k) / 4.0, 6) AS nh3
  FROM e GROUP BY {series}, datetime"""


_EVENTS = """
  SELECT event_id, user_id, ts, date_trunc('hour', ts) AS datetime, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type
  FROM events"""


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def rows(n: int, partition: str = "series_id", order: str = "datetime") -> str:
    """A trailing window of n rows."""
    return f"(PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_WINDOWED = f"""
  SELECT *,
         coalesce(aqi - lag(aqi) OVER (PARTITION BY series_id ORDER BY datetime), 0.0) AS aqi_change_rate,
         avg(aqi) OVER {rows(3)} AS rolling_aqi_3h,
         avg(aqi) OVER {rows(6)} AS rolling_aqi_6h,
         avg(aqi) OVER {rows(24)} AS rolling_aqi_24h
  FROM r"""

_FEATURES = """
  SELECT sha256(series_id::VARCHAR || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S')) AS event_id,
         series_id, datetime, CAST(trunc(aqi) AS BIGINT) AS aqi,
         co, no, no2, o3, so2, pm2_5, pm10, nh3,
         CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
         CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, CAST(month(datetime) AS INTEGER) AS month,
         CAST(isodow(datetime) IN (6, 7) AS INTEGER) AS is_weekend,
         aqi_change_rate, rolling_aqi_3h, rolling_aqi_6h, rolling_aqi_24h
  FROM w WHERE aqi IS NOT NULL AND co IS NOT NULL AND pm2_5 IS NOT NULL AND pm10 IS NOT NULL"""

# Readings r; dense readings r; with windows w; features f; v: a value on the 1-5 scale.
R = f"WITH e AS ({_EVENTS}), r AS ({_readings('user_id')})"
DENSE = f"WITH e AS ({_EVENTS}), r AS ({_readings('event_type')})"
W = f"{R}, w AS ({_WINDOWED})"
FT = f"{W}, f AS ({_FEATURES})"
V = f"{R}, v AS (SELECT series_id, datetime, avg(aqi) OVER {rows(3)} + 1 AS value FROM r)"

ORDERS = (
    "WITH r AS (SELECT o_custkey AS series_id, o_orderdate AS datetime, o_totalprice AS aqi FROM orders)"
)

FEATURE_COLUMNS = """event_id, series_id, datetime, aqi, co, no, no2, o3, so2, pm2_5, pm10, nh3,
  hour, day, day_of_week, month, is_weekend, aqi_change_rate,
  round(rolling_aqi_3h, 6) AS rolling_aqi_3h, round(rolling_aqi_6h, 6) AS rolling_aqi_6h,
  round(rolling_aqi_24h, 6) AS rolling_aqi_24h"""

READING_COLUMNS = "series_id, datetime, aqi, co, no, no2, o3, so2, pm2_5, pm10, nh3"


def text(value) -> str:
    if isinstance(value, list):
        value = " | ".join(value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def by_cut(value: str, cuts: list, results: list) -> str:
    branches = " ".join(f"WHEN {value} <= {cut} THEN {text(res)}" for cut, res in zip(cuts, results))
    return f"CASE WHEN {value} IS NULL THEN NULL {branches} ELSE {text(results[-1])} END"


def five_way(value: str, results: list) -> str:
    return by_cut(value, [1, 2, 3, 4], results)


def health(value: str) -> str:
    return five_way(value, C.HEALTH_CATEGORIES)


def fields(value: str, table: list[dict], names: list[str] | None = None) -> str:
    return ", ".join(f"{five_way(value, [row[n] for row in table])} AS {n}" for n in names or table[0])


def alert_level(value: str) -> str:
    branches = " ".join(f"WHEN {value} >= {cut} THEN '{level}'" for level, cut in C.ALERT_THRESHOLDS)
    return f"CASE WHEN {value} IS NULL THEN NULL {branches} ELSE 'good' END"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def spine(name: str, values: list) -> str:
    rows = ", ".join(f"({i}, {text(v)})" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS spine(position, {name})"
