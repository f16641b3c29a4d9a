"""Projections, casts, checks and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.registry import query
from brisa.functions.calendar import day_name
from brisa.functions.categories import health_category
from brisa.functions.numeric import to_published, to_stored
from brisa.operators import checks, features, windows
from brisa.operators.upsert import dedup_upsert, new_rows_only
from brisa.plans.readings import event_series, events, readings, table
from brisa.schemas import KEY, MODEL_FEATURES, REQUIRED_COLUMNS, REQUIRED_NON_NULL, TARGET, TIME

BATCH_START = "2024-01-15 00:00:00"
STORED_END = "2024-01-20 00:00:00"

# Chunks of a day: the recorded month would lie in a single one of the default length.
SPLIT = {"chunk_hours": 24}


# --- Projections, casts ---------------------------------------------------


@query("hour_floor", "SELECT event_id, date_trunc('hour', ts) AS datetime FROM events")
def _(spark, folder):
    return features.floor_to_hour(table(spark, folder, "events").select("event_id", F.col("ts").alias(TIME)))


@query(
    "calendar_features",
    f"{S.FT} SELECT series_id, datetime, hour, day, day_of_week, month, is_weekend FROM f",
)
def _(spark, folder):
    return features.add_calendar(readings(spark, folder).select(KEY, TIME))


@query("weekend_flag", f"{S.FT} SELECT series_id, datetime, is_weekend FROM f")
def _(spark, folder):
    return features.add_calendar(readings(spark, folder).select(KEY, TIME)).select(KEY, TIME, "is_weekend")


@query("day_name", f"{S.R} SELECT series_id, datetime, dayname(datetime) AS day_name FROM r")
def _(spark, folder):
    return readings(spark, folder).select(KEY, TIME, day_name(F.col(TIME)).alias("day_name"))


@query(
    "coerce_types",
    """SELECT event_id,
              CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS aqi,
              TRY_CAST(event_type AS DOUBLE) AS co, round(value, 6) AS pm2_5,
              CAST(trunc(value) AS INTEGER) AS hour
       FROM events""",
)
def _(spark, folder):
    source = table(spark, folder, "events")
    raw = source.select(
        "event_id",
        F.get_json_object("props", "$.k").alias(TARGET),
        F.col("event_type").alias("co"),
        F.col("value").cast("string").alias("pm2_5"),
        F.col("value").alias("hour"),
    )
    return features.coerce_types(raw)


@query(
    "required_non_null",
    f"""{S.R} SELECT {S.READING_COLUMNS} FROM r WHERE aqi IS NOT NULL AND co IS NOT NULL
          AND pm2_5 IS NOT NULL AND pm10 IS NOT NULL AND no2 IS NOT NULL""",
)
def _(spark, folder):
    return features.drop_incomplete(readings(spark, folder), [*REQUIRED_NON_NULL, "no2"])


@query("deterministic_id", f"{S.FT} SELECT event_id, series_id, datetime FROM f")
def _(spark, folder):
    return features.add_event_id(readings(spark, folder).select(KEY, TIME))


@query(
    "drop_non_features",
    f"{S.FT} SELECT {S.FEATURE_COLUMNS.replace('event_id, series_id, datetime, aqi,', '')} FROM f",
)
def _(spark, folder):
    return features.drop_non_features(features.compute_features(readings(spark, folder)))


@query(
    "align_features",
    f"""{S.R} SELECT series_id, datetime, co, CAST(no AS DOUBLE) AS no, coalesce(no2, 0.0) AS no2, o3, so2,
        pm2_5, pm10, nh3, {", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in MODEL_FEATURES[8:])} FROM r""",
)
def _(spark, folder):
    return features.align_features(readings(spark, folder), keep=[KEY, TIME])


@query(
    "rescale_aqi",
    f"{S.R} SELECT series_id, datetime, aqi + 1 AS published, (aqi + 1) - 1 AS stored FROM r",
)
def _(spark, folder):
    published = to_published(F.col(TARGET))
    return readings(spark, folder).select(
        KEY, TIME, published.alias("published"), to_stored(published).alias("stored")
    )


# --- Checks ---------------------------------------------------------------


@query(
    "required_columns_check",
    S.R
    + S.union_all(f"SELECT '{c}' AS \"check\", count({c}) >= 0 AS passed FROM r" for c in REQUIRED_COLUMNS)
    + " UNION ALL SELECT 'not_empty', count(*) > 0 FROM r",
)
def _(spark, folder):
    return checks.required_columns_check(readings(spark, folder))


@query(
    "integer_type_check",
    S.FT
    + S.union_all(
        f"""SELECT '{c}' AS "column", lower(any_value(typeof({c}))) AS type, any_value(typeof({c})) = 'BIGINT' AS passed,
            count({c}) AS "values" FROM f"""
        for c in (TARGET, "no")
    ),
)
def _(spark, folder):
    return checks.integer_type_check(features.compute_features(readings(spark, folder)))


@query(
    "range_check",
    S.R
    + S.union_all(
        f"""SELECT '{rule}' AS rule, '{column}' AS "column", '{severity}' AS severity,
            CAST(count_if({column} < {low} OR {column} > {high}) AS BIGINT) AS violations,
            count_if({column} < {low} OR {column} > {high}) = 0 AS passed FROM r"""
        for rule, column, low, high, severity in checks.RANGE_RULES
    ),
)
def _(spark, folder):
    return checks.range_check(readings(spark, folder))


SUITE = {
    "expectation_suite_name": "readings",
    "meta": {"owner": "tests"},
    "expectations": [
        {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "aqi"}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "no2"}},
        {
            "expectation_type": "expect_column_values_to_be_between",
            "kwargs": {"column": "pm2_5", "min_value": 0, "max_value": 200},
        },
        {
            "expectation_type": "expect_column_values_to_be_in_set",
            "kwargs": {"column": "aqi", "value_set": [0.0, 1.0, 2.0, 3.0]},
        },
    ],
}
_UNEXPECTED = [
    "CAST(count(*) < 1 AS BIGINT)",
    "count_if(aqi IS NULL)",
    "count_if(no2 IS NULL)",
    "count_if(pm2_5 < 0 OR pm2_5 > 200)",
    "count_if(aqi NOT IN (0, 1, 2, 3))",
]


@query(
    "expectation_run",
    S.R
    + S.union_all(
        f"""SELECT 'readings' AS suite_name, {i + 1} AS position, '{e["expectation_type"]}' AS expectation_type,
            '{e["kwargs"].get("column", "N/A")}' AS "column", CAST({bad} AS BIGINT) AS unexpected,
            {bad} = 0 AS passed FROM r"""
        for i, (e, bad) in enumerate(zip(SUITE["expectations"], _UNEXPECTED))
    ),
)
def _(spark, folder):
    return checks.expectation_run(readings(spark, folder), SUITE)


@query(
    "expectation_list",
    f"""{S.R}, b AS (SELECT 'series ' || series_id AS suite_name, floor(min(pm2_5))::BIGINT AS lo,
          ceil(max(pm2_5))::BIGINT AS hi FROM r GROUP BY series_id)
        SELECT suite_name, 1 AS position, 'expect_column_values_to_not_be_null' AS expectation_type,
          'aqi' AS "column", NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value FROM b
        UNION ALL SELECT suite_name, 2, 'expect_column_values_to_be_between', 'pm2_5', lo::VARCHAR, hi::VARCHAR FROM b
        UNION ALL SELECT suite_name, 3, 'expect_table_row_count_to_be_between', 'N/A', '1', NULL FROM b""",
)
def _(spark, folder):
    """One stored suite per series, with the range its readings have had."""
    ranges = readings(spark, folder).groupBy(KEY).agg(
        F.floor(F.min("pm2_5")).alias("lo"), F.ceil(F.max("pm2_5")).alias("hi")
    )
    suites = ranges.selectExpr(
        """to_json(struct(
             concat('series ', series_id) AS expectation_suite_name,
             map('owner', 'tests') AS meta,
             array(
               struct('expect_column_values_to_not_be_null' AS expectation_type, map('column', 'aqi') AS kwargs),
               struct('expect_column_values_to_be_between' AS expectation_type,
                      map('column', 'pm2_5', 'min_value', string(lo), 'max_value', string(hi)) AS kwargs),
               struct('expect_table_row_count_to_be_between' AS expectation_type, map('min_value', '1') AS kwargs)
             ) AS expectations)) AS value"""
    )
    return checks.expectation_list(suites).selectExpr(
        "* EXCEPT (params)",
        "try_element_at(params, 'min_value') AS min_value",
        "try_element_at(params, 'max_value') AS max_value",
    )


# --- Windows --------------------------------------------------------------


@query("aqi_change_rate", f"{S.W} SELECT series_id, datetime, aqi, aqi_change_rate FROM w")
def _(spark, folder):
    return windows.aqi_change_rate(readings(spark, folder).select(KEY, TIME, TARGET), **SPLIT)


@query(
    "rolling_mean_3_6_24",
    f"""{S.W} SELECT series_id, datetime, round(rolling_aqi_3h, 6) AS rolling_aqi_3h,
        round(rolling_aqi_6h, 6) AS rolling_aqi_6h, round(rolling_aqi_24h, 6) AS rolling_aqi_24h FROM w""",
)
def _(spark, folder):
    sizes = {"rolling_aqi_3h": 3, "rolling_aqi_6h": 6, "rolling_aqi_24h": 24}
    return windows.rolling_means(readings(spark, folder).select(KEY, TIME, TARGET), sizes, **SPLIT).drop(TARGET)


_SPREAD = f"""SELECT series_id, datetime,
  {S.r6(f"stddev_samp(aqi) OVER {S.rows(24)}")} AS rolling_std_24,
  min(aqi) OVER {S.rows(24)} AS rolling_min_24, max(aqi) OVER {S.rows(24)} AS rolling_max_24 FROM r"""


@query("rolling_std_24", f"{S.R} SELECT series_id, datetime, rolling_std_24 FROM ({_SPREAD})")
def _(spark, folder):
    spread = windows.rolling_spread(readings(spark, folder).select(KEY, TIME, TARGET), **SPLIT)
    return spread.select(KEY, TIME, "rolling_std_24")


@query(
    "rolling_min_max_24",
    f"{S.R} SELECT series_id, datetime, rolling_min_24, rolling_max_24 FROM ({_SPREAD})",
)
def _(spark, folder):
    spread = windows.rolling_spread(readings(spark, folder).select(KEY, TIME, TARGET))
    return spread.select(KEY, TIME, "rolling_min_24", "rolling_max_24")


@query(
    "next_category",
    f"""{S.R}, c AS (SELECT series_id, datetime, {S.health("aqi + 1")} AS aqi_category FROM r),
        n AS (SELECT *, lead(aqi_category) OVER (PARTITION BY series_id ORDER BY datetime) AS next_category FROM c)
        SELECT * FROM n WHERE next_category IS NOT NULL""",
)
def _(spark, folder):
    categories = readings(spark, folder).select(
        KEY, TIME, health_category(to_published(F.col(TARGET))).alias("aqi_category")
    )
    return windows.with_next(categories, {"next_category": "aqi_category"}, **SPLIT).where("next_category IS NOT NULL")


_TIME_MEANS = ", ".join(
    f"""round(avg(aqi) OVER (PARTITION BY series_id ORDER BY epoch(datetime)
        RANGE BETWEEN {n * 3600 - 1} PRECEDING AND CURRENT ROW), 6) AS mean_{n}h"""
    for n in (3, 6, 24)
)


@query("rolling_mean_time_range", f"{S.R} SELECT series_id, datetime, {_TIME_MEANS} FROM r")
def _(spark, folder):
    hours = {f"mean_{n}h": n for n in (3, 6, 24)}
    return windows.rolling_means_by_time(readings(spark, folder).select(KEY, TIME, TARGET), hours, **SPLIT).drop(TARGET)


@query(
    "rolling_mean_time_range_dense",
    "SELECT event_id, "
    + ", ".join(
        f"""round(avg(round(value * 100)) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT
            RANGE BETWEEN {n * 3600 - 1} PRECEDING AND CURRENT ROW), 6) AS mean_{n}h"""
        for n in (3, 6, 24)
    )
    + " FROM events",
)
def _(spark, folder):
    """Few series with many rows an hour: windows run over the seconds that have rows. Values in hundredths, whose sums are exact."""
    hours = {f"mean_{n}h": n for n in (3, 6, 24)}
    value = F.round(F.col("value") * 100).alias("value")
    rows = events(spark, folder).select(F.col("event_type").alias(KEY), F.col("ts").alias(TIME), "event_id", value)
    return windows.rolling_means_by_time(rows, hours, "value", many_per_second=True, **SPLIT).select("event_id", *hours)


@query("features_full", f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f")
def features_full(spark, folder):
    return features.compute_features(readings(spark, folder), **SPLIT)


@query(
    "incremental_features",
    f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f WHERE datetime >= TIMESTAMP '{STORED_END}'",
)
def _(spark, folder):
    every = readings(spark, folder)
    cut = F.lit(STORED_END).cast("timestamp")
    return features.incremental_features(every.where(F.col(TIME) < cut), every.where(F.col(TIME) >= cut), **SPLIT)


@query(
    "long_series_rolling",
    "SELECT event_id, "
    + ", ".join(
        f"""round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6)
            AS rolling_aqi_{n}h"""
        for n in (3, 6, 24)
    )
    + " FROM events",
)
def _(spark, folder):
    sizes = {"rolling_aqi_3h": 3, "rolling_aqi_6h": 6, "rolling_aqi_24h": 24}
    long = event_series(spark, folder)
    return windows.rolling_means(long, sizes, tie_breakers=("event_id",), rows_per_chunk=1_000).select("event_id", *sizes)


# --- New rows -------------------------------------------------------------


@query(
    "new_rows_only",
    f"""{S.R}, stored AS (SELECT * FROM r WHERE datetime < TIMESTAMP '{STORED_END}'),
        batch AS (SELECT * FROM r WHERE datetime >= TIMESTAMP '{BATCH_START}'),
        a AS (SELECT b.series_id FROM (SELECT series_id, max(datetime) AS m FROM batch GROUP BY series_id) b
              LEFT JOIN (SELECT series_id, max(datetime) AS m FROM stored GROUP BY series_id) s USING (series_id)
              WHERE s.m IS NULL OR b.m > s.m)
        SELECT {S.READING_COLUMNS} FROM batch WHERE series_id IN (SELECT series_id FROM a)""",
)
def _(spark, folder):
    every = readings(spark, folder)
    stored = every.where(F.col(TIME) < F.lit(STORED_END).cast("timestamp"))
    batch = every.where(F.col(TIME) >= F.lit(BATCH_START).cast("timestamp"))
    return new_rows_only(batch, stored)


@query(
    "dedup_upsert",
    f"""SELECT user_id AS series_id, date_trunc('hour', ts) AS datetime, max(event_id) AS event_id,
               arg_max(value, event_id) AS value
        FROM events WHERE ts >= TIMESTAMP '{BATCH_START}'
          AND (user_id, date_trunc('hour', ts)) NOT IN
              (SELECT (user_id, date_trunc('hour', ts)) FROM events WHERE ts < TIMESTAMP '{STORED_END}')
        GROUP BY ALL""",
)
def _(spark, folder):
    raw = events(spark, folder)
    every = raw.select(F.col("user_id").alias(KEY), F.date_trunc("hour", "ts").alias(TIME), "event_id", "value", "ts")
    stored = every.where(F.col("ts") < F.lit(STORED_END).cast("timestamp"))
    batch = every.where(F.col("ts") >= F.lit(BATCH_START).cast("timestamp")).drop("ts")
    return dedup_upsert(batch, stored, prefer=["event_id"])
