"""Column names and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "series_id"
TIME = "datetime"
TARGET = "aqi"

# The pollutant fields of a reading.
POLLUTANTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]
# The pollutants shown in profiles ("no" is not among them).
PROFILE_POLLUTANTS = ["co", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]
# The pollutants of the dashboard share chart.
SHARE_POLLUTANTS = ["pm2_5", "pm10", "no2", "o3", "so2", "co"]
# The columns of the correlation matrix.
CORRELATED = ["aqi", "co", "no2", "o3", "so2", "pm2_5", "pm10", "nh3", "hour", "month"]

# Names of derived columns, and the rows that each mean covers.
CALENDAR = ["hour", "day", "day_of_week", "month", "is_weekend"]
ROLLING = {"rolling_aqi_3h": 3, "rolling_aqi_6h": 6, "rolling_aqi_24h": 24}
DERIVED = ["aqi_change_rate", *ROLLING]

# What a table of readings must have.
REQUIRED_COLUMNS = [TIME, TARGET, *POLLUTANTS]
REQUIRED_NON_NULL = [TARGET, "co", "pm2_5", "pm10"]

# The model input vector, in order.
MODEL_FEATURES = [*POLLUTANTS, *CALENDAR, *DERIVED]

# Types of the feature table.
FEATURE_TYPES = {
    "co": "double",
    "no2": "double",
    "o3": "double",
    "so2": "double",
    "pm2_5": "double",
    "pm10": "double",
    "nh3": "double",
    "aqi_change_rate": "double",
    "rolling_aqi_3h": "double",
    "rolling_aqi_6h": "double",
    "rolling_aqi_24h": "double",
    "hour": "int",
    "day": "int",
    "day_of_week": "int",
    "month": "int",
    "is_weekend": "int",
}

# The form of a payload.
_COMPONENTS = T.StructType([T.StructField(name, T.DoubleType()) for name in POLLUTANTS])

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("cod", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField(
            "list",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("dt", T.LongType()),
                        T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
                        T.StructField("components", _COMPONENTS),
                    ]
                )
            ),
        ),
    ]
)

READINGS_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField(TIME, T.TimestampType()),
        T.StructField(TARGET, T.DoubleType()),
        *[T.StructField(name, T.DoubleType()) for name in POLLUTANTS],
    ]
)

FEATURES_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField(KEY, T.LongType()),
        T.StructField(TIME, T.TimestampType()),
        T.StructField(TARGET, T.LongType()),
        T.StructField("co", T.DoubleType()),
        T.StructField("no", T.LongType()),
        *[T.StructField(name, T.DoubleType()) for name in POLLUTANTS[2:]],
        *[T.StructField(name, T.IntegerType()) for name in CALENDAR],
        *[T.StructField(name, T.DoubleType()) for name in DERIVED],
    ]
)
