"""Payloads, CSV, the feature table, snapshots and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.registry import once, query
from brisa.operators.features import compute_features, split_label
from brisa.plans.readings import events, readings
from brisa.schemas import FEATURES_SCHEMA, KEY, POLLUTANTS, READINGS_SCHEMA, TARGET, TIME
from brisa.session import new_dir
from brisa.sources import files, payload, store

_PAYLOAD_COLUMNS = "series_id, datetime, aqi, " + ", ".join(
    f"coalesce({c}, 0)::DOUBLE AS {c}" for c in POLLUTANTS
)


def payload_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Payload JSON text: one good payload per series and day, and an error payload per error event."""
    good = payload.to_payloads(readings(spark, folder))
    failed = events(spark, folder).where("event_type = 'error'").select(
        F.col("user_id").alias(KEY),
        F.lit("401").alias("cod"),
        F.when(F.col("k") < 50, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("message"),
        F.lit(None).cast(good.schema["list"].dataType).alias("list"),
    )
    return good.unionByName(failed).select(F.to_json(F.struct("*")).alias("value"))


@query("payload_explode", f"{S.R} SELECT {_PAYLOAD_COLUMNS} FROM r")
def _(spark, folder):
    return payload.payload_explode(payload.parse_payloads(payload_texts(spark, folder)))


@query(
    "payload_current",
    f"""{S.R} SELECT {_PAYLOAD_COLUMNS} FROM r
        QUALIFY row_number() OVER (PARTITION BY series_id, CAST(datetime AS DATE) ORDER BY datetime) = 1""",
)
def _(spark, folder):
    return payload.payload_current(payload.parse_payloads(payload_texts(spark, folder)))


@query(
    "payload_errors",
    """SELECT user_id AS series_id, '401' AS cod,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'event ' || event_id
              ELSE 'Unknown error' END AS message
       FROM events WHERE event_type = 'error'""",
)
def _(spark, folder):
    return payload.payload_errors(payload.parse_payloads(payload_texts(spark, folder)))


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])


@query(
    "csv_source",
    f"""{S.R} SELECT series_id, datetime, aqi, co, no::DOUBLE AS no, no2, o3, so2, pm2_5, pm10, nh3 FROM r""",
)
def _(spark, folder):
    path = new_dir(spark, "readings_csv")
    files.write_csv(_typed(readings(spark, folder), READINGS_SCHEMA), path)
    return files.read_csv(spark, path, READINGS_SCHEMA)


@query("csv_sink", f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f")
def _(spark, folder):
    path = new_dir(spark, "features_csv")
    files.write_csv(feature_table(spark, folder).drop("date"), path)
    return files.read_csv(spark, path, FEATURES_SCHEMA)


def _feature_path(spark: SparkSession, folder: str) -> str:
    """The features of all readings, stored by day, with their newest rows beside them."""

    def write() -> str:
        path = new_dir(spark, "features")
        features = _typed(compute_features(readings(spark, folder)), FEATURES_SCHEMA).persist()
        store.append_rows(features, path)
        store.keep_newest(features, path)
        features.unpersist()
        return path

    return once(spark, folder, "features", write)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The features of all readings, stored by day."""
    return store.read_table(spark, _feature_path(spark, folder))


def newest_features(spark: SparkSession, folder: str) -> DataFrame:
    """The newest features of every series, kept by the job that stores features; no history is read."""
    return store.newest_rows(spark, _feature_path(spark, folder))


@query(
    "feature_table_scan",
    f"{S.FT} SELECT {S.FEATURE_COLUMNS}, strftime(datetime, '%Y-%m-%d') AS date FROM f",
)
def _(spark, folder):
    return feature_table(spark, folder)


@query("feature_table_append", f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f")
def _(spark, folder):
    """Two overlapping inserts; each key arrives once."""
    path = new_dir(spark, "appended")
    every = feature_table(spark, folder).drop("date")
    store.insert_new(every.where(F.col(TIME) < F.lit("2024-01-20").cast("timestamp")), path)
    store.insert_new(every.where(F.col(TIME) >= F.lit("2024-01-15").cast("timestamp")), path)
    return store.read_table(spark, path).drop("date")


@query(
    "batch_window",
    f"""{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f
        WHERE datetime >= (SELECT max(datetime) FROM f) - INTERVAL 24 HOUR""",
)
def _(spark, folder):
    return store.batch_window(feature_table(spark, folder)).drop("date")


@query(
    "history_window",
    f"""{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f
        WHERE datetime >= (SELECT max(datetime) FROM f) - INTERVAL 10 DAY""",
)
def _(spark, folder):
    return store.history_window(feature_table(spark, folder), 10).drop("date")


@query("feature_label_split", f"{S.FT} SELECT {S.FEATURE_COLUMNS.replace(' aqi,', '')}, aqi AS label FROM f")
def _(spark, folder):
    x, y = split_label(feature_table(spark, folder).drop("date"))
    return x.join(y.withColumnRenamed(TARGET, "label"), [KEY, TIME])


@query(
    "training_snapshot",
    f"""{S.FT}, v AS (SELECT series_id, datetime, aqi AS label FROM f)
        SELECT series_id, datetime, label, 1 AS version FROM v
        UNION ALL SELECT series_id, datetime, label, 2 FROM v WHERE datetime >= TIMESTAMP '2024-01-15'""",
)
def _(spark, folder):
    """Two snapshots; the first stays readable after the second."""
    path = new_dir(spark, "snapshots")
    every = feature_table(spark, folder).drop("date")
    store.write_snapshot(every, path)
    store.write_snapshot(every.where(F.col(TIME) >= F.lit("2024-01-15").cast("timestamp")), path)
    labels = [
        store.read_snapshot(spark, path, version)[1].select(
            KEY, TIME, F.col(TARGET).alias("label"), F.lit(version).alias("version")
        )
        for version in store.snapshot_versions(spark, path)
    ]
    return labels[0].unionByName(labels[1])
