"""The ingestion job: payloads to the feature table, as a batch.

Tables under a job's folder: ``readings`` and ``features`` by day, ``features_newest`` with one row per series, and by number of the
batch what was not taken in (``rejected`` readings, ``payload_errors``) and the findings of the checks (``checks``).
A batch that is repeated under its number writes these again; it adds nothing to the others.
"""

from __future__ import annotations

import time
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.operators.checks import in_range, validate
from brisa.operators.features import LOOKBACK_ROWS, affected_features, floor_to_hour
from brisa.operators.upsert import dedup, not_stored
from brisa.schemas import KEY, READINGS_SCHEMA, REQUIRED_COLUMNS, TIME
from brisa.session import enable_checkpoints
from brisa.sources.payload import payload_errors
from brisa.sources.store import DATE, REVISION, append_rows, keep_newest, read_table, stored_days

#: Days around a new row whose stored rows are looked at first; series with too few rows there are looked at further on.
REACHES = (2, 256, 65536)
#: Stretches of days that are named in a filter one by one.
STRETCHES = 100


def typed_readings(raw: DataFrame) -> DataFrame:
    """Readings on full hours, with ``reason`` for those that cannot be taken in.

    Incomplete ones are taken in: they have their place in the windows, and only their features are left out.
    NaN is a missing value. Without a required column no row can be taken in.
    """
    absent = [c for c in [KEY, *REQUIRED_COLUMNS] if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None) for c in absent}) if absent else raw
    missing = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in raw.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    known = raw.withColumns(missing) if missing else raw
    typed = floor_to_hour(known.select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields]))
    if absent:
        return typed.withColumn("reason", F.lit("no column " + ", ".join(absent)))
    reason = F.when(F.col(KEY).isNull() | F.col(TIME).isNull(), "no key").when(~in_range(), "out of range")
    return typed.withColumn("reason", reason)


def clean_readings(raw: DataFrame) -> DataFrame:
    """Readings on full hours that pass the rejecting checks, once per key."""
    return dedup(typed_readings(raw).where("reason IS NULL").drop("reason"))


def rejected_readings(raw: DataFrame) -> DataFrame:
    """The readings that are not taken in, with the reason."""
    return typed_readings(raw).where("reason IS NOT NULL")


def _put(df: DataFrame, path: str, number: int) -> None:
    """Rows of one batch; a repeat of the batch writes them again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _within(days: list[date], reach: int):
    """Filter on the stored day: within so many days of one of the given."""
    stretches: list[list[date]] = []
    for day in days:
        low, high = day - timedelta(days=min(reach, day.toordinal() - 1)), day + timedelta(days=min(reach, date.max.toordinal() - day.toordinal()))
        if stretches and low <= stretches[-1][1] + timedelta(days=1):
            stretches[-1][1] = high
        else:
            stretches.append([low, high])
    if len(stretches) > STRETCHES:
        stretches = [[stretches[0][0], stretches[-1][1]]]
    inside = F.lit(False)
    for low, high in stretches:
        inside = inside | F.col(DATE).between(F.lit(low), F.lit(high))
    return inside


def neighbour_rows(stored: DataFrame, fresh: DataFrame, days: list[date], first: date, last: date) -> DataFrame:
    """The stored readings around new ones, of each side of a new row's day the days that hold its 23 nearest rows.

    ``days`` are those of the new rows, ``first`` and ``last`` the ends of the stored table. Rounds look at more and more days around the new
    rows, by (series, day); only new rows that have too few neighbours there take part in the next. No round reads more than its
    days, and series that are met in the first round, as all are that have a row an hour, are not looked up again.

    Stored rows are counted by day where they are read. A day is held against the nearest new day on either side only, by running counts
    over the series' days: a farther one has at least as many rows between.
    """
    open_ = fresh.select(KEY, F.to_date(TIME).alias(DATE)).distinct()
    found = None
    in_order = Window.partitionBy(KEY).orderBy("_day")
    until, after = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    for reach in REACHES:
        some = stored.where(_within(days, reach))
        counts = some.groupBy(KEY, DATE).agg(F.count(F.lit(1)).alias("_n"))
        marks = counts.withColumn("_new", F.lit(False)).unionByName(open_.select(KEY, DATE, F.lit(0).alias("_n"), F.lit(True).alias("_new")))
        by_day = marks.groupBy(KEY, DATE).agg(F.sum("_n").alias("_n"), F.max("_new").alias("_new"))
        so_far = by_day.withColumn("_day", F.unix_date(DATE)).withColumn("_so_far", F.sum("_n").over(until))
        mark = lambda rows: F.when(F.col("_new"), F.struct(F.col("_day").alias("day"), rows.alias("rows")))
        sides = so_far.withColumns(
            {
                "_last": F.last(mark(F.col("_so_far")), True).over(until),
                "_next": F.first(mark(F.col("_so_far") - F.col("_n")), True).over(after),
                "_before": F.sum("_n").over(in_order.rangeBetween(-reach, -1)),
                "_after": F.sum("_n").over(in_order.rangeBetween(1, reach)),
            }
        )
        # Rows strictly between the day and the nearest new day on either side.
        since, to_next = F.col("_so_far") - F.col("_n") - F.col("_last.rows"), F.col("_next.rows") - F.col("_so_far")
        near = (since < LOOKBACK_ROWS) & (F.col("_day") - F.col("_last.day") <= reach)
        near_next = (to_next < LOOKBACK_ROWS) & (F.col("_next.day") - F.col("_day") <= reach)
        wanted_ = F.col("_new") | F.coalesce(near, F.lit(False)) | F.coalesce(near_next, F.lit(False))
        few = (F.coalesce("_before", F.lit(0)) < LOOKBACK_ROWS) & (F.date_sub(DATE, reach) > F.lit(first))
        few = few | ((F.coalesce("_after", F.lit(0)) < LOOKBACK_ROWS) & (F.date_add(DATE, reach) < F.lit(last)))
        ordered = sides.select(KEY, DATE, ((F.col("_n") > 0) & wanted_).alias("_wanted"), (F.col("_new") & few).alias("_few"))
        ordered = ordered.where("_wanted OR _few").checkpoint()
        rows = some.join(ordered.where("_wanted").select(KEY, DATE), [KEY, DATE], "left_semi")
        found = rows if found is None else found.unionByName(rows)
        open_ = ordered.where("_few").select(KEY, DATE)
        if open_.isEmpty():
            break
    return found.drop(DATE).distinct()


def keep_errors(payloads: DataFrame, path: str, number: int | None = None) -> None:
    """Store payloads that report an error."""
    _put(payload_errors(payloads), f"{path}/payload_errors", time.time_ns() // 1000 if number is None else number)


def ingest_batch(raw: DataFrame, path: str, revision: int | None = None, number: int | None = None) -> None:
    """Add a batch of raw readings to the tables under ``path``.

    Features are written first and readings last: if the job dies in between, a
    repeat finds the readings missing and writes the same features again, which
    ``current_features`` sees as one of the revisions of the same key. The revision is the time of
    writing, so later ones win also after a new start or a backfill. ``number`` names the batch, by default by its revision.
    """
    spark = raw.sparkSession
    enable_checkpoints(spark)
    revision = time.time_ns() // 1000 if revision is None else revision
    number = revision if number is None else number
    typed = typed_readings(raw).persist()
    taken = F.col("reason").isNull().alias("taken")
    counts = typed.groupBy(F.to_date(TIME).alias("day"), taken).count().collect()
    if any(not row["taken"] for row in counts):
        _put(typed.where("reason IS NOT NULL"), f"{path}/rejected", number)
    days = sorted(row["day"] for row in counts if row["taken"])
    if days:
        fresh = dedup(typed.where("reason IS NULL").drop("reason"))
        stored = read_table(spark, f"{path}/readings", READINGS_SCHEMA)
        known = stored_days(spark, f"{path}/readings")
        if known:
            # Checkpoints cut the plans, which grow with every round otherwise, and have as many parts as their rows need: a cached plan keeps all
            # partitions of its shuffles, however few rows a batch has.
            fresh = not_stored(fresh, stored.where(_within(days, 0))).checkpoint()
            old = neighbour_rows(stored, fresh, days, known[0], known[-1])
            rows = old.withColumn("is_new", F.lit(0)).unionByName(fresh.withColumn("is_new", F.lit(1))).checkpoint()
        else:
            fresh = fresh.checkpoint()
            rows = fresh.withColumn("is_new", F.lit(1))
        features = affected_features(rows).withColumn(REVISION, F.lit(revision).cast("bigint")).checkpoint()
        _put(validate(features), f"{path}/checks", number)
        append_rows(features, f"{path}/features")
        keep_newest(features, f"{path}/features", number)
        append_rows(fresh, f"{path}/readings")
    typed.unpersist()


def current_features(features: DataFrame) -> DataFrame:
    """The newest revision of every key; a late hour revises the rows after it."""
    return dedup(features, prefer=[REVISION]).drop(REVISION)
