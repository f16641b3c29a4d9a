"""Calendar, lag and rolling features of hourly readings, and their typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.calendar import calendar_fields, hour_floor
from brisa.functions.numeric import without_nan
from brisa.operators.windows import change_rate, with_row_windows
from brisa.schemas import (
    FEATURE_TYPES,
    KEY,
    MODEL_FEATURES,
    REQUIRED_NON_NULL,
    ROLLING,
    TARGET,
    TIME,
)


DAY = "_day"
# How many earlier rows the features of a row depend on.
LOOKBACK_ROWS = max(ROLLING.values()) - 1


def floor_to_hour(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.withColumn(time, hour_floor(F.col(time).cast("timestamp")))


def add_calendar(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.withColumns(calendar_fields(F.col(time)))


def key_of(series: Column, time: Column) -> Column:
    """The same reading always gets the same id, so a repeated load is recognised."""
    return F.sha2(
        F.concat_ws("|", series.cast("string"), F.date_format(time, "yyyy-MM-dd HH:mm:ss")), 256
    )


def add_event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", key_of(F.col(KEY), F.col(TIME)))


def to_number(name: str, data_type: T.DataType, type_name: str) -> Column:
    """Coerce a column to a numeric type. Unreadable values and NaN become null."""
    if isinstance(data_type, T.IntegralType):
        return F.expr(f"try_cast(`{name}` AS {type_name})")
    number = f"try_cast(`{name}` AS double)"
    return F.expr(f"CASE WHEN NOT isnan({number}) THEN try_cast({number} AS {type_name}) END")


def coerce_types(df: DataFrame, label_type: str = "bigint") -> DataFrame:
    """Bring the columns that are present to the feature table's types.

    ``label_type`` "bigint" truncates the target as the feature table does;
    "double" keeps it.
    """
    wanted = {TARGET: label_type, "no": label_type, **FEATURE_TYPES}
    return df.withColumns(
        {
            field.name: to_number(field.name, field.dataType, wanted[field.name])
            for field in df.schema.fields
            if field.name in wanted
        }
    )


def drop_incomplete(df: DataFrame, required: list[str] = REQUIRED_NON_NULL) -> DataFrame:
    return df.dropna(subset=required)


def lag_and_rolling(window: WindowSpec, value: str = TARGET) -> dict[str, Column]:
    means = {name: F.avg(without_nan(F.col(value))).over(window.rowsBetween(1 - n, 0)) for name, n in ROLLING.items()}
    return {"aqi_change_rate": change_rate(F.col(value), window), **means}


def finished(windowed: DataFrame, label_type: str = "bigint") -> DataFrame:
    """Complete rows with calendar and id, in the feature table's types."""
    return coerce_types(add_event_id(add_calendar(drop_incomplete(windowed))), label_type)


def compute_features(df: DataFrame, label_type: str = "bigint", **split) -> DataFrame:
    """All features of readings that are unique per (series, hour).

    Windows see the target as it was read; it is typed only afterwards, and
    incomplete rows leave after they have taken their place in the windows.
    """
    return finished(with_row_windows(df, lag_and_rolling, [TARGET], LOOKBACK_ROWS, **split), label_type)


def drop_non_features(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Numeric columns without identifiers and label."""
    left_out = {TIME, "event_id", KEY, label}
    return df.select(
        [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in left_out]
    )


def align_features(df: DataFrame, names: list[str] = MODEL_FEATURES, keep: list[str] = ()) -> DataFrame:
    """Exactly the named columns in that order; an absent column or value is 0."""
    aligned = [
        f"coalesce(double(`{n}`), 0D) AS `{n}`" if n in df.columns else f"0D AS `{n}`" for n in names
    ]
    return df.selectExpr(*keep, *aligned)


def split_label(df: DataFrame, label: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """Features with their key, and the label with its key."""
    return df.drop(label), df.select(KEY, TIME, F.col(label))


def neighbour_days(stored: DataFrame, touched: DataFrame, lookback: int = LOOKBACK_ROWS) -> DataFrame:
    """(series, day) of the stored rows among the ``lookback`` rows before or after each touched day, and of that day.

    Both arguments hold a series and a time; stored rows are counted map-side, and a series has a row per day here. A day is taken if fewer than
    ``lookback`` stored rows lie between it and the nearest touched day on either side.
    """
    day = F.to_date(TIME).alias(DAY)
    marks = stored.select(KEY, day, F.lit(1).alias("_n"), F.lit(0).alias("_new")).unionByName(
        touched.select(KEY, day, F.lit(0).alias("_n"), F.lit(1).alias("_new"))
    )
    days = marks.groupBy(KEY, DAY).agg(F.sum("_n").alias("_n"), F.max("_new").alias("_new"))
    in_order = Window.partitionBy(KEY).orderBy(DAY)
    until, after = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    counted = days.withColumn("_so_far", F.sum("_n").over(until))
    new = F.col("_new") == 1
    last_new = F.last(F.when(new, F.col("_so_far")), True).over(until)
    next_new = F.first(F.when(new, F.col("_so_far") - F.col("_n")), True).over(after)
    since, until_next = F.col("_so_far") - F.col("_n") - last_new, next_new - F.col("_so_far")
    found = counted.withColumn("_near", new | F.coalesce(since < lookback, F.lit(False)) | F.coalesce(until_next < lookback, F.lit(False)))
    return found.where("_near AND _n > 0").select(KEY, DAY)


def rows_for_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The readings that the features of ``new`` need, with ``is_new``.

    Per series these are the new rows and the stored rows of the days that hold the 23 rows before and after each
    (see ``neighbour_days``), however long the series is. The stored rows are met by (series, day), never by series alone.
    """
    columns = new.columns
    days = neighbour_days(stored.select(KEY, TIME), new.select(KEY, TIME))
    old = stored.select(*columns, F.to_date(TIME).alias(DAY)).join(days, [KEY, DAY], "left_semi").drop(DAY)
    return old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))


def affected_rows(rows: DataFrame, **split) -> DataFrame:
    """The new rows and the 23 rows after each, which a late row changes too, with lag and rolling features."""

    def build(window: WindowSpec) -> dict[str, Column]:
        frame = window.rowsBetween(-LOOKBACK_ROWS, 0)
        return {**lag_and_rolling(window), "_affected": F.max("is_new").over(frame)}

    windowed = with_row_windows(rows, build, [TARGET, "is_new"], LOOKBACK_ROWS, **split)
    return windowed.where(F.col("_affected") == 1).drop("_affected", "is_new")


def affected_features(rows: DataFrame, label_type: str = "bigint", **split) -> DataFrame:
    """All features of these rows."""
    return finished(affected_rows(rows, **split), label_type)


def incremental_features(
    stored: DataFrame, new: DataFrame, label_type: str = "bigint", **split
) -> DataFrame:
    """Features of the rows that ``new`` adds or changes, equal to a full recomputation.

    ``stored`` and ``new`` are readings; keys in ``new`` are not in ``stored``.
    """
    return affected_features(rows_for_new(stored, new), label_type, **split)
