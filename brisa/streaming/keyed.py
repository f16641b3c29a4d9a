"""Streams with keyed state in Spark's state store. A watermark bounds the state, and no late row is lost.

A stateful operator drops rows that are later than its watermark before any code sees them. Here every row stands twice: as data,
which has no event time and is never dropped, and as a tick of the clock, which drives the watermark and ends there. What is too late for the
state is put out as it is, with ``late`` set, and the functions that read a job's output merge it: they are the table of corrections.

The state store holds per series only what may still change: keys of open hours (``dedup_by_state``), sums of open hours
(``hourly_by_state``), or the newest rows that windows look back at (``rolling_by_state``). Timers of event time empty it, also for a series that has fallen silent.

Finite input ends with ``end_marker``, a row without a series whose time lies behind all others and closes what is open.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brisa.operators.features import LOOKBACK_ROWS, affected_rows, finished, rows_for_new
from brisa.operators.upsert import dedup, not_stored
from brisa.schemas import DERIVED, KEY, READINGS_SCHEMA, ROLLING, TIME
from brisa.streaming.jobs import to_parquet

LATE = "late"
REVISION = "revision"
HOUR = 3600
#: Closed rows of a series that stay in the state: those that windows look back at, and as many for rows that are a little late.
KEPT = 2 * LOOKBACK_ROWS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def end_marker(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet") -> None:
    """Add the row that closes all open hours of a finite source. What comes after it is late."""
    row = [datetime(9000, 1, 1) if f.name == TIME else None for f in schema.fields]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    spark.createDataFrame([tuple(row)], nullable).coalesce(1).write.mode("append").format(kind).save(folder)


def _numbers(df: DataFrame) -> DataFrame:
    """Times as microseconds, which no time zone of a worker changes."""
    return df.select([F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


def _times(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The same back."""
    times = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select([F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in df.columns])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def with_clock(df: DataFrame, delay: str) -> DataFrame:
    """(series, clock, row): each row as data without event time. Its tick without data drives the watermark and goes no further."""
    numbers = _numbers(df)
    kind = _nullable(numbers.schema)
    time = F.timestamp_micros(TIME)
    tick = F.struct(time.alias("clock"), F.lit(None).cast(kind).alias("row"))
    data = F.struct(F.lit(None).cast("timestamp").alias("clock"), F.struct(*numbers.columns).cast(kind).alias("row"))
    known = F.col(KEY).isNotNull() & F.col(TIME).isNotNull()
    marks = F.when(known, F.array(tick, data)).otherwise(F.array(tick))
    # A condition on the clock stays behind the watermark, which has seen the ticks by then.
    return numbers.select(KEY, F.inline(marks)).withWatermark("clock", delay).where(F.col("clock").isNull())


def _transform(df: DataFrame, delay: str, processor: StatefulProcessor, output: T.StructType) -> DataFrame:
    keyed = with_clock(df, delay).groupBy(KEY)
    return keyed.transformWithState(processor, output, outputMode="Append", timeMode="EventTime")


def _run(df: DataFrame, path: str, every: str | None) -> StreamingQuery:
    spark = df.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return to_parquet(df, path, every, LATE)
    finally:
        # The query keeps the settings it was started with.
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    # Folder names are read as text.
    return rows.withColumn(LATE, F.col(LATE).cast("boolean"))


class _Keyed(StatefulProcessor):
    def __init__(self, output: T.StructType):
        self.names = output.fieldNames()

    def row(self, *values) -> Row:
        return Row(**dict(zip(self.names, values)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        pass

    def close(self) -> None:
        pass


def _data(rows: Iterator[Row]) -> Iterator[dict]:
    """The data rows by column; ticks are left out."""
    for row in rows:
        row = row["row"]
        if row is not None:
            yield row if isinstance(row, dict) else row.asDict()


def _order(row: dict) -> list[tuple]:
    """Rows by their values, as Spark orders them: nulls first."""
    return [(False, 0) if v is None else (True, v) for v in row.values()]


def _greatest(rows: Iterator[Row]) -> dict[int, dict]:
    """Of the data rows of each time the greatest by its other columns."""
    found: dict[int, dict] = {}
    for row in _data(rows):
        at = row[TIME]
        if at not in found or _order(row) > _order(found[at]):
            found[at] = row
    return found


# --- Each (series, hour) once ----------------------------------------------


class _First(_Keyed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value per series: it is read and written once per micro-batch, however many keys are open.
        self.seen = handle.getValueState("seen", "times array<bigint>")

    def _open(self, watermark: int) -> set[int]:
        held = self.seen.get()[0] if self.seen.exists() else []
        return {at for at in held if at // 1000 + 1 > watermark}

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        seen = self._open(watermark)
        before = max(seen, default=None)
        for at, row in _greatest(rows).items():
            if at // 1000 + 1 <= watermark:
                yield self.row(*row.values(), True)
            elif at not in seen:
                seen.add(at)
                yield self.row(*row.values(), False)
        if not seen:
            self.seen.clear()
            return
        self.seen.update((sorted(seen),))
        # The newest key's timer empties the state of a series that falls silent.
        if before is None or max(seen) > before:
            self.handle.registerTimer(max(seen) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = self._open(timerValues.getCurrentWatermarkInMs())
        if seen:
            self.seen.update((sorted(seen),))
        else:
            self.seen.clear()
        return iter(())


def dedup_by_state(readings: DataFrame, path: str, delay: str, every: str | None = None) -> StreamingQuery:
    """Each (series, time) once, in ``rows``. The state holds the keys that the watermark has not passed; ``deduplicated`` reads the result.

    Of rows that a micro-batch holds for one key the greatest counts, of those of different micro-batches the first.
    """
    output = _nullable(_numbers(readings).schema).add(LATE, T.BooleanType())
    found = _transform(readings, delay, _First(output), output)
    return _run(_times(found, readings.schema), path, every)


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """Rows in time, and the late ones whose key did not come in time."""
    rows = _rows(spark, path)
    in_time, late = rows.where(~F.col(LATE)).drop(LATE), rows.where(LATE).drop(LATE)
    return in_time.unionByName(not_stored(dedup(late), in_time))


# --- Hourly means ----------------------------------------------------------


def _closes(hour: int) -> int:
    """When the watermark has passed an hour, in milliseconds."""
    return (hour + 1) * HOUR * 1000


class _Sums(_Keyed):
    def __init__(self, output: T.StructType, value: str):
        super().__init__(output)
        self.value = value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value per series: it is read and written once per micro-batch, however many hours are open.
        self.sums = handle.getValueState("sums", "hours array<bigint>, totals array<double>, numbers array<bigint>")

    def _open(self) -> dict[int, tuple]:
        return {hour: (total, number) for hour, total, number in zip(*self.sums.get())} if self.sums.exists() else {}

    def _keep(self, open_: dict[int, tuple], timer: bool) -> None:
        if not open_:
            self.sums.clear()
            return
        hours = sorted(open_)
        self.sums.update((hours, [open_[h][0] for h in hours], [open_[h][1] for h in hours]))
        if timer:
            self.handle.registerTimer(_closes(hours[0]))

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        added: dict[int, tuple] = {}
        for row in _data(rows):
            hour = row[TIME] // 1_000_000 // HOUR
            total, number = added.get(hour, (None, 0))
            if row[self.value] is not None:
                total, number = (total or 0.0) + row[self.value], number + 1
            added[hour] = total, number
        open_ = self._open()
        first = min(open_, default=None)
        for hour, (total, number) in added.items():
            if _closes(hour) <= watermark:
                yield self.row(key[0], hour, total, number, True)
                continue
            if hour in open_:
                before, count = open_[hour]
                total = before if total is None else total + (before or 0.0)
                number += count
            open_[hour] = total, number
        # The earliest open hour has the timer, which sets that of the next.
        self._keep(open_, first is None or min(open_) < first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark, open_ = timerValues.getCurrentWatermarkInMs(), self._open()
        closed = sorted(hour for hour in open_ if _closes(hour) <= watermark)
        for hour in closed:
            yield self.row(key[0], hour, *open_.pop(hour), False)
        if closed:
            self._keep(open_, True)


def hourly_by_state(readings: DataFrame, path: str, value: str, delay: str, every: str | None = None) -> StreamingQuery:
    """Sum and count per series and hour, put out once when the watermark has passed the hour; late rows as further sums of it."""
    kind = readings.schema[KEY].dataType
    output = T.StructType([T.StructField(KEY, kind)])
    for name, type_ in (("hour", T.LongType()), ("sum", T.DoubleType()), ("count", T.LongType()), (LATE, T.BooleanType())):
        output = output.add(name, type_)
    narrow = readings.select(KEY, TIME, F.col(value).cast("double").alias(value))
    found = _transform(narrow, delay, _Sums(output, value), output)
    hour = F.timestamp_seconds(F.col("hour") * HOUR).alias(TIME)
    return _run(found.select(KEY, hour, "sum", "count", LATE), path, every)


def closed_hourly_means(spark: SparkSession, path: str) -> DataFrame:
    """Mean per series and hour of all closed hours, late rows included."""
    added = _rows(spark, path).groupBy(KEY, TIME).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return added.select(KEY, TIME, F.try_divide("sum", "count").alias("mean"), "count")


# --- Lag and rolling features ----------------------------------------------

_VALUES = READINGS_SCHEMA.fieldNames()[2:]


def _features(values: list, at: int) -> tuple:
    """Change and trailing means of the value at a place, as ``lag_and_rolling`` has them."""
    here, before = values[at], values[at - 1] if at else None
    change = here - before if here is not None and before is not None else 0.0
    means = []
    for size in ROLLING.values():
        known = [v for v in values[max(0, at + 1 - size) : at + 1] if v is not None]
        means.append(sum(known) / len(known) if known else None)
    return change, *means


class _Rolling(_Keyed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value per series: it is read and written once per micro-batch, however many rows it holds.
        self.state = handle.getValueState("rows", "times array<bigint>, held array<double>, trimmed boolean, revision bigint")

    def _held(self) -> tuple[dict[int, tuple], bool, int]:
        """The kept rows by time, whether rows were let go of, and the next revision."""
        if not self.state.exists():
            return {}, False, 0
        times, held, trimmed, revision = self.state.get()
        width = len(_VALUES)
        return {at: tuple(held[i * width : (i + 1) * width]) for i, at in enumerate(times)}, trimmed, revision

    def _keep(self, kept: dict[int, tuple], times: list[int], watermark: int, trimmed: bool, revision: int) -> None:
        """Keep ``KEPT`` rows that the watermark has passed, and all others."""
        closed = bisect_left(times, watermark * 1000)
        left = times[max(0, closed - KEPT) :]
        self.state.update((left, [v for at in left for v in kept[at]], trimmed or closed > KEPT, revision))

    def handleInputRows(self, key, rows, timerValues):
        arrived = _greatest(rows)
        if not arrived:
            return
        kept, trimmed, revision = self._held()
        earlier = sorted(kept)
        taken = []
        for at, row in arrived.items():
            if at in kept:
                continue
            # Its windows, or those of the rows after it, reach rows that the state has let go of.
            if trimmed and bisect_left(earlier, at) < LOOKBACK_ROWS:
                yield self.row(*row.values(), *[None] * len(DERIVED), None, True)
            else:
                taken.append(at)
        for at in taken:
            kept[at] = tuple(arrived[at][c] for c in _VALUES)
        times = sorted(kept)
        place = {at: i for i, at in enumerate(times)}
        changed = sorted({i for at in taken for i in range(place[at], min(place[at] + LOOKBACK_ROWS + 1, len(times)))})
        values = [kept[at][0] for at in times]
        for i in changed:
            yield self.row(key[0], times[i], *kept[times[i]], *_features(values, i), revision, False)
        self._keep(kept, times, timerValues.getCurrentWatermarkInMs(), trimmed, revision + 1)
        if taken:
            self.handle.registerTimer(times[-1] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept, trimmed, revision = self._held()
        self._keep(kept, sorted(kept), timerValues.getCurrentWatermarkInMs(), trimmed, revision)
        return iter(())


def rolling_by_state(readings: DataFrame, path: str, delay: str, every: str | None = None) -> StreamingQuery:
    """Lag and rolling features of readings on full hours, from the last rows of each series in the state store.

    Every reading is put out when it comes, and once more, with a higher revision, when one before it changes its windows.
    No table is looked up. A reading that comes after the state has let go of the rows around it is put out as late; ``rolling_features``
    puts it in its place.
    """
    names = READINGS_SCHEMA.fieldNames()
    typed = readings.select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    known = typed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _VALUES})
    output = _nullable(_numbers(typed).schema)
    for name in DERIVED:
        output = output.add(name, T.DoubleType())
    output = output.add(REVISION, T.LongType()).add(LATE, T.BooleanType())
    found = _transform(known.select(names), delay, _Rolling(output), output)
    return _run(_times(found, READINGS_SCHEMA), path, every)


def rolling_features(spark: SparkSession, path: str, label_type: str = "bigint") -> DataFrame:
    """The features of all readings so far, late ones in their places.

    Only the rows around late readings are computed anew here.
    """
    rows = _rows(spark, path)
    names = READINGS_SCHEMA.fieldNames()
    in_time = dedup(rows.where(~F.col(LATE)).drop(LATE), prefer=[REVISION]).drop(REVISION)
    late = not_stored(dedup(rows.where(LATE).select(names)), in_time)
    corrected = affected_rows(rows_for_new(in_time.select(names), late)).select(in_time.columns)
    whole = in_time.join(corrected.select(KEY, TIME), [KEY, TIME], "left_anti").unionByName(corrected)
    return finished(whole, label_type)
