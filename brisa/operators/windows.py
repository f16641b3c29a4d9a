"""Row and time windows over series of any length.

A window partitioned by series alone puts a whole series into one task. Here a
series is cut into time chunks, and each chunk also gets copies of the few rows
before it that its windows look back at. Every chunk is then an independent
window group, so a series with a third of all rows spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from brisa.functions.numeric import without_nan
from brisa.schemas import KEY, TARGET, TIME
from brisa.session import new_dir

CHUNK = "_chunk"
COPY = "_is_copy"
CHUNK_HOURS = 90 * 24


def _chunk_of(time: str, chunk_hours: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / (chunk_hours * 3600)).cast("bigint")


def _ranked(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """Add ``_rank``, each row's place from 0 in its series, without gathering a series.

    Rows are range-partitioned by series and order, ties by all their columns, and written once, so that both readings below see the same places. A
    partition holds about as many rows as any other, however many of them share a series, an hour or a moment. Places within
    partitions, and a table with a row per partition and series, give the ranks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]).alias("_tie")
    placed = df.select("*", tie).repartitionByRange(parts, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie")
    placed = placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    path = new_dir(spark, "ranked")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    starts = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_rank"))


def _with_balanced_chunks(
    df: DataFrame, keys: tuple[str, ...], time: str, rows_per_chunk: int, tie_breakers: tuple[str, ...] = ()
) -> DataFrame:
    """Chunks of ``rows_per_chunk`` rows of a series, wherever they lie in time."""
    ranked = _ranked(df, keys, [time, *tie_breakers])
    return ranked.withColumn(CHUNK, F.floor(F.col("_rank") / rows_per_chunk))


def _with_rank_windows(
    df: DataFrame, build: Callable[[WindowSpec], dict[str, Column]], lookback: int, keys: tuple[str, ...], time: str,
    tie_breakers: tuple[str, ...], rows_per_chunk: int, backwards: bool,
) -> DataFrame:
    """Row windows over chunks of equally many rows. Which chunks look back at a row follows from its rank, so copies are made map-side."""
    rows = _with_balanced_chunks(df, keys, time, rows_per_chunk, tie_breakers)
    rank, own = F.col("_rank"), F.col(CHUNK)
    if backwards:
        low, high = F.greatest(F.floor((rank - lookback) / rows_per_chunk), F.lit(0)), own
    else:
        low, high = own, F.floor((rank + lookback) / rows_per_chunk)
    copied = rows.withColumn("_own", own).withColumn(CHUNK, F.explode(F.sequence(low, high)))
    window = Window.partitionBy(*keys, CHUNK).orderBy(rank.desc() if backwards else rank.asc())
    return copied.withColumns(build(window)).where(F.col(CHUNK) == F.col("_own")).drop(CHUNK, "_own", "_rank")


def with_row_windows(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    inputs: list[str],
    lookback: int,
    keys: tuple[str, ...] = (KEY,),
    time: str = TIME,
    tie_breakers: tuple[str, ...] = (),
    chunk_hours: int = CHUNK_HOURS,
    rows_per_chunk: int | None = None,
    backwards: bool = False,
) -> DataFrame:
    """Add the columns that ``build`` defines over "the last ``lookback`` rows and this one".

    ``build`` gets an ordered window and may use ``lag`` or ``rowsBetween(-k, 0)``
    with k up to ``lookback`` over the columns named in ``inputs``. With
    ``backwards`` the order is descending, so ``lag`` reads the following row.
    Gaps are fine: the copies come from as many earlier chunks as needed.

    Chunks are ``chunk_hours`` long, which suits one row per hour and costs no
    join. Where a series may hold any number of rows per hour, ``rows_per_chunk``
    makes chunks of that many rows instead; for that the ranked rows are written once.
    """
    if rows_per_chunk is not None:
        return _with_rank_windows(df, build, lookback, keys, time, tie_breakers, rows_per_chunk, backwards)
    order_columns = [time, *tie_breakers]
    rows = df.withColumn(CHUNK, _chunk_of(time, chunk_hours))
    rows = rows.withColumn(CHUNK, F.col(CHUNK) * (-1 if backwards else 1)).withColumn(COPY, F.lit(False))

    def ordered(descending: bool) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in order_columns]

    # The last rows of every chunk. Spark limits the groups before the shuffle.
    from_chunk_end = Window.partitionBy(*keys, CHUNK).orderBy(*ordered(not backwards))
    carried = list(dict.fromkeys([*order_columns, *inputs]))
    tails = (
        rows.select(*keys, CHUNK, *carried)
        .withColumn("_from_end", F.row_number().over(from_chunk_end))
        .where(F.col("_from_end") <= lookback)
        .groupBy(*keys, CHUNK)
        .agg(F.collect_list(F.struct(*carried)).alias("_tail"))
    )
    # Each chunk has at least one row, so `lookback` chunks hold all rows to copy.
    previous_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-lookback, -1)
    newest_first = F.sort_array(F.flatten(F.collect_list("_tail").over(previous_chunks)), asc=backwards)
    copies = (
        tails.withColumn("_row", newest_first)
        .withColumn("_row", F.explode(F.slice("_row", 1, lookback)))
        .select(*keys, CHUNK, *[F.col(f"_row.{c}").alias(c) for c in carried])
        .withColumn(COPY, F.lit(True))
    )
    window = Window.partitionBy(*keys, CHUNK).orderBy(*ordered(backwards))
    return (
        rows.unionByName(copies, allowMissingColumns=True)
        .withColumns(build(window))
        .where(~F.col(COPY))
        .drop(CHUNK, COPY)
    )


def with_time_windows(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    lookback_seconds: int,
    keys: tuple[str, ...] = (KEY,),
    time: str = TIME,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Same, for windows of true time: ``build`` may use ``rangeBetween(-s, 0)`` in seconds.

    Which rows a chunk looks back at follows from their time alone, so the
    copies are made map-side and the plan has one shuffle.
    """
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    length = chunk_hours * 3600
    if lookback_seconds > length:
        raise ValueError("a chunk must be at least as long as the window")
    chunk = _chunk_of(time, chunk_hours)
    near_end = seconds >= (chunk + 1) * length - lookback_seconds
    rows = (
        df.withColumn("_seconds", seconds)
        .withColumn(
            "_target",
            F.explode(
                F.when(
                    near_end,
                    F.array(
                        F.struct(chunk.alias(CHUNK), F.lit(False).alias(COPY)),
                        F.struct((chunk + 1).alias(CHUNK), F.lit(True).alias(COPY)),
                    ),
                ).otherwise(F.array(F.struct(chunk.alias(CHUNK), F.lit(False).alias(COPY))))
            ),
        )
        .withColumns({CHUNK: F.col(f"_target.{CHUNK}"), COPY: F.col(f"_target.{COPY}")})
    )
    window = Window.partitionBy(*keys, CHUNK).orderBy("_seconds")
    return rows.withColumns(build(window)).where(~F.col(COPY)).drop("_seconds", "_target", CHUNK, COPY)


def change_rate(value: Column, window: WindowSpec) -> Column:
    """Difference to the previous row; 0 for the first row or a missing value, null or NaN."""
    value = without_nan(value)
    return F.coalesce(value - F.lag(value).over(window), F.lit(0.0))


def aqi_change_rate(df: DataFrame, value: str = TARGET, **split) -> DataFrame:
    return with_row_windows(
        df, lambda w: {"aqi_change_rate": change_rate(F.col(value), w)}, [value], 1, **split
    )


def rolling_means(df: DataFrame, sizes: dict[str, int], value: str = TARGET, **split) -> DataFrame:
    """Trailing means over numbers of rows; a short start is averaged as it is."""
    return with_row_windows(
        df,
        lambda w: {name: F.avg(without_nan(F.col(value))).over(w.rowsBetween(1 - n, 0)) for name, n in sizes.items()},
        [value],
        max(sizes.values()) - 1,
        **split,
    )


def rolling_spread(df: DataFrame, rows: int = 24, value: str = TARGET, **split) -> DataFrame:
    """Trailing sample standard deviation, minimum and maximum."""

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1 - rows, 0)
        return {
            f"rolling_std_{rows}": F.stddev_samp(value).over(frame),
            f"rolling_min_{rows}": F.min(value).over(frame),
            f"rolling_max_{rows}": F.max(value).over(frame),
        }

    return with_row_windows(df, build, [value], rows - 1, **split)


def rolling_means_by_time(
    df: DataFrame, hours: dict[str, int], value: str = TARGET, many_per_second: bool = False, **split
) -> DataFrame:
    """Trailing means over true hours, so a gap shortens the window instead of stretching it.

    With ``many_per_second`` rows of one second are first added up, map-side, and the windows run over seconds, in groups of an
    hour however many rows it holds; each row then takes the means of its second.
    """
    if not many_per_second:
        return with_time_windows(
            df,
            lambda w: {
                name: F.avg(without_nan(F.col(value))).over(w.rangeBetween(1 - n * 3600, 0)) for name, n in hours.items()
            },
            max(hours.values()) * 3600,
            **split,
        )
    keys, time = split.get("keys", (KEY,)), split.get("time", TIME)
    second = F.unix_timestamp(F.col(time).cast("timestamp")).alias("_second")
    known = without_nan(F.col(value).cast("double"))
    sums = df.groupBy(*keys, second).agg(F.sum(known).alias("_sum"), F.count(known).alias("_count"))
    means = _means_of_seconds(sums, hours, list(keys))
    return df.withColumn("_second", second).join(means, [*keys, "_second"]).select(*df.columns, *hours)


def _means_of_seconds(sums: DataFrame, hours: dict[str, int], keys: list[str]) -> DataFrame:
    """Trailing means for rows (keys, _second, _sum, _count), one per second; the work grows with the rows and not with the windows.

    A window of n hours is what its own hour holds up to its second, the n - 1 whole hours before, and what the hour before those holds after
    the same minute and second. The outer two are running sums in groups of an hour, in which seconds of later hours stand as questions.
    """
    hour, sizes = F.floor(F.col("_second") / 3600), sorted(set(hours.values()))
    placed = F.array(
        F.struct(hour.alias("_hour"), F.lit(0).alias("_n"), F.col("_sum").alias("_s"), F.col("_count").alias("_c")),
        *[
            F.struct((hour - n).alias("_hour"), F.lit(n).alias("_n"), F.lit(None).cast("double").alias("_s"), F.lit(0).cast("bigint").alias("_c"))
            for n in sizes
        ],
    )
    rows = sums.select(*keys, "_second", F.inline(placed)).withColumn("_place", F.col("_second") % 3600)
    group = Window.partitionBy(*keys, "_hour")
    until = group.orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    after = group.orderBy(F.col("_place").desc()).rangeBetween(Window.unboundedPreceding, -1)
    own = F.col("_n") == 0
    ends = rows.withColumns({f"_{c}end": F.when(own, F.sum(c).over(until)).otherwise(F.sum(c).over(after)) for c in ("_s", "_c")})
    ends = ends.groupBy(*keys, "_second").agg(
        *[F.max(F.when(F.col("_n") == n, F.col(f"_{c}end"))).alias(f"{c}{n}") for n in (0, *sizes) for c in ("_s", "_c")]
    )
    whole = sums.groupBy(*keys, hour.alias("_hour")).agg(F.sum("_sum").alias("_s"), F.sum("_count").alias("_c"))
    later = whole.select(*keys, "_hour", "_s", "_c", F.explode(F.sequence(F.lit(0), F.lit(sizes[-1] - 1))).alias("_later"))
    between = later.groupBy(*keys, (F.col("_hour") + F.col("_later")).alias("_hour")).agg(
        *[
            F.sum(F.when((F.col("_later") > 0) & (F.col("_later") < n), F.col(c))).alias(f"{c}{n}whole")
            for n in sizes
            for c in ("_s", "_c")
        ]
    )
    total = lambda c, n: sum((F.coalesce(F.col(x), F.lit(0)) for x in (f"{c}0", f"{c}{n}whole", f"{c}{n}")), F.lit(0))
    found = ends.withColumn("_hour", hour).join(between, [*keys, "_hour"])
    return found.select(*keys, "_second", *[F.try_divide(total("_s", n), total("_c", n)).alias(name) for name, n in hours.items()])


def with_previous(df: DataFrame, columns: dict[str, str], **split) -> DataFrame:
    """Add the previous row's value of each column (new name -> column)."""
    return with_row_windows(
        df,
        lambda w: {name: F.lag(column).over(w) for name, column in columns.items()},
        list(columns.values()),
        1,
        **split,
    )


def with_next(df: DataFrame, columns: dict[str, str], **split) -> DataFrame:
    """Add the following row's value of each column (new name -> column)."""
    return with_previous(df, columns, backwards=True, **split)
