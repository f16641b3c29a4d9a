"""Profiles and summary statistics of a table or of readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.calendar import DAY_NAMES, day_name, season
from brisa.functions.categories import HEALTH_CATEGORIES, health_category
from brisa.functions.numeric import safe_correlation, to_published, varies, without_nan
from brisa.operators.quantiles import quartiles
from brisa.operators.shape import melt
from brisa.operators.sketches import approximate_quartiles
from brisa.operators.windows import with_previous
from brisa.schemas import CORRELATED, KEY, PROFILE_POLLUTANTS, SHARE_POLLUTANTS, TARGET, TIME

# Names of the five categories as columns.
CATEGORY_COLUMNS = dict(
    zip(HEALTH_CATEGORIES, ["good", "moderate", "unhealthy_sensitive", "unhealthy", "hazardous"])
)
RUSH_HOURS = {"morning_rush": (6, 9), "evening_rush": (17, 19)}


def _as_rows(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn the columns of a one-row aggregate into rows."""
    return one_row.select(F.inline(F.array(*rows)))


def _on_spine(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows for a fixed list of values, in order, with what ``df`` has for them.

    ``df`` is grouped by that column, so it has few rows and is broadcast.
    """
    spine = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name))
    return spine.join(F.broadcast(df), name, "left")


# --- Whole-table profiles -------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _as_rows(
        counted, [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each column, without nulls and NaN.

    Quartiles are exact, or with ``approximate`` from sketches made in one pass (see sketches.py).
    """
    columns = columns or numeric_columns(df)
    long = melt(df, columns, "column", "value").withColumn("value", without_nan(F.col("value").cast("double")))
    moments = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    box = approximate_quartiles if approximate else quartiles
    return long.groupBy("column").agg(*moments).join(box(long, ["column"], "value"), "column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier identical row."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def dataset_size(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(width).alias("columns"), (F.col("rows") * width).alias("cells")
    )


def date_range(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def schema_report(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column; time columns are flagged."""
    counted = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return _as_rows(
        counted,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f.name).alias("non_null"),
                F.lit(isinstance(f.dataType, times)).alias("is_time"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )


def label_range(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.agg(F.min(label).alias("min"), F.max(label).alias("max"), F.avg(label).alias("mean"))


# --- Time profiles --------------------------------------------------------


def hourly_profile(df: DataFrame, value: str = TARGET) -> DataFrame:
    return df.groupBy(F.hour(TIME).alias("hour")).agg(F.avg(value).alias("mean"))


def monthly_profile(df: DataFrame, value: str = TARGET) -> DataFrame:
    return df.groupBy(F.month(TIME).alias("month")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def weekday_profile(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Mean per day name, Monday first; a day without rows has a null mean."""
    means = df.groupBy(day_name(F.col(TIME)).alias("day_name")).agg(F.avg(value).alias("mean"))
    return _on_spine(means, "day_name", DAY_NAMES).select(
        "position", "day_name", "mean"
    )


def hour_month_pivot(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Mean per hour (rows) and month (columns m1 to m12)."""
    months = list(range(1, 13))
    pivoted = (
        df.groupBy(F.hour(TIME).alias("hour"), F.month(TIME).alias("month"))
        .agg(F.avg(value).alias("mean"))
        .groupBy("hour")
        .pivot("month", months)
        .agg(F.first("mean"))
    )
    return pivoted.select("hour", *[F.col(str(m)).alias(f"m{m}") for m in months])


def weekday_weekend_diff(df: DataFrame, value: str = TARGET) -> DataFrame:
    weekend = F.weekday(TIME) >= 5
    return df.agg(
        F.avg(F.when(~weekend, F.col(value))).alias("weekday_mean"),
        F.avg(F.when(weekend, F.col(value))).alias("weekend_mean"),
    ).withColumn(
        "weekday_over_weekend_percent",
        F.try_divide(F.col("weekday_mean") - F.col("weekend_mean"), F.col("weekend_mean")) * 100,
    )


def rush_hour_share(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Mean per hour band and its ratio to the mean of the other hours."""
    hour = F.hour(TIME)
    bands = {name: hour.between(*hours) for name, hours in RUSH_HOURS.items()}
    in_any = F.lit(False)
    for condition in bands.values():
        in_any = in_any | condition
    means = df.agg(
        *[F.avg(F.when(condition, F.col(value))).alias(name) for name, condition in bands.items()],
        F.avg(F.when(~in_any, F.col(value))).alias("other"),
    )
    return _as_rows(
        means,
        [
            F.struct(
                F.lit(name).alias("band"),
                F.col(name).alias("mean"),
                F.try_divide(F.col(name), F.col("other")).alias("ratio_to_other"),
            )
            for name in [*bands, "other"]
        ],
    )


def season_profile(df: DataFrame, value: str = TARGET) -> DataFrame:
    return df.groupBy(season(F.month(TIME)).alias("season")).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def gap_report(df: DataFrame, **split) -> DataFrame:
    """Missing hours between the first and the last hour of each series."""
    hour = F.expr("INTERVAL 1 HOUR")
    return (
        with_previous(df.select(KEY, TIME), {"_previous": TIME}, **split)
        .where(F.col(TIME) > F.col("_previous") + hour)
        .select(
            KEY, F.explode(F.sequence(F.col("_previous") + hour, F.col(TIME) - hour, hour)).alias("missing_hour")
        )
    )


# --- Categories -----------------------------------------------------------


def category_distribution(df: DataFrame, aqi: Column | None = None) -> DataFrame:
    """Rows per category in fixed order, empty categories included."""
    aqi = to_published(F.col(TARGET)) if aqi is None else aqi
    counts = df.groupBy(health_category(aqi).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return _on_spine(counts, "category", HEALTH_CATEGORIES).select(
        "position", "category", F.coalesce("n", F.lit(0)).alias("count")
    )


def transition_matrix(df: DataFrame, **split) -> DataFrame:
    """Counts of category (rows) followed by category (columns) within a series, zero-filled."""
    categories = df.select(KEY, TIME, health_category(to_published(F.col(TARGET))).alias("next"))
    pairs = (
        with_previous(categories, {"category": "next"}, **split)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .pivot("next", HEALTH_CATEGORIES)
        .count()
    )
    return _on_spine(pairs, "category", HEALTH_CATEGORIES).select(
        "position",
        "category",
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(slug) for c, slug in CATEGORY_COLUMNS.items()],
    )


def transition_percent(df: DataFrame, **split) -> DataFrame:
    """Row-wise percentages of the transition matrix; a row without transitions is null."""
    slugs = list(CATEGORY_COLUMNS.values())
    total = sum((F.col(s) for s in slugs[1:]), F.col(slugs[0]))
    return transition_matrix(df, **split).select(
        "position", "category", *[(F.try_divide(F.col(s), total) * 100).alias(s) for s in slugs]
    )


# --- Relations between columns -------------------------------------------


#: Products of columns that one aggregate sums, so that its code stays small enough to compile.
PRODUCTS = 80


def _pair_sums(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]], shift: Column) -> DataFrame:
    """Per pair of columns the sums that its correlation needs, from one pass over the rows.

    Rows are grouped by which values they hold (``_pattern``), as only rows that hold both count for a pair; there are few
    patterns, and they are combined map-side. Values are taken less a number near their mean, so that sums of squares keep their digits.
    """
    used = sorted({i for pair in pairs for i in pair})
    value = {i: f"_x{i}" for i in used}
    shifted = df.select(*columns).withColumn("_shift", shift).select(
        *[(F.col(columns[i]).cast("double") - F.col("_shift")[columns[i]]).alias(value[i]) for i in used]
    )
    pattern = sum((F.when(F.col(value[i]).isNotNull(), 1 << k).otherwise(0) for k, i in enumerate(used)), F.lit(0))
    sums = [F.count(F.lit(1)).alias("_n")]
    sums += [f(value[i]).alias(f"{value[i]}_{name}") for i in used for name, f in (("s", F.sum), ("l", F.min), ("h", F.max))]
    sums += [F.sum(F.col(value[i]) * F.col(value[j])).alias(f"_p{i}_{j}") for i, j in {*pairs, *((i, i) for i in used)}]
    by_pattern = shifted.withColumn("_pattern", pattern).groupBy("_pattern").agg(*sums)
    parts = []
    for i, j in pairs:
        both = F.expr(f"_pattern & {1 << used.index(i)} <> 0 AND _pattern & {1 << used.index(j)} <> 0")
        side = lambda i, name: [F.col(f"{value[i]}_{part}").alias(f"{part}{name}") for part in "slh"]
        products = [F.col(f"_p{a}_{b}").alias(n) for a, b, n in ((i, i, "xx"), (j, j, "yy"), (i, j, "xy"))]
        row = F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col("_n").alias("n"), *side(i, "x"), *side(j, "y"), *products)
        parts.append(F.when(both, row))
    rows = by_pattern.select(F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL").select("p.*")
    return rows.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("sx", "sy", "xx", "yy", "xy")],
        *[F.min(c).alias(c) for c in ("lx", "ly")],
        *[F.max(c).alias(c) for c in ("hx", "hy")],
    )


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, both directions and diagonal.

    Null where a column is constant over the rows that hold both. No row is generated per row: all pairs come from one
    aggregate, or from several of ``PRODUCTS`` pairs where there are many columns.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    shift = df.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])).scalar()
    chunks = [_pair_sums(df, columns, pairs[k : k + PRODUCTS], shift) for k in range(0, len(pairs), PRODUCTS)]
    sums = chunks[0]
    for chunk in chunks[1:]:
        sums = sums.unionByName(chunk)
    spread = lambda c: F.col(f"{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n")
    shared = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    differ = F.expr("lx < hx AND ly < hy")
    r = F.try_divide(shared, F.when(differ, F.sqrt(spread("x")) * F.sqrt(spread("y"))))
    both_ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    found = sums.select(F.explode(both_ways).alias("p"), r.alias("correlation")).select(
        F.col("p.a").alias("column_a"), F.col("p.b").alias("column_b"), "correlation"
    )
    # Pairs that no row holds.
    every = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_a")
    ).select("column_a", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_b"))
    return every.join(found, ["column_a", "column_b"], "left")


def pollutant_r2(df: DataFrame, pollutants: list[str] = PROFILE_POLLUTANTS, label: str = TARGET) -> DataFrame:
    """Share of the label's variance explained by each pollutant alone."""
    fits = df.agg(*[safe_correlation(F.col(p), F.col(label)).alias(p) for p in pollutants])
    return _as_rows(
        fits, [F.struct(F.lit(p).alias("pollutant"), (F.col(p) * F.col(p)).alias("r2")) for p in pollutants]
    )


def linear_trend(df: DataFrame, pollutants: list[str] = PROFILE_POLLUTANTS, label: str = TARGET) -> DataFrame:
    """Straight-line fit of the label on each pollutant; null for a constant pollutant."""
    parts = []
    for p in pollutants:
        fitted = varies(F.when(F.col(label).isNotNull(), F.col(p)))
        parts += [
            F.when(fitted, F.regr_slope(F.col(label), F.col(p))).alias(f"{p}_slope"),
            F.when(fitted, F.regr_intercept(F.col(label), F.col(p))).alias(f"{p}_intercept"),
            F.min(p).alias(f"{p}_min"),
            F.max(p).alias(f"{p}_max"),
        ]
    return _as_rows(
        df.agg(*parts),
        [
            F.struct(
                F.lit(p).alias("pollutant"),
                *[F.col(f"{p}_{part}").alias(part) for part in ("slope", "intercept")],
                *[F.col(f"{p}_{part}").alias(f"x_{part}") for part in ("min", "max")],
            )
            for p in pollutants
        ],
    )


def trend_line_points(df: DataFrame, points: int = 100, **columns) -> DataFrame:
    """Evenly spaced x values over each pollutant's range with the fitted label."""
    fits = linear_trend(df, **columns)
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("point") / (points - 1)
    return (
        fits.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select("pollutant", "point", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
    )


# --- Distributions --------------------------------------------------------


def _bounds(df: DataFrame, columns: list[str]) -> Column:
    """Lowest and highest value of every column, in one pass and as one value; a constant column gets a range of one around its value."""
    numbers = {c: F.col(c).cast("double") for c in columns}
    both = [F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(c) for c, v in numbers.items()]
    return df.agg(F.struct(*both)).scalar()


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Equal-width counts per column; the last bin is closed and empty bins are kept. Two passes: one for the bounds, one for the counts."""
    bounds = _bounds(df, columns)
    low, high = "_b.low", "_b.high"
    flat = F.col(low) == F.col(high)
    start, end = F.when(flat, F.col(low) - 0.5).otherwise(F.col(low)), F.when(flat, F.col(high) + 0.5).otherwise(F.col(high))
    of_column = F.element_at("_bounds", F.col("column"))
    named = F.create_map(*[x for c in columns for x in (F.lit(c), bounds[c])]).alias("_bounds")
    spine = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"), named)
        .withColumn("_b", of_column)
        .where(F.col(low).isNotNull())
        .select("column", start.alias("low"), end.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    numbers = df.select([F.col(c).cast("double").alias(c) for c in columns]).withColumn("_all", bounds)
    cells = []
    for c in columns:
        b = F.col("_all")[c]
        width = F.when(b["low"] == b["high"], F.lit(1.0)).otherwise(b["high"] - b["low"])
        begin = F.when(b["low"] == b["high"], b["low"] - 0.5).otherwise(b["low"])
        place = F.least(F.floor((F.col(c) - begin) / width * bins), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), place).alias("bin")))
    counts = numbers.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("column", "bin").count()
    edge = F.col("low") + (F.col("high") - F.col("low")) * F.col("bin") / bins
    return spine.join(counts, ["column", "bin"], "left").select(
        "column", "bin", edge.alias("bin_start"), F.coalesce("count", F.lit(0)).alias("count")
    )


#: Cells per bandwidth of a density, moments kept of each, and bandwidths beyond which a cell adds less than a double holds.
KDE_CELLS, KDE_MOMENTS, KDE_REACH = 8, 8, 9


def kde_curve(df: DataFrame, value: str = TARGET, points: int = 200) -> DataFrame:
    """Gaussian density estimate (Scott's bandwidth) on an even grid over the value range.

    Values are reduced to the moments of narrow cells, map-side. With d the distance of a value from its cell's centre and t that of the grid point, in
    bandwidths, exp(-(t - d)^2 / 2) = exp(-t^2 / 2) sum He_k(t) d^k / k! with Hermite polynomials He_k; with |d| <= 1/16 and eight
    terms the rest is below 1e-11 of a value's peak. Each cell adds to the grid points within nine bandwidths, so the rows generated depend on
    the range in bandwidths, not on the number of values. Constant values, and those whose deviation is too small for a double, have no curve.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    stats = values.agg(
        F.count("v").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        (F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))).alias("bandwidth"),
    )
    s = stats.select(F.struct("n", "low", "high", "bandwidth").alias("s")).scalar()
    n, low, high, bandwidth = (F.col(f"s.{c}") for c in ("n", "low", "high", "bandwidth"))
    varied = (low < high) & (bandwidth > 0)
    step = (high - low) / (points - 1)
    width = bandwidth / KDE_CELLS
    center = low + (F.col("cell") + 0.5) * width
    moments = [F.sum(F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in range(KDE_MOMENTS)]
    cells = (
        values.withColumn("s", s)
        .where(varied)
        .withColumn("cell", F.floor((F.col("v") - low) / width))
        .withColumn("d", (F.col("v") - center) / bandwidth)
        .groupBy("cell")
        .agg(*moments)
        .withColumn("s", s)
    )
    reach = KDE_REACH * bandwidth
    first = F.greatest(F.ceil((center - reach - low) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((center + reach - low) / step), F.lit(points - 1)).cast("int")
    near = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    t = F.col("t")
    hermite = [F.lit(1.0), t]
    for k in range(1, KDE_MOMENTS - 1):
        hermite.append(t * hermite[k] - k * hermite[k - 1])
    series = sum((hermite[k] * F.col(f"m{k}") / math.factorial(k) for k in range(1, KDE_MOMENTS)), F.col("m0"))
    scale = n * bandwidth * math.sqrt(2 * math.pi)
    added = (
        near.withColumn("t", (low + step * F.col("point") - center) / bandwidth)
        .groupBy("point")
        .agg(F.sum(F.exp(t * t * -0.5) * series / scale).alias("density"))
    )
    grid = df.sparkSession.range(1).withColumn("s", s).where(varied)
    grid = grid.select("s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = low + (high - low) * F.col("point") / (points - 1)
    return grid.join(added, "point", "left").select("point", x.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def boxplot_stats(df: DataFrame, group: str, value: str, approximate: bool = False) -> DataFrame:
    """Quartiles, whiskers at 1.5 times their distance, and outliers per group, without nulls and NaN.

    Quartiles are exact, or with ``approximate`` from sketches; whiskers and outliers are exact for the quartiles found.
    """
    known = without_nan(F.col(value).cast("double"))
    data = df.select(group, known.alias(value)).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    box = (approximate_quartiles if approximate else quartiles)(data, [group], value)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        data.join(box, group)
        .groupBy(group, "q25", "q50", "q75")
        .agg(
            F.count(value).alias("count"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def pollutant_means(df: DataFrame, pollutants: list[str] = SHARE_POLLUTANTS) -> DataFrame:
    means = df.agg(*[F.avg(p).alias(p) for p in pollutants])
    return _as_rows(
        means, [F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("mean")) for p in pollutants]
    ).orderBy(F.col("mean").desc(), "pollutant")


def pollutant_share(df: DataFrame, pollutants: list[str] = SHARE_POLLUTANTS) -> DataFrame:
    """Each mean as a share of the sum of the means."""
    means = df.agg(*[F.avg(p).alias(p) for p in pollutants])
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in pollutants[1:]), F.coalesce(pollutants[0], F.lit(0.0)))
    return _as_rows(
        means,
        [
            F.struct(
                F.lit(p).alias("pollutant"),
                F.col(p).alias("mean"),
                F.try_divide(F.col(p), total).alias("share"),
            )
            for p in pollutants
        ],
    )
