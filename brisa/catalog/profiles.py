"""Profiles, correlations, distributions and category counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.advisories import HEURISTIC_SQL, heuristic
from brisa.catalog.features import SPLIT
from brisa.catalog.registry import query
from brisa.functions.calendar import DAY_NAMES
from brisa.functions.categories import HEALTH_CATEGORIES
from brisa.operators import profile, sketches
from brisa.operators.features import add_calendar
from brisa.operators.forecast import forecast_kpis
from brisa.operators.shape import melt
from brisa.plans.readings import dense_readings, order_series, readings, table
from brisa.schemas import CORRELATED, KEY, PROFILE_POLLUTANTS, SHARE_POLLUTANTS, TARGET, TIME
from brisa.session import new_dir

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
READINGS = S.READING_COLUMNS.split(", ")


# --- Whole-table profiles -------------------------------------------------


@query(
    "null_counts",
    S.R
    + S.union_all(f"""SELECT '{c}' AS "column", count_if({c} IS NULL)::BIGINT AS nulls FROM r""" for c in READINGS),
)
def _(spark, folder):
    return profile.null_counts(readings(spark, folder))


def _describe_sql(source: str, columns: list[str], ctes: str = "") -> str:
    return ctes + S.union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {S.r6(f"avg({c})")} AS mean,
            {S.r6(f"stddev_samp({c})")} AS std, {S.r6(f"min({c})::DOUBLE")} AS min,
            {S.r6(f"max({c})::DOUBLE")} AS max, {S.r6(f"quantile_cont({c}::DOUBLE, 0.25)")} AS q25,
            {S.r6(f"quantile_cont({c}::DOUBLE, 0.5)")} AS q50, {S.r6(f"quantile_cont({c}::DOUBLE, 0.75)")} AS q75
            FROM {source}"""
        for c in columns
    )


DESCRIBED = [TARGET, "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]


@query("describe", _describe_sql("r", DESCRIBED, S.R))
def _(spark, folder):
    return profile.describe(readings(spark, folder), DESCRIBED)


WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_wide", _describe_sql("lineitem", WIDE))
def _(spark, folder):
    """By the method for large inputs, whatever the size."""
    return profile.describe(table(spark, folder, "lineitem"), WIDE)


@query(
    "duplicate_rows",
    f"""SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(LINEITEM)} FROM lineitem))
        AS BIGINT) AS duplicate_rows
        FROM (SELECT 1 FROM lineitem UNION ALL SELECT 1 FROM lineitem WHERE l_returnflag = 'A')""",
)
def _(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(*LINEITEM)
    return profile.duplicate_rows(lineitem.unionByName(lineitem.where("l_returnflag = 'A'")))


@query(
    "dataset_size",
    'SELECT count(*) AS "rows", 11 AS "columns", count(*) * 11 AS cells FROM lineitem',
)
def _(spark, folder):
    return profile.dataset_size(table(spark, folder, "lineitem"))


@query("date_range", f'{S.R} SELECT min(datetime) AS "first", max(datetime) AS "last" FROM r')
def _(spark, folder):
    return profile.date_range(readings(spark, folder))


_KINDS = {KEY: "bigint", TIME: "timestamp", TARGET: "double", "no": "bigint"}


@query(
    "schema_report",
    S.R
    + S.union_all(
        f"""SELECT {i} AS position, '{c}' AS "column", '{_KINDS.get(c, "double")}' AS type, count({c}) AS non_null,
            {str(c == TIME).lower()} AS is_time FROM r"""
        for i, c in enumerate([KEY, TIME, TARGET, "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"])
    ),
)
def _(spark, folder):
    return profile.schema_report(readings(spark, folder))


@query("label_range", f"{S.R} SELECT min(aqi) AS min, max(aqi) AS max, {S.r6('avg(aqi)')} AS mean FROM r")
def _(spark, folder):
    return profile.label_range(readings(spark, folder))


# --- Time profiles --------------------------------------------------------


@query(
    "hourly_profile",
    f"{S.R} SELECT hour(datetime)::INTEGER AS hour, {S.r6('avg(aqi)')} AS mean FROM r GROUP BY 1",
)
def _(spark, folder):
    return profile.hourly_profile(readings(spark, folder))


@query(
    "monthly_profile",
    f"""{S.ORDERS} SELECT month(datetime)::INTEGER AS month, {S.r6("avg(aqi)")} AS mean,
        {S.r6("stddev_samp(aqi)")} AS std FROM r GROUP BY 1""",
)
def _(spark, folder):
    return profile.monthly_profile(order_series(spark, folder))


@query(
    "weekday_profile",
    f"""{S.R}, m AS (SELECT dayname(datetime) AS day_name, avg(aqi) AS mean FROM r GROUP BY 1)
        SELECT position, day_name, {S.r6("mean")} AS mean
        FROM {S.spine("day_name", DAY_NAMES)} LEFT JOIN m USING (day_name)""",
)
def _(spark, folder):
    return profile.weekday_profile(readings(spark, folder))


_MONTHS = ", ".join(f"{S.r6(f'avg(aqi) FILTER (month(datetime) = {m})')} AS m{m}" for m in range(1, 13))


@query(
    "hour_month_pivot",
    f"""{S.DENSE}, o AS (SELECT datetime, aqi FROM r
          UNION ALL SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), o_totalprice FROM orders)
        SELECT hour(datetime)::INTEGER AS hour, {_MONTHS} FROM o GROUP BY 1""",
)
def _(spark, folder):
    hour = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    orders = table(spark, folder, "orders").select(
        (F.col("o_orderdate").cast("timestamp") + hour).alias(TIME), F.col("o_totalprice").alias(TARGET)
    )
    return profile.hour_month_pivot(dense_readings(spark, folder).select(TIME, TARGET).unionByName(orders))


@query(
    "weekday_weekend_diff",
    f"""{S.R}, m AS (SELECT avg(aqi) FILTER (isodow(datetime) < 6) AS a, avg(aqi) FILTER (isodow(datetime) >= 6) AS b
          FROM r)
        SELECT {S.r6("a")} AS weekday_mean, {S.r6("b")} AS weekend_mean,
               {S.r6("(a - b) / b * 100")} AS weekday_over_weekend_percent FROM m""",
)
def _(spark, folder):
    return profile.weekday_weekend_diff(readings(spark, folder))


@query(
    "rush_hour_share",
    f"""{S.R}, h AS (SELECT aqi, CASE WHEN hour(datetime) BETWEEN 6 AND 9 THEN 'morning_rush'
            WHEN hour(datetime) BETWEEN 17 AND 19 THEN 'evening_rush' ELSE 'other' END AS band FROM r),
          m AS (SELECT band, avg(aqi) AS mean FROM h GROUP BY band)
        SELECT band, {S.r6("mean")} AS mean,
               {S.r6("mean / (SELECT mean FROM m WHERE band = 'other')")} AS ratio_to_other FROM m""",
)
def _(spark, folder):
    return profile.rush_hour_share(readings(spark, folder))


@query(
    "season_profile",
    f"""{S.ORDERS} SELECT CASE WHEN month(datetime) IN (11, 12, 1, 2) THEN 'winter'
            WHEN month(datetime) BETWEEN 6 AND 9 THEN 'summer' ELSE 'transition' END AS season,
          count(aqi) AS count, {S.r6("avg(aqi)")} AS mean, {S.r6("stddev_samp(aqi)")} AS std FROM r GROUP BY 1""",
)
def _(spark, folder):
    return profile.season_profile(order_series(spark, folder))


@query(
    "gap_report",
    f"""{S.R}, s AS (SELECT series_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR))
            AS missing_hour FROM r GROUP BY series_id)
        SELECT s.series_id, missing_hour FROM s
        LEFT JOIN r ON r.series_id = s.series_id AND r.datetime = missing_hour WHERE r.series_id IS NULL""",
)
def _(spark, folder):
    return profile.gap_report(readings(spark, folder), **SPLIT)


# --- Categories -----------------------------------------------------------


@query(
    "category_distribution",
    f"""{S.R}, c AS (SELECT {S.health("aqi + 1")} AS category, count(*) AS n FROM r GROUP BY 1)
        SELECT position, category, coalesce(n, 0) AS count
        FROM {S.spine("category", HEALTH_CATEGORIES)} LEFT JOIN c USING (category)""",
)
def _(spark, folder):
    return profile.category_distribution(readings(spark, folder))


_TRANSITIONS = f"""{S.DENSE}, c AS (SELECT series_id, datetime, {S.health("aqi + 1")} AS category FROM r),
  n AS (SELECT *, lead(category) OVER (PARTITION BY series_id ORDER BY datetime) AS following FROM c),
  t AS (SELECT category, {
    ", ".join(f"count_if(following = '{c}') AS {slug}" for c, slug in profile.CATEGORY_COLUMNS.items())
} FROM n WHERE following IS NOT NULL GROUP BY category),
  m AS (SELECT position, category, {
    ", ".join(f"coalesce({slug}, 0)::BIGINT AS {slug}" for slug in profile.CATEGORY_COLUMNS.values())
} FROM {S.spine("category", HEALTH_CATEGORIES)} LEFT JOIN t USING (category))"""


@query("transition_matrix", f"{_TRANSITIONS} SELECT * FROM m")
def transition_matrix(spark, folder):
    return profile.transition_matrix(dense_readings(spark, folder), **SPLIT)


_TOTAL = " + ".join(profile.CATEGORY_COLUMNS.values())


@query(
    "transition_percent",
    f"""{_TRANSITIONS} SELECT position, category, {
        ", ".join(f"{S.r6(f'{s} / nullif({_TOTAL}, 0) * 100')} AS {s}" for s in profile.CATEGORY_COLUMNS.values())
    } FROM m""",
)
def _(spark, folder):
    return profile.transition_percent(dense_readings(spark, folder), **SPLIT)


# --- Relations between columns -------------------------------------------


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _correlation_sql(columns: list[str]) -> str:
    pairs = [(a, b) for a in columns for b in columns]
    values = ", ".join(f"{S.r6(_corr(a, b))} AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = S.union_all(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, c{i} AS correlation FROM k" for i, (a, b) in enumerate(pairs)
    )
    return f"{S.FT}, k AS (SELECT {values} FROM (SELECT * EXCLUDE (aqi), aqi::DOUBLE AS aqi FROM f)) {rows}"


@query("correlation_matrix", _correlation_sql(CORRELATED))
def correlation_matrix(spark, folder):
    return profile.correlation_matrix(add_calendar(readings(spark, folder)))


@query("correlation_dashboard", _correlation_sql([*SHARE_POLLUTANTS, TARGET]))
def _(spark, folder):
    return profile.correlation_matrix(readings(spark, folder), [*SHARE_POLLUTANTS, TARGET])


@query(
    "pollutant_r2",
    S.R
    + S.union_all(
        f"SELECT '{p}' AS pollutant, {S.r6(f'power({_corr(p, TARGET)}, 2)')} AS r2 FROM r" for p in PROFILE_POLLUTANTS
    ),
)
def _(spark, folder):
    return profile.pollutant_r2(readings(spark, folder))


_FITS = S.union_all(
    f"""SELECT '{p}' AS pollutant, regr_slope(aqi, {p}) AS slope, regr_intercept(aqi, {p}) AS intercept,
        min({p}) AS x_min, max({p}) AS x_max FROM r"""
    for p in PROFILE_POLLUTANTS
)


@query(
    "linear_trend",
    f"""{S.R}, t AS ({_FITS}) SELECT pollutant, {S.r6("slope")} AS slope, {S.r6("intercept")} AS intercept,
        x_min, x_max FROM t""",
)
def _(spark, folder):
    return profile.linear_trend(readings(spark, folder))


@query(
    "trend_line_points",
    f"""{S.R}, t AS ({_FITS}), p AS (SELECT *, x_min + (x_max - x_min) * point / 99 AS x
          FROM t, (SELECT unnest(range(0, 100))::INTEGER AS point))
        SELECT pollutant, point, {S.r6("x")} AS x, {S.r6("intercept + slope * x")} AS y FROM p""",
)
def _(spark, folder):
    return profile.trend_line_points(readings(spark, folder))


# --- Distributions --------------------------------------------------------

HISTOGRAMS = [TARGET, *PROFILE_POLLUTANTS]


def _long(columns: list[str]) -> str:
    return S.union_all(f"""SELECT '{c}' AS "column", {c}::DOUBLE AS value FROM r WHERE {c} IS NOT NULL""" for c in columns)


@query(
    "histogram_20",
    f"""{S.R}, l AS ({_long(HISTOGRAMS)}),
        b AS (SELECT "column", min(value) AS low, max(value) AS high FROM l GROUP BY 1),
        c AS (SELECT "column", least(floor((value - low) / (high - low) * 20), 19)::INTEGER AS bin, count(*) AS n
              FROM l JOIN b USING ("column") GROUP BY 1, 2),
        s AS (SELECT "column", low, high, unnest(range(0, 20))::INTEGER AS bin FROM b)
        SELECT "column", bin, {S.r6("low + (high - low) * bin / 20")} AS bin_start, coalesce(n, 0) AS count
        FROM s LEFT JOIN c USING ("column", bin)""",
)
def _(spark, folder):
    return profile.histogram(readings(spark, folder), HISTOGRAMS)


@query(
    "kde_curve",
    f"""{S.R}, s AS (SELECT count(aqi) AS n, min(aqi) AS low, max(aqi) AS high,
            stddev_samp(aqi) * power(count(aqi)::DOUBLE, -0.2::DOUBLE) AS h FROM r),
          d AS (SELECT aqi AS v, count(*) AS weight FROM r WHERE aqi IS NOT NULL GROUP BY 1),
          g AS (SELECT point, low + (high - low) * point / 199 AS x, n, h
                FROM s, (SELECT unnest(range(0, 200))::INTEGER AS point))
        SELECT point, {S.r6("x")} AS x,
          {S.r6("sum(weight * exp(-0.5::DOUBLE * power((x - v) / h, 2)) / (n * h * sqrt(2 * pi())))")} AS density
        FROM g, d GROUP BY point, x""",
)
def _(spark, folder):
    return profile.kde_curve(readings(spark, folder))


def _boxplot_sql(ctes: str, source: str, group: str, value: str) -> str:
    return f"""{ctes}, l AS ({source}),
      q AS (SELECT {group}, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.5) AS q50,
              quantile_cont({value}, 0.75) AS q75 FROM l WHERE {value} IS NOT NULL GROUP BY 1),
      i AS (SELECT *, {value} BETWEEN q25 - (q75 - q25) * 1.5::DOUBLE AND q75 + (q75 - q25) * 1.5::DOUBLE AS inside
            FROM l JOIN q USING ({group}) WHERE {value} IS NOT NULL)
      SELECT {group}, {S.r6("q25")} AS q25, {S.r6("q50")} AS q50, {S.r6("q75")} AS q75, count(*) AS count,
        {S.r6(f"min({value}) FILTER (inside)")} AS whisker_low, {S.r6(f"max({value}) FILTER (inside)")} AS whisker_high,
        count_if(NOT inside)::BIGINT AS outliers
      FROM i GROUP BY {group}, q25, q50, q75"""


@query(
    "boxplot_stats",
    _boxplot_sql(S.R, _long(PROFILE_POLLUTANTS).replace('"column"', "pollutant"), "pollutant", "value"),
)
def boxplot_stats(spark, folder):
    return profile.boxplot_stats(melt(readings(spark, folder)), "pollutant", "value")


@query(
    "boxplot_by_month",
    _boxplot_sql(S.ORDERS, "SELECT month(datetime)::INTEGER AS month, aqi FROM r", "month", "aqi"),
)
def _(spark, folder):
    by_month = order_series(spark, folder).withColumn("month", F.month(TIME))
    return profile.boxplot_stats(by_month, "month", TARGET)


@query(
    "boxplot_by_weekday",
    _boxplot_sql(S.R, "SELECT dayname(datetime) AS day_name, aqi FROM r", "day_name", "aqi"),
)
def _(spark, folder):
    by_day = readings(spark, folder).withColumn("day_name", F.date_format(TIME, "EEEE"))
    return profile.boxplot_stats(by_day, "day_name", TARGET)


RANKS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query(
    "approximate_quantiles",
    f"""{S.R}, l AS ({_long(PROFILE_POLLUTANTS)})
        SELECT "column", p AS probability, true AS within_bound
        FROM (SELECT DISTINCT "column" FROM l), (SELECT unnest({RANKS})::DOUBLE AS p)""",
)
def _(spark, folder):
    """Quantiles from sketches stored by day in two batches: whether the exact rank of each is within the bound."""
    path = new_dir(spark, "sketches")
    every = readings(spark, folder)
    for number, part in enumerate((F.dayofmonth(TIME) % 2 == 0, F.dayofmonth(TIME) % 2 == 1)):
        sketches.keep_sketches(every.where(part), PROFILE_POLLUTANTS, path, number)
    found = sketches.stored_quantiles(spark, path, RANKS)
    errors = sketches.rank_errors(every, found, PROFILE_POLLUTANTS)
    # Twice the bound of 99 % confidence: no sketch is beyond that.
    return errors.select("column", "probability", (F.col("error") <= 2 * sketches.rank_bound()).alias("within_bound"))


_MEANS = S.union_all(f"SELECT '{p}' AS pollutant, avg({p}) AS mean FROM r" for p in SHARE_POLLUTANTS)


@query("pollutant_means", f"{S.R}, m AS ({_MEANS}) SELECT pollutant, {S.r6('mean')} AS mean FROM m")
def _(spark, folder):
    return profile.pollutant_means(readings(spark, folder))


@query(
    "pollutant_share",
    f"""{S.R}, m AS ({_MEANS}) SELECT pollutant, {S.r6("mean")} AS mean,
        {S.r6("mean / (SELECT sum(mean) FROM m)")} AS share FROM m""",
)
def _(spark, folder):
    return profile.pollutant_share(readings(spark, folder))


@query(
    "forecast_kpis",
    f"""{HEURISTIC_SQL}, k AS (SELECT series_id, avg(predicted_aqi) AS mean, arg_min(predicted_aqi, step) AS f,
          arg_max(predicted_aqi, step) AS l, arg_max(d, (predicted_aqi, -step)) AS peak FROM p GROUP BY series_id)
        SELECT series_id, {S.r6("mean")} AS mean, CASE WHEN l < f THEN 'Improving' ELSE 'Worsening' END AS trend,
          strftime(peak, '%Y-%m-%d') AS peak_date, substr(dayname(peak), 1, 3) AS peak_day FROM k""",
)
def _(spark, folder):
    return forecast_kpis(heuristic(spark, folder))
