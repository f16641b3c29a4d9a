"""Data checks. Each returns its findings as rows; a failed check never raises."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.numeric import without_nan
from brisa.schemas import REQUIRED_COLUMNS, TARGET

# Fixed values: (rule, column, low, high, severity).
RANGE_RULES = [
    ("aqi_0_4", "aqi", 0.0, 4.0, "reject"),
    ("aqi_0_5", "aqi", 0.0, 5.0, "warn"),
    ("pm2_5_0_500", "pm2_5", 0.0, 500.0, "warn"),
]

EXPECTATION_SUITE_SCHEMA = T.StructType(
    [
        T.StructField("expectation_suite_name", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "expectations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("expectation_type", T.StringType()),
                        T.StructField("kwargs", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def required_columns_check(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column, and one for "has any row" (stops at the first row)."""
    present = [F.struct(F.lit(name).alias("check"), F.lit(name in df.columns).alias("passed")) for name in required]
    any_row = df.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n"))
    not_empty = F.struct(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("passed"))
    return any_row.select(F.inline(F.array(*present, not_empty)))


def integer_type_check(df: DataFrame, columns: tuple[str, ...] = (TARGET, "no")) -> DataFrame:
    """Whether each column is there with an integer type, and the number of values it holds."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = df.agg(*[(F.count(c) if c in kinds else F.lit(0).cast("bigint")).alias(c) for c in columns])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(kinds[c].simpleString() if c in kinds else "absent").alias("type"),
                        F.lit(isinstance(kinds.get(c), T.IntegralType)).alias("passed"),
                        F.col(c).alias("values"),
                    )
                    for c in columns
                ]
            )
        )
    )


def range_check(df: DataFrame, rules: list[tuple] = RANGE_RULES) -> DataFrame:
    """Violations per rule, all rules in one pass. A missing value, null or NaN, violates nothing.

    The rule of an absent column, or of one that holds no numbers, has failed and has no count.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    def violations(column: str, low: float, high: float) -> Column:
        if column not in numbers:
            return F.lit(None).cast("bigint")
        value = without_nan(F.col(column).cast("double"))
        return F.count_if((value < low) | (value > high))

    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[violations(c, low, high).alias(rule) for rule, c, low, high, _ in rules])
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.lit(c).alias("column"),
                        F.lit(severity).alias("severity"),
                        F.col(rule).alias("violations"),
                        F.coalesce(F.col(rule) == 0, F.lit(False)).alias("passed"),
                    )
                    for rule, c, _, _, severity in rules
                ]
            )
        )
    )


def in_range(rules: list[tuple] = RANGE_RULES, severity: str = "reject") -> Column:
    """Row predicate: no rule of that severity is violated."""
    keep = F.lit(True)
    for _, column, low, high, level in rules:
        if level == severity:
            keep = keep & F.coalesce(F.col(column).between(low, high) | F.isnan(F.col(column).cast("double")), F.lit(True))
    return keep


def validate(df: DataFrame) -> DataFrame:
    """All checks as (check, severity, passed)."""
    reject = F.lit("reject").alias("severity")
    columns = required_columns_check(df).select("check", reject, "passed")
    types = integer_type_check(df).select(
        F.concat(F.lit("integer:"), "column").alias("check"), reject, "passed"
    )
    ranges = range_check(df).select(F.col("rule").alias("check"), "severity", "passed")
    return columns.unionByName(types).unionByName(ranges)


def expectation_list(suites: DataFrame, text: str = "value") -> DataFrame:
    """The expectations of suites stored as JSON text, one row each, in order."""
    suite = F.from_json(F.col(text), EXPECTATION_SUITE_SCHEMA)
    return (
        suites.select(suite.alias("suite"))
        .select(
            F.col("suite.expectation_suite_name").alias("suite_name"),
            F.posexplode("suite.expectations").alias("position", "expectation"),
        )
        .select(
            "suite_name",
            (F.col("position") + 1).alias("position"),
            F.col("expectation.expectation_type").alias("expectation_type"),
            F.coalesce(F.col("expectation.kwargs")["column"], F.lit("N/A")).alias("column"),
            F.col("expectation.kwargs").alias("params"),
        )
    )


def suite_frame(spark: SparkSession, suite: dict) -> DataFrame:
    """A suite given as a dictionary, as stored text."""
    return spark.createDataFrame([(json.dumps(suite),)], "value string")


def _literal(value, kind: T.DataType) -> Column:
    """A bound or member of a set in the type of the column it is compared with; null if it is none."""
    value = F.lit(value if isinstance(value, (int, float, str)) and not isinstance(value, bool) else str(value))
    return value.try_cast("double" if isinstance(kind, T.NumericType) else kind)


def _comparable(column: str, kind: T.DataType, bounds: list) -> tuple[Column, T.DataType]:
    """A column as it is compared with the given values. A text is compared with numbers as the number it holds."""
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType) and any(isinstance(b, (int, float)) for b in bounds):
        kind, value = T.DoubleType(), F.coalesce(value.try_cast("double"), F.when(value.isNotNull(), float("inf")))
        return value, kind
    if isinstance(kind, T.NumericType):
        return without_nan(value.cast("double")), T.DoubleType()
    return value, kind


def _unexpected(expectation: dict, kinds: dict[str, T.DataType]) -> Column | None:
    """The number of rows, or for a whole table 0 or 1, that an expectation does not hold for; None if that cannot be told.

    NaN is a missing value. A text that is no number lies in no range of numbers and in no set of them.
    """
    kind, kwargs = expectation.get("expectation_type"), expectation.get("kwargs") or {}
    low, high = kwargs.get("min_value"), kwargs.get("max_value")
    if kind == "expect_table_row_count_to_be_between":
        rows = F.count(F.lit(1))
        least = F.coalesce(F.lit(low).try_cast("bigint"), F.lit(0))
        bad = rows < least
        return (bad if high is None else bad | (rows > F.lit(high).try_cast("bigint"))).cast("bigint")
    type_ = kinds.get(kwargs.get("column"))
    if type_ is None:
        return None
    column = kwargs["column"]
    if kind == "expect_column_values_to_not_be_null":
        value = F.col(f"`{column}`")
        return F.count_if((without_nan(value) if isinstance(type_, (T.DoubleType, T.FloatType)) else value).isNull())
    if not isinstance(type_, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    if kind == "expect_column_values_to_be_between":
        bounds = [b for b in (low, high) if b is not None]
        value, type_ = _comparable(column, type_, bounds)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < _literal(low, type_))
        if high is not None:
            bad = bad | (value > _literal(high, type_))
        # A bound that is none of the column's type leaves no count.
        readable = [_literal(b, type_).isNotNull() for b in bounds]
        found = F.count_if(bad)
        for known in readable:
            found = F.when(known, found)
        return found
    if kind == "expect_column_values_to_be_in_set" and isinstance(kwargs.get("value_set"), list):
        value, type_ = _comparable(column, type_, kwargs["value_set"])
        inside = F.lit(False)
        for member in kwargs["value_set"]:
            inside = inside | F.coalesce(value == _literal(member, type_), F.lit(False))
        return F.count_if(value.isNotNull() & ~inside)
    return None


def expectation_run(df: DataFrame, suite: dict) -> DataFrame:
    """Run a suite over a table: every expectation is one aggregate of the same pass.

    An expectation of an unknown type, about an absent column, or that cannot be tested on its column has no count and has failed.
    """
    expectations = suite["expectations"]
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def counts(expectation: dict) -> Column:
        found = _unexpected(expectation, kinds)
        return F.lit(None).cast("bigint") if found is None else found

    counted = df.agg(F.count(F.lit(1)), *[counts(e).alias(f"u{i}") for i, e in enumerate(expectations)])
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(suite["expectation_suite_name"]).alias("suite_name"),
                        F.lit(i + 1).alias("position"),
                        F.lit(e.get("expectation_type")).cast("string").alias("expectation_type"),
                        F.lit((e.get("kwargs") or {}).get("column", "N/A")).alias("column"),
                        F.col(f"u{i}").alias("unexpected"),
                        F.coalesce(F.col(f"u{i}") == 0, F.lit(False)).alias("passed"),
                    )
                    for i, e in enumerate(expectations)
                ]
            )
        )
    )
