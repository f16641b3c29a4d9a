"""Registration of queries and the form of their output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brisa.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple, object] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Output form: doubles to 6 digits, timestamps without zone, dates and lists as text."""
    forms = {
        T.DoubleType: "round({0}, 6) + 0D",  # adding zero turns a negative zero into zero
        T.TimestampType: "cast({0} AS timestamp_ntz)",
        T.DateType: "cast({0} AS string)",
        T.ArrayType: "array_join({0}, ' | ')",
    }
    return df.selectExpr(
        *[forms.get(type(f.dataType), "{0}").format(f"`{f.name}`") + f" AS `{f.name}`" for f in df.schema.fields]
    )


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under a name, with equal SQL if there is any."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: tidy(build(prepare(spark), folder.rstrip("/")))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def input_files(spark: SparkSession, folder: str, table: str) -> tuple:
    """Names, sizes and times of a table's files: what a stored result was made from."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path)))


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object], table: str = "events"):
    """Something written or fitted from a table and used by several queries.

    It is made anew when the files of the table have changed; only the last one of a folder is kept.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    files = input_files(spark, folder, table)
    if _STORED.get(key, (None,))[0] != files:
        _STORED[key] = (files, build())
    return _STORED[key][1]


def forget() -> None:
    """Let go of everything stored, so that the next query makes it anew."""
    _STORED.clear()
