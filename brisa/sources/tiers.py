"""Small tables that every micro-batch adds to and that reading merges: newest rows, sums.

Micro-batch n writes run n of tier 0. Whenever ``FAN`` runs of a tier are complete, they are merged into one run of the next. A reader
takes the fewest runs that hold every micro-batch once, so it opens at most ``FAN`` per tier, and a row is rewritten once per tier,
however long the stream runs. Writing a run again, after a loss, gives the same run. Nothing is deleted, so readers are never disturbed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from brisa.sources.store import children

FAN = 16

Merge = Callable[[DataFrame], DataFrame]


def _run(path: str, tier: int, run: int) -> str:
    return f"{path}/tier={tier}/run={run}"


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    found = (re.fullmatch(rf"{name}=(\d+)", child) for child in children(spark, path))
    return sorted(int(match.group(1)) for match in found if match)


def _complete(spark: SparkSession, path: str, tier: int, run: int) -> bool:
    return "_SUCCESS" in children(spark, _run(path, tier, run))


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(tier, run) of the complete runs that together hold every micro-batch once."""
    taken: dict[int, set[int]] = {}
    for tier in reversed(_numbers(spark, path, "tier")):
        inside = lambda run: any(run // FAN ** (above - tier) in held for above, held in taken.items())  # noqa: B023, E731
        open_ = [run for run in _numbers(spark, f"{path}/tier={tier}", "run") if not inside(run)]
        taken[tier] = {run for run in open_ if _complete(spark, path, tier, run)}
    return sorted((tier, run) for tier, held in taken.items() for run in held)


def add_run(df: DataFrame, path: str, number: int, merge: Merge) -> None:
    """Write the rows of a micro-batch, merged, and merge full tiers."""
    spark = df.sparkSession
    merge(df).write.mode("overwrite").parquet(_run(path, 0, number))
    tier, run = 0, number
    while run % FAN == FAN - 1:
        parts = [_run(path, tier, r) for r in range(run - FAN + 1, run + 1) if _complete(spark, path, tier, r)]
        tier, run = tier + 1, run // FAN
        merge(spark.read.schema(df.schema).parquet(*parts)).write.mode("overwrite").parquet(_run(path, tier, run))


def read_runs(spark: SparkSession, path: str, schema: StructType, merge: Merge) -> DataFrame:
    """All rows so far, merged; none where nothing is stored yet."""
    parts = [_run(path, *run) for run in runs(spark, path)]
    stored = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return merge(stored)
