"""Which rows of a batch are new to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.schemas import KEY, TIME


def new_rows_only(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """A series of the batch counts as new, as a whole, if its newest hour is past the stored one.

    This is all or nothing per series: a late hour is lost next to stored newer
    ones, and comes in again with newer ones. ``dedup_upsert`` has neither flaw.
    """
    newest_stored = stored.groupBy(KEY).agg(F.max(TIME).alias("_stored"))
    advancing = (
        batch.groupBy(KEY)
        .agg(F.max(TIME).alias("_batch"))
        .join(newest_stored, KEY, "left")
        .where(F.col("_stored").isNull() | (F.col("_batch") > F.col("_stored")))
        .select(KEY)
    )
    return batch.join(advancing, KEY, "left_semi")


def dedup(batch: DataFrame, prefer: list[str] | None = None) -> DataFrame:
    """One row per (series, hour): the greatest by ``prefer``, or by all columns in order.

    An aggregation, so copies of a key are merged map-side and a key with very
    many copies is no hot task.
    """
    rest = [c for c in batch.columns if c not in (KEY, TIME)]
    rank = F.struct(*(prefer or rest))
    return (
        batch.groupBy(KEY, TIME)
        .agg(F.max_by(F.struct(*rest), rank).alias("row"))
        .select(KEY, TIME, "row.*")
        .select(batch.columns)
    )


def not_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose (series, hour) is not stored yet."""
    return batch.join(stored.select(KEY, TIME), [KEY, TIME], "left_anti")


def dedup_upsert(batch: DataFrame, stored: DataFrame, prefer: list[str] | None = None) -> DataFrame:
    """The same, once per key."""
    return not_stored(dedup(batch, prefer), stored)
