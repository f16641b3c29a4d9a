"""Row numbers within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.common import partitions, stored


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add the rank from 0 of each row within its group in the given order (ascending, nulls first).

    Rows are range-partitioned by group and order and numbered within their partition; each group
    then gets the number of its rows in the partitions before. That table has a row per partition
    and group of it, so no more rows than partitions and groups together.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    starts = placed.groupBy(part, F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = (F.shiftright("_at", 33) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    numbered = placed.join(starts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    return numbered.drop("_at", "_part", "_group", "_n", "_first", "_before")
