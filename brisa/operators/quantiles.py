"""Exact quantiles, also of data that no single task could hold.

Values are counted, and the distinct ones range-partitioned by group and value: one shuffle, after which
every partition holds a stretch of the order. The numbers of rows per partition and group tell in which
partitions the wanted ranks lie, and only there values are looked up. The work and the way are the same for
every size and every distribution; a value that fills half the rows is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.functions.numeric import without_nan
from brisa.session import new_dir


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(groups, probability, quantile) with linear interpolation between neighbours.

    Nulls, NaN and rows with a null group are left out; infinite values stand at the ends of the order, and
    between a finite and an infinite neighbour the quantile is infinite.
    """
    spark = df.sparkSession
    data = df.select(*groups, without_nan(F.col(value).cast("double")).alias("_v")).dropna()
    counted = data.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*groups, "_v"]
    path = new_dir(spark, "quantiles")
    # Written once, so both readings below see the same partitions.
    ordered = counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(counted.withColumn("_part", F.lit(0)).schema).parquet(path)
    # A row per partition and group of it.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = (
        rows.groupBy(*groups, "_part")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_size").over(whole))
    )
    marks = ", ".join(
        f"named_struct('probability', {float(p)!r}D, '_place', (_all - 1) * {float(p)!r}D)" for p in probabilities
    )
    wanted = (
        starts.selectExpr(*groups, "_part", "_start", "_size", f"inline(array({marks}))")
        .withColumn("_rank", F.floor("_place"))
        .where("_start <= _rank + 1 AND _rank < _start + _size")
    )
    # Within a partition the values of a group are a bounded stretch.
    so_far = Window.partitionBy(*groups, "_part").orderBy("_v")
    placed = rows.join(wanted.select(*groups, "_part").distinct(), [*groups, "_part"], "left_semi").withColumn(
        "_until", F.sum("_n").over(so_far)
    )
    at = "_first <= _rank AND _rank < _first + _n"
    following = "_first <= _rank + 1 AND _rank + 1 < _first + _n"
    found = (
        placed.join(wanted, [*groups, "_part"])
        .withColumn("_first", F.expr("_start + _until - _n"))
        .where(f"({at}) OR ({following})")
        .groupBy(*groups, "probability")
        .agg(
            F.expr(f"max(CASE WHEN {at} THEN _v END)").alias("_at"),
            F.expr(f"max(CASE WHEN {following} THEN _v END)").alias("_next"),
            F.max(F.expr("_place - _rank")).alias("_share"),
        )
    )
    even = "_share = 0 OR _next IS NULL OR _at = _next"
    return found.selectExpr(*groups, "probability", f"IF({even}, _at, _at + (_next - _at) * _share) AS quantile")


def quartiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, q25, q50, q75)."""
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    return (
        exact_quantiles(df, groups, value, list(names))
        .groupBy(*groups)
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    )
