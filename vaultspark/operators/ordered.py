"""Positions and neighbours within groups, without putting a hot group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.session import stage_table


def total_before(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the same group that come earlier by order.

    Rows are range-partitioned by group and order, summed within each range and group, and offset by the sums of the ranges
    before; a hot group spans many ranges. Ties of order are taken in any order. Values mustn't be null.
    """
    ranged = stage_table(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    offsets = sums.withColumn("_before", earlier).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), "_before")
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_k", F.sum(value).over(within) - F.col(value))
    on = F.col("_range") == F.col("_r")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return summed.join(offsets, on).withColumn("before", F.col("_before") + F.col("_k")).select(*rows.columns, "before")


def grouped_position(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with `position`, counting from 1 within group by order; ties of order are numbered in any order."""
    placed = total_before(rows.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one")
    return placed.withColumn("position", F.col("before") + 1).select(*rows.columns, "position")


def neighbours(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, previous, following: the value of order before and after each, by an equi-join of positions."""
    placed = stage_table(grouped_position(rows.select(group, order), [group], [order]))
    other = placed.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col("position").alias("_p"))
    before = placed.join(other, (F.col(group) == F.col("_g")) & (F.col("position") == F.col("_p") + 1), "left").select(group, order, "position", F.col("_o").alias("previous"))
    return before.join(other, (F.col(group) == F.col("_g")) & (F.col("position") == F.col("_p") - 1), "left").select(group, order, "previous", F.col("_o").alias("following"))
