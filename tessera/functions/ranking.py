"""The first rows of each key, where every task has some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of tasks whose rows meet first.
GROUPS = 64


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, groups: int = GROUPS) -> DataFrame:
    """The first k rows of each key, with their place `rank` from 1. A task's rows of a key meet those of its group of tasks, and then the groups' meet, so no task gets rows of every task."""
    near = Window.partitionBy(*keys, "_group").orderBy(*order)
    rows = rows.withColumn("_group", F.spark_partition_id() % groups).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("_group", "rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
