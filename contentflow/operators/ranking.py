"""Positions of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.schemas import write_through


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the place of every row in its group, from 1, by a complete order.

    The rows are dealt into ranges of group and order, so a group that holds a
    third of them lies in many tasks; each counts its own part and is shifted
    by the parts before it. The ranges are written, so that they are the same
    for both steps.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = write_through(dealt, "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return inside.join(shift, [*keys, "_range"]).withColumn(name, (F.col(name) + F.col("_shift")).cast("bigint")).drop("_range", "_shift")
