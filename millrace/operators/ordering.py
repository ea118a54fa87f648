"""Global order without a global task: places and running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import cut


def ordered(df: DataFrame, *order) -> DataFrame:
    """df with `place`, 1 for the first row of the order: ranks within range partitions plus the sizes of those before."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).select("__part", "__before")  # a row per partition
    local = parts.withColumn("__local", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def running(df: DataFrame, order, *values: str) -> DataFrame:
    """df with each value replaced by its sum through the row, in an order without ties."""
    parts = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("__part", *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values))  # a row per partition
    local = W.partitionBy("__part").orderBy(order)
    return parts.withColumns({v: F.sum(v).over(local) for v in values}).join(F.broadcast(before), "__part").withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop("__part", *(f"__{v}" for v in values))
