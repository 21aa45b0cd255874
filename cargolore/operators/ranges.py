"""Running totals and row numbers over a whole table without one task for it all.

Rows are cut into ranges of the order; totals of ranges are added up (a row a
range), and only inside a range are rows put in order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of all rows up to each, in an order that should leave
    no ties.  The ranges are persisted on disk, as they are read twice."""
    named = rows.withColumns({f"__{n}": c for n, c in sums.items()})
    ranged = named.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before = Window.orderBy("__in_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("__range").alias("__in_range")).agg(*(F.sum(f"__{n}").alias(n) for n in sums))
    totals = totals.select("__in_range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in sums))  # a row a range
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(F.broadcast(totals), F.col("__range") == F.col("__in_range"))
    summed = summed.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums})
    return summed.drop("__range", "__in_range", *(f"__{n}" for n in sums), *(f"__before_{n}" for n in sums))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in an order that should leave no ties."""
    return running(rows, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))
