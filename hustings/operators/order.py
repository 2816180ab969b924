"""Places in a global order: range partitions, their totals, and places inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.sources.shared import settled


def ranged(df: DataFrame, *order) -> DataFrame:
    """Rows dealt to as many ranges of ``order`` as the session has partitions, ``__part`` the number of each.

    ``order`` has to end in a column that tells all rows apart, so that equal values,
    however many, are spread over ranges too.  The checkpoint fixes the ranges.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settled(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def _before(rows: DataFrame) -> DataFrame:
    """(__part, n, __before): rows of a range and of all ranges before it.  A row a range, whose number the session sets."""
    totals = rows.groupBy("__part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def placed(df: DataFrame, *order, place: str = "place") -> DataFrame:
    """Each row's place (from 1) in the order of all rows; no task sees more than a range."""
    rows = ranged(df, *order)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    joined = rows.join(F.broadcast(_before(rows).select("__part", "__before")), "__part")
    return joined.withColumn(place, F.col("__before") + inside).drop("__part", "__before")


def page_of(df: DataFrame, page: int, size: int, *order, place: str = "place") -> DataFrame:
    """The rows of one page (from 1) of all rows in order, however far behind it lies.

    Only the ranges that the page touches are put in order.
    """
    first, last = (page - 1) * size + 1, page * size
    rows = ranged(df, *order)
    touched = _before(rows).where((F.col("__before") < last) & (F.col("__before") + F.col("n") >= first)).select("__part", "__before")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    own = rows.join(F.broadcast(touched), "__part").withColumn(place, F.col("__before") + inside)
    return own.where(F.col(place).between(first, last)).drop("__part", "__before")
