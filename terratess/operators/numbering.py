"""Places in a total order without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratess.staging import release, stage


def numbered(rows: DataFrame, order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """``rows`` with their place in the order, from ``first`` on, as the long column ``name``; a staged table.

    Rows that are equal in the order stand in any order.
    """
    return running(rows, order, F.lit(1), name, first)


def running(rows: DataFrame, order: Sequence[Column], size: Column, name: str, first: int = 0) -> DataFrame:
    """``rows`` with ``first`` plus the sum of ``size`` over the rows before as the long column ``name``; a staged table.

    Rows are dealt to ranges of the order and summed in each; a window over all
    ranges holds one row a range.
    """
    part, own, each = f"_{name}_part", f"_{name}_own", f"_{name}_each"
    ranged = stage(rows.repartitionByRange(*order).withColumns({part: F.spark_partition_id(), each: size.cast("long")}), "ranged")
    ranges = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.sum(each).alias(own)).withColumn(own, F.coalesce(F.sum(own).over(ranges), F.lit(0)))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn(name, F.coalesce(F.sum(each).over(inside), F.lit(0))).join(F.broadcast(starts), part)  # a row a range
    out = stage(found.withColumn(name, (F.col(name) + F.col(own) + first).cast("long")).drop(part, own, each), "numbered")
    release(ranged)
    return out
