"""Sums along an order over all rows, without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoweave.session import cut


def running_sum(df: DataFrame, order: Sequence[Column], value: str, name: str = "total") -> DataFrame:
    """`df` with the sum of `value` over all rows up to each row in a total order.

    One distributed sort; each partition adds up its own rows, and the sums of the partitions before (one number for
    each partition, which come to the driver) are put on top.
    """
    at = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    before, so_far = [], 0
    for part, total in sorted(at.groupBy("_part").agg(F.sum(value)).collect()):
        before.append((part, so_far))
        so_far += total or 0
    kind = "double" if isinstance(so_far, float) else "long"
    starts = df.sparkSession.createDataFrame(before, f"_part long, _before {kind}")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at"))
    return at.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_at", "_part", "_in", "_before")
