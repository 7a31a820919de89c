"""Dense numbering inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_start(
    df: DataFrame, group: str, position: str, width: str, out: str, block: int = 10000
) -> DataFrame:
    """Sum of `width` over the earlier rows of the group, by integer `position`.

    A plain running sum would sort a whole group in one task. Here a group is cut into blocks
    of positions: blocks are summed first (pre-aggregated), the few block totals are summed up,
    and rows are only sorted inside their block.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block))
    totals = rows.groupBy(group, "_block").agg(F.sum(width).alias("_total"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        group, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(width).over(inside), F.lit(0)))
        .join(starts, [group, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("int"))
        .drop("_block", "_start", "_inside")
    )
