"""Dense 1..n numbers in sort order without one global window task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import work_dir, write_files

#: Bits below the partition in Spark's increasing ids.
ROW_BITS = 33


def number_rows(df: DataFrame, order_by: list[Column | str], name: str, ranges: int | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` (ascending), computed range by range.

    Rows are dealt over ranges of the sort order, sorted within them, and written once, each with its partition and its
    place there. Partitions are counted, and each place is shifted by the rows of the partitions before. The counts are
    as few as the partitions. ``order_by`` must be unique for the numbers to be stable.
    """
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(order_by)]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *keys)
    dealt = keyed.repartitionByRange(ranges, *names) if ranges else keyed.repartitionByRange(*names)
    placed = dealt.sortWithinPartitions(*names).withColumn("_at", F.monotonically_increasing_id()).drop(*names)
    rows = write_files(placed, work_dir(df.sparkSession, "numbered"))
    part = F.shiftright("_at", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_before") + 1
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .select(*df.columns, number.cast("bigint").alias(name))
    )
