"""Top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order_by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps ``k`` per group in every task before it shuffles."""
    window = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def flagged_or_top(df: DataFrame, flag: str, order_by: list[Column], k: int = 3) -> DataFrame:
    """All flagged rows; the top ``k`` of the rest only if none is flagged."""
    flagged = df.filter(F.col(flag))
    top = df.filter(~F.col(flag)).orderBy(*order_by).limit(k)
    any_flag = flagged.agg(F.count(F.lit(1)).alias("_flagged"))
    # both sides are bounded: k rows and one row
    fallback = top.join(F.broadcast(any_flag), F.col("_flagged") == 0).drop("_flagged")
    return flagged.unionByName(fallback)


def few_values(df: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """The ``k`` smallest distinct values per group, as one sorted comma list."""
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.lit(1).alias("_one"))
    kept = top_per_group(distinct, by, [F.col(value)], k, "_rank")
    return kept.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("samples"))
