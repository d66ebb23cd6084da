"""Deduplication by aggregation.

A window over a hot key sorts all its rows in one task. ``min`` over a struct
combines on the map side first, so a key that holds a third of the rows sends
one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order_by: list[Column | str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order_by``, ties broken by the whole row."""
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c) if isinstance(c, str) else c for c in (order_by or [])]
    ranked = [c.alias(f"_o{i}") for i, c in enumerate(lead)] + [F.col(c) for c in rest]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_best.`{k}`").alias(k) for k in df.columns])


def best_record(df: DataFrame, key: str, score: Column, tie_break: list[str]) -> DataFrame:
    """Most complete record per key; equal scores fall back to ``tie_break`` order."""
    return keep_first(df, [key], [-score, *tie_break])


def group_sizes(df: DataFrame, key: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows per key, the first level of a histogram of group sizes."""
    return df.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("copies"), *[c.alias(n) for n, c in (extra or {}).items()]
    )


def repeated(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    counted = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.filter("row_count > 1")
