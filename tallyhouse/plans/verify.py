"""Checks after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import counts_by, stack

AUDIT_COLUMNS = {
    "has_file_path": "_source_file_path",
    "has_file_name": "_source_file_name",
    "has_modified_time": "_source_modified_time",
    "has_ingested_at": "_ingested_at",
}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return stack([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(e).alias("entity"), "row_count") for e, df in tables.items()])


def region_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    return stack([counts_by(df.select(F.lit(e).alias("entity"), "source_region"), "entity", "source_region") for e, df in tables.items()])


def audit_completeness(tables: dict[str, DataFrame]) -> DataFrame:
    aggs = [F.count(c).alias(n) for n, c in AUDIT_COLUMNS.items()]
    return stack(
        [df.agg(F.count(F.lit(1)).alias("total_rows"), *aggs).select(F.lit(e).alias("entity"), "*") for e, df in tables.items()]
    )


def stable_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity, rows_before, rows_after, stable): equal after a second run means nothing was read twice."""
    old = before.select("entity", F.col("row_count").alias("rows_before"))
    new = after.select("entity", F.col("row_count").alias("rows_after"))
    return old.join(new, "entity").withColumn("stable", F.col("rows_before") == F.col("rows_after"))
