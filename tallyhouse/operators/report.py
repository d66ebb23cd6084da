"""Long-format reports from single-pass aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def counts_by(df: DataFrame, *by: str | Column, name: str = "row_count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def with_share(df: DataFrame, count: str, by: list[str] | None = None, name: str = "pct") -> DataFrame:
    """Adds each count's percentage of the total (per ``by`` group if given).

    The totals come from an aggregate of the already grouped rows.
    """
    total = F.sum(count).alias("_total")
    if by:
        out = df.join(df.groupBy(*by).agg(total), by)
    else:
        out = df.join(F.broadcast(df.agg(total)), F.lit(True))
    return out.withColumn(name, F.floor(F.col(count) * 100.0 / F.col("_total") * 100 + 0.5) / 100.0).drop("_total")


def metrics(df: DataFrame, entity: str, values: dict[str, Column]) -> DataFrame:
    """(entity, metric, value double): all metrics of a table in one aggregate."""
    row = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return row.unpivot([], list(values), "metric", "value").select(F.lit(entity).alias("entity"), "metric", "value")


def checks(df: DataFrame, group: str, tests: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check_group, label, fails, total, fail_pct, status, consequence), one pass per table."""
    names = list(tests)
    row = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(cond).alias(f"f{i}") for i, (cond, _) in enumerate(tests.values())]
    )
    long = row.unpivot("total", [f"f{i}" for i in range(len(names))], "_id", "fails")
    label, consequence = F.col("_id"), F.col("_id")
    for i, n in enumerate(names):
        label = F.when(F.col("_id") == f"f{i}", n).otherwise(label)
        consequence = F.when(F.col("_id") == f"f{i}", tests[n][1]).otherwise(consequence)
    return finish_checks(long.select(F.lit(group).alias("check_group"), label.alias("label"), "fails", "total", consequence.alias("consequence")))


def finish_checks(df: DataFrame) -> DataFrame:
    pct = F.floor(F.try_divide(F.col("fails") * 100.0, F.col("total")) * 100 + 0.5) / 100.0
    return df.select(
        "check_group", "label", "fails", "total",
        F.coalesce(pct, F.lit(0.0)).alias("fail_pct"),
        F.when(F.col("fails") == 0, "PASS").otherwise("FIX").alias("status"),
        "consequence",
    )
