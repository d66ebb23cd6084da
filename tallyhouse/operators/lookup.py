"""Joins of facts with reference tables.

Sides that grow with the data carry no broadcast hint: Spark's own size check
(``autoBroadcastJoinThreshold``, AQE) picks the strategy, and AQE splits skewed
partitions of the larger side. Only a side that was counted gets a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SMALL_ROWS = 10_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``max_rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def look_up(facts: DataFrame, dim: DataFrame, on: str, take: list[str], missing: dict[str, object] | None = None) -> DataFrame:
    """Left join that adds ``take`` columns of ``dim``; ``missing`` gives values where nothing matched."""
    out = facts.join(dim, on, "left").select(*facts.columns, *take)
    if missing:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in missing.items()})
    return out


#: Parts that rows without a key are dealt to.
SPREAD = 4096


def look_up_sparse(facts: DataFrame, dim: DataFrame, on: str, take: list[str], spread_by: list[str]) -> DataFrame:
    """``look_up`` for facts whose key is mostly NULL.

    A join deals rows by their key, so all rows without one would meet in one task, though they match nothing. Here they
    get a text that no key has: a NUL and a hash of ``spread_by``. (A constant second part of the key would not do: Spark
    takes equality with a constant out of the keys again.)
    """
    nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("string"))
    known = dim.select(F.col(on).cast("string").alias("_key"), *take)
    keyed = facts.withColumn("_key", F.coalesce(F.col(on).cast("string"), nowhere))
    return keyed.join(known, "_key", "left").select(*facts.columns, *take)


def orphans(facts: DataFrame, fk: str | Column, parents: DataFrame, pk: str, null_is_orphan: bool = False) -> DataFrame:
    """Rows whose key is in no parent row."""
    key = F.col(fk) if isinstance(fk, str) else fk
    keyed = facts.withColumn("_fk", key)
    if not null_is_orphan:
        keyed = keyed.filter("_fk is not null")
    known = parents.select(F.col(pk).alias("_pk")).filter("_pk is not null")
    return keyed.join(known, F.col("_fk") == F.col("_pk"), "left_anti").drop("_fk")


def count_orphans(facts: DataFrame, fk: str | Column, parents: DataFrame, pk: str, null_is_orphan: bool = False) -> DataFrame:
    """Number of orphan rows.

    Rows are counted per key before the join, so a hot key crosses the shuffle
    as one row.
    """
    key = (F.col(fk) if isinstance(fk, str) else fk).alias("_fk")
    per_key = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    lost = orphans(per_key, "_fk", parents, pk, null_is_orphan)
    return lost.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphaned_count"))
