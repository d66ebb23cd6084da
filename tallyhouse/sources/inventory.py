"""Inventory of the source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from .entities import ENTITIES
from .landing import list_files, region_of

NAME = r"([^/]+)$"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, system, entity, source_region, length); a system's parts share its stem."""
    files = list_files(spark, root)
    name = F.regexp_extract("path", NAME, 1)
    stem = F.regexp_extract(name, r"^([^.-]+)", 1)
    entity = F.lit("other")
    for e in ENTITIES:
        entity = F.when(stem.rlike(rf"^{e}(_\d+)?$"), e).otherwise(entity)
    return files.select(
        "path", name.alias("file_name"), stem.alias("system"), entity.alias("entity"),
        region_of(F.col("path"), name).alias("source_region"), "length",
    )


def entity_status(files: DataFrame) -> DataFrame:
    """(entity, systems, status): OK or MISSING for each expected entity."""
    spark = files.sparkSession
    expected = spark.createDataFrame([(e,) for e in ENTITIES], "entity string")
    found = files.groupBy("entity").agg(F.count_distinct("system").alias("systems"))
    systems = F.coalesce("systems", F.lit(0).cast("bigint"))
    return expected.join(found, "entity", "left").select(
        "entity", systems.alias("systems"), F.when(systems > 0, "OK").otherwise("MISSING").alias("status")
    )


def completeness(files: DataFrame, expected: int = vocab.EXPECTED_FILES) -> DataFrame:
    """(found, expected, complete) over the source systems of all entities."""
    n = F.count_distinct(F.when(F.col("entity") != "other", F.col("system")))
    return files.agg(n.alias("found")).select("found", F.lit(expected).alias("expected"), (F.col("found") == expected).alias("complete"))
