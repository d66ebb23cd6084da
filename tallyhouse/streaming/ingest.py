"""Incremental ingestion: each file is read once, later files on later runs.

The stream tracks file *names* (``binaryFile`` with the content pruned); each
micro-batch reads its files by name. A file with a new header therefore needs
no restart and no new query, and a retried batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.entities import Entity
from ..sources.landing import read_files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_BATCH = 10_000


def new_files(spark: SparkSession, entity: Entity, root: str, per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", entity.glob)
        .option("maxFilesPerTrigger", per_batch)
        .load(root)
        .select("path", "modificationTime", "length")
    )


def ingest(spark: SparkSession, entity: Entity, root: str, table: str, checkpoint: str, per_batch: int = FILES_PER_BATCH):
    """One triggered run; returns the finished query."""

    def load(files: DataFrame, batch_id: int) -> None:
        # at most FILES_PER_BATCH names
        paths = [r.path for r in files.select("path").collect()]
        if paths:
            read_files(files.sparkSession, entity, paths).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    query = (
        new_files(spark, entity, root, per_batch)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def raw_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.option("basePath", table).parquet(table)


def load_metrics(raw: DataFrame) -> DataFrame:
    """Per load batch: rows, source systems, rescued rows, newest and oldest file."""
    return raw.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.regexp_extract("_source_file_name", r"^([^.-]+)", 1)).alias("systems"),
        F.count("_rescued_data").alias("rescued_rows"),
        F.max(F.col("_ingested_at").cast("double") - F.col("_source_modified_time").cast("double")).alias("max_lag_sec"),
    )
