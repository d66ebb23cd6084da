"""Streaming forms of the clean layer and the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import cleanse, standardise
from ..plans.cleanse import RULES


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream with the schema of its batch read."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stateless or deduplicated stream to a Parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def split_stream(raw: DataFrame, entity: str, clean_dir: str, quarantine_dir: str, checkpoint: str):
    """One read of the raw stream feeds both outputs; a retried batch overwrites its own folders."""
    return _split(raw, entity, clean_dir, quarantine_dir, checkpoint, standardise.drop_lineage)


def clean_stream(raw: DataFrame, entity: str, clean_dir: str, quarantine_dir: str, checkpoint: str):
    """The clean and quarantine tables of an entity, batch by batch; read the clean one with :func:`clean_table`.

    The stream keeps no state. Each batch stores one winner for each of its keys, and the winner of all batches is the
    smallest of theirs, whatever order they came in. So neither memory nor a batch's work grows with the history; what
    grows is the number of winners, which :func:`compact` merges.
    """
    return _split(raw, entity, clean_dir, quarantine_dir, checkpoint, lambda good: cleanse.finish(good, entity))


def _split(raw: DataFrame, entity: str, clean_dir: str, quarantine_dir: str, checkpoint: str, end: Callable[[DataFrame], DataFrame]):
    def route(batch: DataFrame, batch_id: int) -> None:
        rows = cleanse.tagged(batch, entity).persist()
        good = end(rows.filter("not is_quarantined").drop("is_quarantined", "issue_type"))
        good.write.mode("overwrite").parquet(f"{clean_dir}/batch_id={batch_id}")
        bad = rows.filter("is_quarantined").drop("is_quarantined")
        bad.write.mode("overwrite").parquet(f"{quarantine_dir}/batch_id={batch_id}")
        rows.unpersist()

    return run_batches(raw, route, checkpoint)


def clean_table(spark: SparkSession, clean_dir: str, entity: str) -> DataFrame:
    """Current clean rows of a table that :func:`clean_stream` writes."""
    stored = spark.read.option("basePath", clean_dir).parquet(clean_dir).drop("batch_id")
    return cleanse.one_per_key(stored, entity)


def first_rows_stream(raw: DataFrame, entity: str, key: str) -> DataFrame:
    """Valid rows, the first seen per key (state: one entry per key)."""
    return RULES[entity].clean(standardise.STANDARDISE[entity](raw)).dropDuplicates([key])


def best_record_stream(raw: DataFrame, table: str, checkpoint: str):
    """Most complete customer per id over all batches.

    The best of a union is the best of the parts' bests, so each batch stores
    only its own winners and :func:`best_records` merges them on read; no batch
    rewrites what earlier ones wrote.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = RULES["customers"].clean(standardise.customers(batch))
        cleanse.finish(rows, "customers").write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return run_batches(raw, keep, checkpoint)


def best_records(spark: SparkSession, table: str) -> DataFrame:
    """Current customers of a table that :func:`best_record_stream` writes."""
    return clean_table(spark, table, "customers")


def compact(spark: SparkSession, table: str, target: str, entity: str = "customers") -> DataFrame:
    """Write the merged records as one table, to be read in place of many small batches."""
    clean_table(spark, table, entity).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
