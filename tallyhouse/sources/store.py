"""Where intermediate and result tables live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for this run, below the shared folder the cluster names.

    A cluster has to name one (``spark.checkpoint.dir``), because executors do
    not see each other's disks; only a local session, as in tests, uses a
    temporary folder of the machine.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tallyhouse-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a generated method up to which the JVM compiles it.
COMPILED = "8000"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within, a stage whose generated method the JVM would only interpret runs as smaller methods, which it compiles. Wide
    rows of many expressions, as those of raw and clean tables, grow beyond that limit."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, COMPILED)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_files(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
    """Write Parquet and read it back: the materialised table."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with compiled(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> DataFrame:
    """Report table (``overwrite``) or history table (``append``)."""
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a view; it is evaluated when read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many partitions as there are cores.

    A small table in one file would otherwise be transformed by one core. A
    table with enough splits, as any large one has, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
