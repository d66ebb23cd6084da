"""Tables, shared folders and row keys used by the operators of this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import work_dir, write_files

#: Columns of the documents table, which filtering stages give back.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the cluster's shared folder and read back; lost executors do not lose it."""
    path = work_dir(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return write_files(df, path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that ``stored`` makes meanwhile, for ``remove`` once nothing reads them any more."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of this session that hold intermediate tables only."""
    for path in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    folders.clear()


def python_tasks(spark: SparkSession, megabytes: int = 8) -> None:
    """Send this package to the executors once per session, and bound Arrow batches by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    context = spark.sparkContext
    if getattr(context, "_tallyhouse_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    sent = Path(tempfile.mkdtemp(prefix="tallyhouse-")) / "tallyhouse_code.zip"
    with zipfile.ZipFile(sent, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(sent))
    context._tallyhouse_sent = True


def with_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only, a null text as the empty one. Other columns never reach an operator."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key() -> list[Column]:
    """Two longs that tell rows apart also where ids repeat or are null; rows equal in both are copies."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("k1"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id as text is divisible by 5. A null id is hashed as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled training rows of each label value.

    Rows are drawn in order of a hash of their id. Held-out rows, and ids with missing or contradicting labels, are not
    drawn. Ids drawn are few by that bound, so they are broadcast, and no text is shuffled. Of documents with the same
    id any number may come.
    """
    clear = (
        labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(label))
    drawn = None
    for value in (0, 1):
        some = clear.filter(F.col("label") == value).orderBy(order, "doc_id").limit(rows)
        drawn = some if drawn is None else drawn.unionByName(some)
    return with_text(docs).join(F.broadcast(drawn), "doc_id")


#: Bits of a sieve for each value in it, and the most bits of a sieve: 32 MB.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 28


def sieve(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of bounded size, to drop rows early whose hash is certainly not among ``values``.

    It is or-ed together in the tasks, 64 bits a row, so at most SIEVE_MOST / 64 rows reach the driver. Rows that pass
    it still have to meet their match in a join; where a table has outgrown the bitmap, more rows pass."""
    n = values.count()
    bits = 1 << 16
    while bits < min(SIEVE_BITS * n, SIEVE_MOST):
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    found = (
        values.select((place / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, int(({column} & {bits - 1}) % 64))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()  # rows would be Python objects of many times their size
    )
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    return bitmap[values.view(np.int64) & (len(bitmap) - 1)]
