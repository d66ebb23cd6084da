"""By-name ingestion of files whose columns differ from system to system.

Spark's CSV reader maps columns by position over the whole file list, so files
are grouped by their header and each group is read with its own schema, all as
text. Declared columns are then picked by exact name; anything else, and every
value that does not fit its forced type, goes to a JSON rescue column. No row
and no value is lost.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..operators.report import stack
from .entities import Entity

# schemes that Arrow opens by itself, and its names for others
ARROW_SCHEMES = {"", "file", "s3", "gs", "hdfs", "abfs", "abfss"}
ARROW_NAMES = {"s3a": "s3", "s3n": "s3"}


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def first_lines(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, header record) of each file, read by the executors up to the record's end, however long it is.

    Line breaks within quotes belong to the record. Only stores that Arrow opens are read; for others it would take a
    scan of all rows, so they raise an error.
    """
    names = dict(ARROW_NAMES)
    unknown = {names.get(x, x) for x in (urlparse(p).scheme for p in paths)} - ARROW_SCHEMES
    if unknown:
        raise ValueError(f"no way to read file headers from {', '.join(sorted(unknown))}:// paths")

    # nested, so that tasks need no installed copy of this package
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def record(stream) -> str:
            data, quotes, at = b"", 0, 0
            while True:
                piece = stream.read(1 << 16)
                data += piece
                # a break ends the record if the quotes before it are paired
                while (end := data.find(b"\n", at)) >= 0:
                    quotes += data.count(b'"', at, end)
                    if quotes % 2 == 0:
                        return data[:end].decode("utf-8-sig", "replace").rstrip("\r")
                    at = end + 1
                if not piece:
                    return data.decode("utf-8-sig", "replace").rstrip("\r")
                quotes += data.count(b'"', at)
                at = len(data)

        for pdf in batches:
            lines = []
            for path in pdf["path"]:
                if path.startswith(("file:", "/")):
                    system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    scheme, rest = path.split("://", 1)
                    system, inner = fs.FileSystem.from_uri(f"{names.get(scheme, scheme)}://{rest}")
                with system.open_input_stream(inner) as stream:
                    lines.append(record(stream))
            yield pd.DataFrame({"path": pdf["path"], "header": lines})

    tasks = max(1, min(len(paths) // 16, 1000))
    frame = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return [(r.path, r.header) for r in frame.mapInPandas(heads, "path string, header string").collect()]


def region_of(path: Column, name: Column) -> Column:
    """Region folder in the path, else the region known for a root file, else ``unknown``."""
    folder = F.regexp_extract(F.replace(path, F.lit("%20"), F.lit(" ")), r"(Region \d+)", 1)
    stem = F.regexp_extract(name, r"^([^.-]+)", 1)
    known = F.lit("unknown")
    for root_stem, region in vocab.ROOT_FILE_REGIONS.items():
        known = F.when(stem == root_stem, region).otherwise(known)
    return F.when(folder != "", folder).otherwise(known)


def with_lineage(df: DataFrame, columns: list[Column | str]) -> DataFrame:
    """``columns`` plus file path, name, time, load time and region of each row."""
    m = "_metadata"
    traced = df.select(
        *columns,
        F.col(f"{m}.file_path").alias("_source_file_path"),
        F.col(f"{m}.file_name").alias("_source_file_name"),
        F.col(f"{m}.file_modification_time").alias("_source_modified_time"),
        F.current_timestamp().alias("_ingested_at"),
    )
    return traced.withColumn("source_region", region_of(F.col("_source_file_path"), F.col("_source_file_name")))


def by_name(entity: Entity, names: list[str]) -> list[Column]:
    """Declared columns out of text columns ``c0..`` called ``names``, and the rescue column."""
    at = {}
    extra: list[tuple[str, Column]] = []
    taken = {"_corrupt_record"}
    for i, name in enumerate(names):
        if name in entity.columns and name not in at:
            at[name] = F.col(f"c{i}")
        else:
            # a name that is used already keeps its value under its place in the file
            key = name if name not in at and name not in taken else f"{name}#{i}"
            taken.add(key)
            extra.append((key, F.col(f"c{i}")))
    picked = []
    for name in entity.columns:
        text = at.get(name, F.lit(None).cast("string"))
        kind = entity.hints.get(name, "string")
        picked.append((text if kind == "string" else text.try_cast(kind)).alias(name))
        if kind != "string" and name in at:
            extra.append((name, F.when(text.try_cast(kind).isNull(), text)))
    extra.append(("_corrupt_record", F.col("_corrupt_record")))
    pairs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in extra]),
        lambda p: p["value"].isNotNull(),
    )
    rescued = F.when(F.size(pairs) > 0, F.to_json(F.map_from_entries(pairs)))
    return [*picked, rescued.alias("_rescued_data")]


def read_csv_files(spark: SparkSession, entity: Entity, paths: list[str]) -> DataFrame:
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, line in first_lines(spark, paths):
        groups[tuple(next(csv.reader(io.StringIO(line, newline="")), ()))].append(path)
    parts = []
    for header, files in sorted(groups.items()):
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        schema = schema.add("_corrupt_record", T.StringType())
        rows = (
            spark.read.schema(schema)
            .option("header", "true")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", str(entity.multiline).lower())
            .csv(files)
        )
        parts.append(with_lineage(rows, by_name(entity, list(header))))
    return stack(parts)


def nested_text(value: Column) -> Column:
    """A variant as text: plain values as they are, members of objects and arrays as texts within JSON."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    for start, target in [("ARRAY", "array<string>"), ("ARRAY<OBJECT", "array<map<string,string>>"), ("OBJECT", "map<string,string>")]:
        text = F.when(kind.startswith(start), F.to_json(F.try_variant_get(value, "$", target))).otherwise(text)
    return text


def by_key(entity: Entity, fields: Column) -> list[Column]:
    """Declared columns out of a map of texts, and the rescue column: other keys and values of a wrong type."""
    picked = []
    for name in entity.columns:
        kind = entity.hints.get(name, "string")
        text = F.try_element_at(fields, F.lit(name))
        picked.append((text if kind == "string" else text.try_cast(kind)).alias(name))

    def left(k: Column, v: Column) -> Column:
        odd = ~k.isin(*entity.columns)
        for name, kind in entity.hints.items():
            if kind != "string":
                odd = odd | ((k == name) & v.try_cast(kind).isNull())
        return v.isNotNull() & odd

    rest = F.map_filter(fields, left)
    return [*picked, F.when(F.size(rest) > 0, F.to_json(rest)).alias("_rescued_data")]


def read_json_files(spark: SparkSession, entity: Entity, paths: list[str]) -> DataFrame:
    """JSON documents, each parsed once into a variant: no inference, any number of keys, names told apart by case.

    A document is an object or an array of objects. A document that no variant can hold (a key twice in one object, or too
    large) is read as maps of texts, of equal keys the last. What is neither, or no object, is kept as ``_corrupt_record``.
    """
    corrupt = "_corrupt_record"
    rows = (
        spark.read.schema(f"v variant, {corrupt} string")
        .options(singleVariantColumn="v", multiLine=str(entity.multiline).lower(), columnNameOfCorruptRecord=corrupt)
        .json(paths)
    )
    v, text = F.col("v"), F.col(corrupt)
    one = F.array(v)
    several = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(one)
    maps = F.coalesce(F.from_json(text, "array<map<string,string>>"), F.array(F.from_json(text, "map<string,string>")))
    records = F.when(
        v.isNotNull(), F.transform(several, lambda r: F.struct(r.alias("r"), F.lit(None).cast("map<string,string>").alias("m")))
    ).otherwise(F.transform(maps, lambda m: F.struct(F.lit(None).cast("variant").alias("r"), m.alias("m"))))
    flat = rows.select(F.col("_metadata"), text, F.explode(records).alias("e"))
    members = F.try_variant_get("e.r", "$", "map<string,variant>")
    fields = F.coalesce(
        F.transform_values(members, lambda _, value: nested_text(value)),
        # of equal keys the last stays
        F.aggregate(
            F.map_entries("e.m"),
            F.create_map().cast("map<string,string>"),
            lambda out, pair: F.map_concat(F.map_filter(out, lambda k, _: k != pair["key"]), F.create_map(pair["key"], pair["value"])),
        ),
        F.create_map(F.lit(corrupt), F.coalesce(F.col("e.r").cast("string"), text)),
    )
    return with_lineage(flat.select("_metadata", fields.alias("fields")), by_key(entity, F.col("fields")))


def read_files(spark: SparkSession, entity: Entity, paths: list[str]) -> DataFrame:
    """Raw table of the given files of an entity."""
    return read_csv_files(spark, entity, paths) if entity.format == "csv" else read_json_files(spark, entity, paths)


def read_entity(spark: SparkSession, entity: Entity, root: str) -> DataFrame:
    """Raw table of all files of an entity below ``root``."""
    return read_files(spark, entity, [r.path for r in list_files(spark, root, entity.glob).select("path").collect()])


TYPE_LADDER = ["bigint", "double", "timestamp"]


def infer_types(df: DataFrame, columns: list[str], hints: dict[str, str] | None = None) -> DataFrame:
    """(column_name, inferred_type): the narrowest type all values fit, from one pass; hints win."""
    hints = hints or {}
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs += [F.count(col.try_cast(t)).alias(f"{t}{i}") for t in TYPE_LADDER if c not in hints]
    row = df.agg(*aggs)
    cells = []
    for i, c in enumerate(columns):
        kind = F.lit(hints.get(c, "string"))
        if c not in hints:
            for t in reversed(TYPE_LADDER):
                kind = F.when((F.col(f"n{i}") > 0) & (F.col(f"{t}{i}") == F.col(f"n{i}")), t).otherwise(kind)
        cells.append(F.struct(F.lit(c).alias("column_name"), kind.alias("inferred_type")))
    return row.select(F.inline(F.array(*cells)))
