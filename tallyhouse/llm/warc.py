"""WARC archives as a PySpark data source.

``df.write.format("warc")`` writes one record per row, ``spark.read.format("warc")`` reads them. A record is two
gzip members, header and payload, so any WARC tool can read the files. Each member says in its gzip extra field how
long it is; a reader inflates the headers, and steps over the payload of every record that a filter rejects or whose
payload nobody asked for. Each file ends with an empty gzip member whose extra field lists where records begin, about
every ``split_bytes``; partitions are planned from these lists, so that a large file is read by many tasks. Files
without such fields, from other writers, are read as one partition and inflated in pieces.

Only files named in a commit list are read, so what failed or repeated task attempts leave behind does no harm.

Options: ``payload`` (``true``; ``false`` never inflates a payload and returns null for it), ``split_bytes``.

Null payloads are written as empty ones. Other null fields are left out of the header and read back as null. Empty
tables give an empty archive. Header values may hold any text without line breaks.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .common import python_tasks, table, work_dir

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
#: Header lines of the columns.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
SPLIT_BYTES = 16 << 20
COMMITS = "_commits"


# ---- gzip members -----------------------------------------------------------


def member(data: bytes, level: int = 1, more: bytes = b"") -> bytes:
    """A gzip member whose extra field holds its whole length (subfield WL) and, in WI, a list of places."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra_length = 12 + (4 + len(more) if more else 0)
    total = 12 + extra_length + len(body) + 8
    extra = b"WL" + struct.pack("<HQ", 8, total)
    if more:
        extra += b"WI" + struct.pack("<H", len(more)) + more
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 4, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def extra_fields(data: bytes) -> dict[bytes, bytes]:
    """Subfields at the start of a gzip member; empty for other members."""
    if len(data) < 12 or data[:3] != b"\x1f\x8b\x08" or not data[3] & 4:
        return {}
    end, at, out = 12 + struct.unpack_from("<H", data, 10)[0], 12, {}
    while at + 4 <= min(end, len(data)):
        size = struct.unpack_from("<H", data, at + 2)[0]
        out[data[at : at + 2]] = data[at + 4 : at + 4 + size]
        at += 4 + size
    return out


def member_length(data: bytes) -> int | None:
    own = extra_fields(data).get(b"WL")
    return struct.unpack("<Q", own)[0] if own and len(own) == 8 else None


# ---- files ------------------------------------------------------------------


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds ``path``: a URI with a scheme Arrow knows, or a plain local path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def archive_files(path: str) -> list[tuple[str, int]]:
    """Files and sizes: those in the commit lists, or every .warc.gz where there are none."""
    store, root = file_system(path)
    lists = store.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    if any(x.base_name.endswith(".json") for x in lists):
        out = []
        for x in lists:
            if x.base_name.endswith(".json"):
                with store.open_input_stream(x.path) as f:
                    out += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        return sorted(out)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(".warc.gz"))


# ---- write ------------------------------------------------------------------


def header(row, length: int) -> bytes:
    lines = ["WARC/1.1"]
    for column, field in FIELDS.items():
        value = row[column]
        if value is None:
            continue
        value = f"sha1:{value}" if column == "payload_digest" else str(value)
        if "\n" in value or "\r" in value:
            raise ValueError(f"{column} holds a line break")
        lines.append(f"{field}: {value}")
    lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, split_bytes: int):
        self.path, self.overwrite, self.split_bytes = path, overwrite, split_bytes

    def write(self, rows: Iterator) -> Written:
        store, root = file_system(self.path)
        rows = iter(rows)
        row = next(rows, None)
        if row is None:
            return Written([])
        store.create_dir(root, recursive=True)
        name, at, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            while row is not None:
                # only responses carry their payload
                payload = bytes(row["payload"] or b"") if row["record_type"] != "revisit" else b""
                if at - marks[-1] >= self.split_bytes:
                    marks.append(at)
                for data in (member(header(row, len(payload)), 1), member(payload + b"\r\n\r\n", 1)):
                    out.write(data)
                    at += len(data)
                row = next(rows, None)
            every = -(-len(marks) // 8000)  # an extra field holds 64 KiB
            tail = member(b"", 1, struct.pack(f"<{len(marks[::every])}Q", *marks[::every]))
            out.write(tail + struct.pack("<I", len(tail)))
            at += len(tail) + 4
        return Written([(name, at)])

    def commit(self, messages: Sequence) -> None:
        store, root = file_system(self.path)
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        older = store.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True)) if self.overwrite else []
        files = [x for m in messages if m for x in m.files]
        with store.open_output_stream(f"{root}/{COMMITS}/{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        for x in older:
            store.delete_file(x.path)

    def abort(self, messages: Sequence) -> None:
        store, root = file_system(self.path)
        for name, _ in [x for m in messages if m for x in m.files]:
            store.delete_file(f"{root}/{name}")


# ---- read -------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of header columns; payload and all others stay with Spark."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if len(name) == 1 and name[0] in FIELDS and isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual)):
                self.tests.append((type(f).__name__, name[0], tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        store, _ = file_system(self.path)
        out = []
        for path, size in archive_files(self.path):
            marks = [0]
            with store.open_input_file(path) as f:
                if size >= 4:
                    length = struct.unpack("<I", f.read_at(4, size - 4))[0]
                    if 12 < length < min(size, 1 << 17):
                        tail = extra_fields(f.read_at(length, size - 4 - length)).get(b"WI")
                        if tail:
                            marks, size = list(struct.unpack(f"<{len(tail) // 8}Q", tail)), size - 4 - length
            out += [Piece(path, a, b) for a, b in zip(marks, [*marks[1:], size], strict=True)]
        return out

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            own = row[column]
            if own is None:
                return False
            if kind == "EqualTo" and own != value or kind == "In" and own not in value:
                return False
            if kind == "GreaterThanOrEqual" and own < value or kind == "LessThanOrEqual" and own > value:
                return False
        return True

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition is None:  # what Spark plans where there are no files
            return
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as f:
            at = partition.start
            while at < partition.end:
                head = f.read_at(min(4096, partition.end - at), at)
                own = member_length(head)
                if own is None:
                    yield from self.read_foreign(f, at, partition.end)
                    return
                if own > len(head):
                    head = f.read_at(own, at)
                row = parse_header(zlib.decompress(head[:own], 31))
                at += own
                body = f.read_at(24, at)
                length = member_length(body)
                payload = None
                if self.wanted(row):
                    if self.payload:
                        payload = zlib.decompress(f.read_at(length, at), 31)[:-4]
                    yield (*(row[c] for c in FIELDS), payload)
                at += length

    def read_foreign(self, f, at: int, end: int) -> Iterator[tuple]:
        """Records of other writers: inflate a stream, keep only payloads that are wanted."""
        stream = Inflated(f, at, end)
        while (head := stream.header()) is not None:
            row = parse_header(head)
            keep = self.wanted(row) and self.payload
            body = stream.take(int(row["length"]), keep)
            if self.wanted(row):
                yield (*(row[c] for c in FIELDS), body if keep else None)


class Inflated:
    """Bytes of concatenated gzip members, or of a plain file, read in pieces of a MiB."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.end, self.buffer = f, at, end, b""
        self.plain = f.read_at(2, at) != b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= self.end:
            return False
        data = self.f.read_at(min(1 << 20, self.end - self.at), self.at)
        self.at += len(data)
        while data and not self.plain:
            self.buffer += self.inflate.decompress(data)
            data = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer += data if self.plain else b""
        return True

    def header(self) -> bytes | None:
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if b"\r\n\r\n" in self.buffer:
                head, self.buffer = self.buffer.split(b"\r\n\r\n", 1)
                return head
            if not self.more():
                return None

    def take(self, n: int, keep: bool) -> bytes:
        out = []
        while n:
            if not self.buffer and not self.more():
                raise EOFError("the archive ends within a record")
            got, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(got)
            if keep:
                out.append(got)
        return b"".join(out)


def parse_header(data: bytes) -> dict:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    values = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    row = {c: values.get(f.lower()) for c, f in FIELDS.items()}
    row["length"] = values.get("content-length", "0")
    row["payload_bytes"] = int(row["payload_bytes"] or row["length"])
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with filters pushed to its headers. The classes travel with the plan, because the
    process that plans a Python source sees no files sent to the session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ------------------------------------------------------------------


def as_records(pages: DataFrame, smallest: int = 1000) -> DataFrame:
    """Pages as records. Of equal payloads of at least ``smallest`` bytes, the largest page_id is the response (all of
    its rows, if the id repeats), and the others revisit it. A null page_id counts as smallest.

    Each payload's group is first reduced to its largest id in every task, so a payload that a third of the pages share
    costs one row per task; the join back is by payload hash, which Spark splits where it is skewed.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    largest = (
        p.filter(F.col("payload_bytes") >= smallest)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    return p.join(largest, ["payload_digest", "payload_bytes"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name.alias("record_id"),
        F.regexp_replace("target_uri", r"[\r\n]", "").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("last_id").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_number(column: str):
    """The id in a record's name; null for a page without one."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def page_archives(pages: DataFrame, path: str, smallest: int = 1000) -> DataFrame:
    """Write pages to archives at ``path`` and read their records back, in one table of digests.

    Responses are read with their payload, and the digest is taken again from what was read; revisits are read by a
    filter on the record type that skips all payloads.
    """
    spark = pages.sparkSession
    register(spark)
    python_tasks(spark)
    as_records(pages, smallest).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc")
    full = read.load(path).filter("record_type = 'response'")
    kept = full.select(
        page_number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )
    again = read.option("payload", "false").load(path).filter("record_type = 'revisit'")
    return kept.unionByName(
        again.select(
            page_number("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            page_number("refers_to").alias("refers_to"),
        )
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archives(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM q
"""
