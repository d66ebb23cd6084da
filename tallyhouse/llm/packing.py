"""Best-fit packing of tokenised documents, certified by lower bounds.

Texts are tokenised where they are read; only lengths and checksums travel. Full pieces are sequences of their own. The
others are dealt over groups of about ``group_rows`` rows, each packed by best-fit decreasing. Dual feasible functions
give a lower bound on the number of bins of each group. A group that meets its bound keeps its bins, apart from its
emptiest one; a group with a gap keeps its full bins only. What is left of all groups is dealt anew, over as many groups
as it then needs, and packed again, until one group holds the rest or ``rounds`` are over.

Null texts and empty ones are documents without tokens of their own: the end token alone. Repeated rows are documents
of their own. An empty table gives no sequences. Texts are tokenised whole, whatever their length.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import number_rows
from .bytescan import SPACE, chunks
from .common import python_tasks, stored, table, with_text

CAPACITY = 1024
END = 2
GROUP_ROWS = 20_000
ROUNDS = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes without a break from which a word goes to the coder whose time grows evenly.
LONG_WORD = 2_000


# ---- tokens -----------------------------------------------------------------


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, and a faster coder for the same vocabulary if its ranks lie beside it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow, fast, ranks = Tokenizer.from_file(path), None, path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return slow, fast


def longest_run(data: np.ndarray) -> int:
    """Bytes of the longest stretch without a change between white space and other bytes."""
    turns = np.flatnonzero(np.diff(SPACE[data])) + 1
    return int(np.diff(np.concatenate([[0], turns, [len(data)]])).max())


def encoded(text: str, data: np.ndarray, path: str) -> np.ndarray:
    """Token ids of a text. The faster coder takes plain texts, on which both agree; names of special tokens, letters
    beyond the Latin ones (classed by different Unicode tables) and very long words go the plain way."""
    slow, fast = tokenizer(path)
    if fast is None or "<|" in text or text and (data.max() > 0xC9 or longest_run(data) > LONG_WORD):
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of each document, with a checksum of its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = np.asarray([end], "<u4").tobytes()
        for part, data, off in chunks(batches):
            out: list[tuple] = []
            for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                ids = memoryview(encoded(text, data[off[i] : off[i + 1]], path).tobytes() + stop)
                out += [
                    (doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))
                ]
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# ---- packing of one group -----------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the room left in each bin. Each item goes where the least room is left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_bits = [], 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = room_bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                room_bits ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(0)
        bins[i], offsets[i], rooms[b] = b, capacity - room, room - size
        if room > size:
            open_bins[room - size].append(b)
            room_bits |= 1 << (room - size)
    return bins, offsets, np.asarray(rooms, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest bound that a dual feasible function gives.

    Functions: the identity; threshold functions, which count items above capacity - t as whole bins and forget those
    below t; and rounding functions, which round a size down to k-ths of a bin unless it is a multiple of 1 / (k + 1).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int(count @ size) // capacity)
    counts, sizes = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    large = counts[capacity] - counts[capacity - t]
    middle = sizes[capacity - t] - sizes[t - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        whole = (size * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity) of a bin
        value = np.where(whole, size * k, (size * (k + 1) // capacity) * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def pack_group(rows: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Pack one group and say which rows stay as they are."""
    lengths = rows["length"].to_numpy()
    bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
    keep = rooms == 0
    if len(rooms) == lower_bound(lengths, capacity):
        keep[:] = True
        keep[np.argmax(rooms)] = rooms.max() == 0
    if last:
        keep[:] = True
    return rows.assign(bin=bins, offset=offsets, settled=keep[bins])


# ---- packing of a table -------------------------------------------------------


def pack(
    rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS
) -> DataFrame:
    """``rows`` (with ``length`` from 1 to capacity, other columns are carried) and sequence_id, offset."""
    carried = rows.columns
    rows = stored(rows, "pieces")
    full = rows.filter(F.col("length") >= capacity).select(
        *carried, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = rows.filter(F.col("length") < capacity).withColumn("row", F.monotonically_increasing_id())
    added = [T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("settled", T.BooleanType())]
    done = [full]
    first_group = 0
    for k in range(rounds):
        n = rest.count()
        if not n:
            break
        groups = -(-n // group_rows)
        last = groups == 1 or k == rounds - 1
        # dealt in order of length, so each group has as many large and small pieces as any other
        placed = number_rows(rest, ["length", "row"], "place") if groups > 1 else rest.withColumn("place", F.lit(0))
        # a long in every round, that of one group too: sequence ids shift it by 24 bits, and an int overflows from group 128 on
        dealt = placed.withColumn("grp", F.pmod("place", F.lit(groups)).cast("long") + first_group).drop("place")
        packed = stored(
            dealt.groupBy("grp").applyInPandas(
                functools.partial(pack_group, capacity=capacity, last=last),
                T.StructType([*dealt.schema.fields, *added]),
            ),
            f"packed{k}",
        )
        done.append(
            packed.filter("settled").select(
                *carried, ((F.col("grp") * (1 << 24) + F.col("bin")) * 2 + 1).alias("sequence_id"), "offset"
            )
        )
        if last:
            break
        rest = packed.filter("not settled").select(*carried, "row")
        first_group += groups
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token pieces of documents, packed."""
    return pack(pieces(with_text(docs), path or public_tokenizers.path("byte_bpe_50k.json"), capacity, end), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
