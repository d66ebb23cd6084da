"""Removal of repeated 200-byte strings by prefix-free parsing.

The parse. A rolling hash picks triggers: of every ``REACH`` neighbouring places the one with the smallest hash. Each
200-byte window has a trigger that only its own bytes decide, so equal windows have it at the same offset. The windows
with the same trigger form a phrase: the bytes from the start of the first to the end of the last. Phrases overlap by
200 bytes and more, no phrase is a prefix of another with the same trigger unless they are equal, and their length is
bounded by construction. Equal phrases are one entry of the dictionary, however often the parse repeats them.

No suffix array is built and nothing is sorted: only equality to the depth of 200 bytes is asked for, so strings are
grouped by hash. The bytes from the trigger on (the core, which all windows of a phrase share) decide most of it.

1. A core that occurs once cannot be part of a repeated window: its phrase is dropped. This is most of unique text.
2. A phrase that the parse holds twice repeats as a whole: all of its windows are removed without looking inside.
3. What is left are dictionary entries that occur once, whose core occurs in other entries too, as at the edges of a
   copied passage. Only these, and one occurrence of the entries that they meet, are cut into blocks of ``BLOCK`` windows
   by their offset from the trigger, and steps 1 and 2 are repeated with blocks for phrases.
4. Blocks that are still unclear are expanded into windows of 200 bytes; windows with the same hash are repeats.

Hashes have 64 bits for cores and phrases together with each other and 128 bits for windows. Equal strings meet by
shuffles with partial counts, and a passage that a third of the documents share costs one row per task.

Documents are bytes of UTF-8. Null texts count as empty. Documents below 200 bytes keep everything. Copies, also those
with the same doc_id, count as elsewhere, and are rows of the result each. Empty tables give no rows. Texts are parsed
whole, and matches never cross documents.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import Hashes, chunks, mix, ragged, sliding_min
from .common import passes, python_tasks, row_key, sieve, stored, table, with_text

LENGTH = 200
#: Places of which one is a trigger, and bytes of the hash that decides.
REACH, TRIGGER = 112, 12
#: Windows of a block.
BLOCK = 16
PHRASE = "k1 long, k2 long, first int, last int, core long, whole long"
SUFFIX = "h1 long, h2 long, k1 long, k2 long, first int, single boolean"
KEPT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def parse(data: np.ndarray, off: np.ndarray, length: int = LENGTH, reach: int = REACH) -> list[np.ndarray]:
    """Row, first and last window, hash of the core and of the whole of each phrase."""
    count = np.maximum(0, np.diff(off) - length + 1)
    place = ragged(off[:-1], count)
    if not len(place):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    h, h2 = Hashes(data), Hashes(data, 1)
    at = np.arange(len(data) - TRIGGER + 1)
    rank = h.of(at, at + TRIGGER) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    trigger = (sliding_min(rank, reach)[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    begin, end, trigger = place[first], place[last], trigger[first]
    row = np.searchsorted(off, begin, "right") - 1
    core = h.of(trigger, trigger + length - reach + 1)
    return [row, begin - off[row], end - off[row], core, h2.of(begin, end + length)]


def blocks(h: Hashes, h2: Hashes, first: int, last: int, reach: int, length: int) -> tuple[np.ndarray, ...]:
    """First and last window, core and whole of the blocks of one phrase. Blocks begin at fixed offsets from the trigger,
    so equal windows lie in blocks with equal cores; a block that the phrase cuts short is only equal to one cut alike."""
    at = np.arange(last, first + reach)  # the trigger of all windows lies here
    rank = h.of(at, at + TRIGGER) >> np.uint64(32)
    trigger = int(at[rank.argmin()])
    j = np.arange((trigger - last) // BLOCK, (trigger - first) // BLOCK + 1)
    high, low = trigger - BLOCK * j, trigger - BLOCK * j - BLOCK + 1
    begin, end = np.maximum(low, first), np.minimum(high, last)
    core = h.of(high, low + length)
    cut = ((high - end) * BLOCK + begin - low).astype(np.uint64)
    return begin, end, core, mix(h2.of(begin, end + length) + cut)


def suffixes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of one text."""
    at = np.arange(max(0, len(data) - length + 1))
    return Hashes(data).of(at, at + length), Hashes(data, 1).of(at, at + length)


def merged(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows from ``first`` to ``last`` cover."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(first)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    spark = docs.sparkSession
    python_tasks(spark)
    reach = min(REACH, length - TRIGGER)
    if reach < 1:
        raise ValueError(f"length must be above {TRIGGER}")
    docs = with_text(docs).select("doc_id", "text", *row_key())

    def phrases(batches: Iterable[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            found = parse(data, off, length, reach)
            if bitmap is not None:
                some = passes(bitmap.value, found[3])
                found = [x[some] for x in found]
            row, first, last, core, whole = found
            k1, k2 = (part.column(i).to_numpy()[row] for i in (0, 1))
            columns = [k1, k2, first.astype(np.int32), last.astype(np.int32), core.view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["k1", "k2", "first", "last", "core", "whole"]
            )

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            k1, k2 = (part.column(i).to_numpy() for i in (0, 1))
            for i, open_at in enumerate(part.column(3).to_pylist()):
                text, out = data[off[i] : off[i + 1]], []
                h, h2 = Hashes(text), Hashes(text, 1)
                for x in open_at:
                    found = blocks(h, h2, x["first"], x["last"], reach, length)
                    out.append((*found, np.full(len(found[0]), x["single"])))
                begin, end, core, whole, single = (np.concatenate(c) for c in zip(*out, strict=True))
                n = len(begin)
                columns = [np.full(n, k1[i]), np.full(n, k2[i]), begin.astype(np.int32), end.astype(np.int32)]
                columns += [core.view(np.int64), whole.view(np.int64), single]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["k1", "k2", "first", "last", "core", "whole", "single"]
                )

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            k1, k2 = (part.column(i).to_numpy() for i in (0, 1))
            out = []
            for i, open_at in enumerate(part.column(3).to_pylist()):
                h1, h2 = suffixes(data[off[i] : off[i + 1]], length)
                begin = np.array([x["first"] for x in open_at])
                size = np.array([x["last"] for x in open_at]) - begin + 1
                place = ragged(begin, size)
                single = np.repeat(np.array([x["single"] for x in open_at]), size)
                n = len(place)
                out.append((h1[place], h2[place], np.full(n, k1[i]), np.full(n, k2[i]), place.astype(np.int32), single))
            h1, h2, a, b, place, single = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (h1.view(np.int64), h2.view(np.int64), a, b, place, single)],
                ["h1", "h2", "k1", "k2", "first", "single"],
            )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            out = []
            for i, found in enumerate(part.column(2).to_pylist()):
                text = data[off[i] : off[i + 1]]
                keep, spans = np.ones(len(text), bool), 0
                if found:
                    begin, end = merged(
                        np.array([x["first"] for x in found]), np.array([x["last"] for x in found]), length
                    )
                    spans = len(begin)
                    keep[ragged(begin, end - begin)] = False
                kept = text[keep].tobytes()
                out.append((len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            )

    keyed = docs.select("k1", "k2", "text")
    repeated = keyed.mapInArrow(functools.partial(phrases, bitmap=None), PHRASE).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.filter("n > 1").select("core"), "cores")
    some = spark.sparkContext.broadcast(sieve(repeated, "core"))
    parsed = keyed.mapInArrow(functools.partial(phrases, bitmap=some), PHRASE)
    parsed = stored(parsed.join(repeated, "core", "leftsemi"), "parse")
    entries = stored(dictionary(parsed.withColumn("single", F.lit(True))), "dictionary")
    unclear = unclear_rows(entries)
    inner = stored(rows_with(keyed, unclear).mapInArrow(opened, f"{PHRASE}, single boolean"), "blocks")
    shared = inner.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.max("single").alias("any")).filter("m > 1 and any")
    inner = stored(inner.join(shared.select("core"), "core", "leftsemi"), "shared_blocks")
    inner_entries = stored(dictionary(inner), "inner")
    suffix = stored(rows_with(keyed, unclear_rows(inner_entries)).mapInArrow(windows, SUFFIX), "suffixes")
    twice = suffix.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    suffix = suffix.filter("single").join(twice, ["h1", "h2"], "leftsemi")
    place = ["k1", "k2", "first", "last"]
    ranges = (
        parsed.join(entries.filter("n > 1").select("core", "whole"), ["core", "whole"], "leftsemi").select(place)
        .unionByName(
            inner.filter("single")
            .join(inner_entries.filter("n > 1").select("core", "whole"), ["core", "whole"], "leftsemi")
            .select(place)
        )
        .unionByName(suffix.select("k1", "k2", "first", F.col("first").alias("last")))
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("first", "last")).alias("found"))
    )
    ranges = stored(ranges, "ranges")
    # rows without a repeat are not shuffled
    some = spark.sparkContext.broadcast(sieve(ranges, "k2"))
    all_docs = docs.select("doc_id", "k1", "k2", "text")
    hit = all_docs.mapInArrow(functools.partial(sifted, bitmap=some, keep=True), all_docs.schema)
    missed = all_docs.mapInArrow(functools.partial(sifted, bitmap=some, keep=False), all_docs.schema)
    kind = f"{docs.schema['doc_id'].simpleString().replace(':', ' ')}, {KEPT}"
    found = hit.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "found").mapInArrow(cut, kind)
    nothing = F.lit(None).cast(ranges.schema["found"].dataType)
    return found.unionByName(missed.select("doc_id", "text", nothing.alias("found")).mapInArrow(cut, kind))


def sifted(batches: Iterable[pa.RecordBatch], bitmap, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose k2 passes the sieve, or those for which it doesn't."""
    for batch in batches:
        k2 = batch.column(batch.schema.get_field_index("k2")).to_numpy()
        yield batch.filter(pa.array(passes(bitmap.value, k2) == keep))


def dictionary(phrases: DataFrame) -> DataFrame:
    """Distinct phrases: how often each occurs, whether each of its occurrences has to be decided, and one place."""
    return phrases.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("single").alias("single"),
        F.min(F.struct("k1", "k2", "first", "last")).alias("at"),
    )


def unclear_rows(entries: DataFrame) -> DataFrame:
    """Per text, the places of entries whose core meets different entries, one of them undecided."""
    alone = (F.col("n") == 1) & F.col("single")
    cores = entries.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.max(alone).alias("any")).filter("m > 1 and any")
    found = entries.join(cores.select("core"), "core", "leftsemi")
    return stored(
        found.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.first", "at.last", alone.alias("single"))).alias("open_at")),
        "unclear",
    )


def rows_with(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, text, open_at of wanted texts; few others are shuffled, thanks to the sieve."""
    some = keyed.sparkSession.sparkContext.broadcast(sieve(wanted, "k2"))
    near = keyed.mapInArrow(functools.partial(sifted, bitmap=some, keep=True), keyed.schema)
    return near.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "open_at")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS m FROM d, unnest(range(0, n - 199)) AS u(p)
), r AS (
  SELECT doc_id, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)
), g AS (
  SELECT doc_id, p, (p > lag(p, 1, -1000) OVER o + 200)::INTEGER AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), i AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g
), s AS (
  SELECT doc_id, min(p) AS b, max(p) + 200 AS e FROM i GROUP BY doc_id, span
), k AS (
  SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS after FROM s
), c AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS tail,
    string_agg(substr(h, 2 * after + 1, 2 * (b - after)), '' ORDER BY b) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
