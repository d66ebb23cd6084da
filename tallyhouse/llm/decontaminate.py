"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m bytes with at most k edits shares at least m - q + 1 - k * q of the item's q-grams with
the text, and they lie on diagonals (place in the text less place in the item) that spread over at most k. So hits of
q-grams are counted in bands of 2 * (k + 1) diagonals, each overlapping the next by half, and one of the bands holds all
hits of an occurrence. Bands that reach the bound are regions, and a banded alignment of the whole item within the
region finds the true number of edits.

The budget k of an item is ``rate`` of its length, rounded down, less where the bound would fall below one: then the
largest k that leaves a bound of one. Letters A-Z are compared in lower case, and white space as spaces. Items of fewer
than q bytes are compared as a whole, exactly.

The items are a stated query set. They are counted first; they go to the tasks in blocks of at most ``BLOCK_BYTES``, one
pass over the documents for each block. Only regions that were verified leave a task.

Null texts and items count as empty; an empty item occurs nowhere. Repeated rows and items give rows each. Empty tables
give no rows. Texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, SPACE, Hashes, chunks, ragged
from .common import DOCUMENT, python_tasks, row_key, stored, table, with_text

Q = 8
RATE = 0.1
BLOCK_BYTES = 4 << 20
#: Bits of the table that q-grams of a text are looked up in first.
SIEVE = 22
FOLD = np.where(SPACE, 32, LOWER).astype(np.uint8)
FOUND = "doc_id long, k1 long, k2 long, item_id long, start long, end long, edits int"


class Items:
    """Items of one block, and places of their q-grams by hash."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids = q, [i for i, t in rows if t]
        self.texts = [FOLD[np.frombuffer(t.encode(), np.uint8)] for _, t in rows if t]
        size = np.array([len(t) for t in self.texts])
        self.budget = np.maximum(0, np.minimum(np.floor(rate * size), (size - q) // q)).astype(np.int64)
        self.bound = np.maximum(1, size - q + 1 - self.budget * q)
        data, off = np.concatenate([*self.texts, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = ragged(off[:-1], np.maximum(0, size - q + 1))
        h = Hashes(data).of(at, at + q)
        item = np.searchsorted(off, at, "right") - 1
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], (at - off[item])[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.hashes >> np.uint64(64 - SIEVE)] = True
        self.short = [k for k, n in enumerate(size) if n < q]

    def regions(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Row, item, and lowest and highest diagonal (in the row) of bands with enough hits."""
        q = self.q
        if len(data) < q or not len(self.hashes):
            return []
        at = np.arange(len(data) - q + 1)
        h = Hashes(data).of(at, at + q)
        at = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        row = np.searchsorted(off, at, "right") - 1
        real = (self.hashes[slot] == h[at]) & (at + q <= off[row + 1])
        at, slot, row = at[real], slot[real], row[real]
        times = self.count[slot]
        posting = ragged(self.first[slot], times)
        at, row = np.repeat(at - off[row], times), np.repeat(row, times)
        item, place = self.item[posting], self.place[posting]
        step = self.budget[item] + 1
        band = (at - place) // step
        row, item, place = np.tile(row, 2), np.tile(item, 2), np.tile(place, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item, row))
        row, item, band, place = row[order], item[order], band[order], place[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        # each q-gram of the item counts once, however often the text repeats it
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        row, item, band, new = row[fresh], item[fresh], band[fresh], new[fresh]
        first = np.flatnonzero(new)
        hits = np.diff(np.append(first, len(row)))
        keep = first[hits >= self.bound[item[first]]]
        low = band[keep] * (self.budget[item[keep]] + 1)
        high = low + 2 * (self.budget[item[keep]] + 1) - 1
        return list(zip(row[keep].tolist(), item[keep].tolist(), low.tolist(), high.tolist(), strict=True))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, np.ndarray]:
    """Fewest edits of the whole item against a part of the text whose path stays on diagonals low..high, and the ends
    of such parts; given up as soon as no path is within the budget. Cell d of a row is the text place i + low + d."""
    width, far = high - low + 1, len(item) + len(text) + 1
    lane = np.arange(width)
    place = low + lane
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    padded = np.concatenate([text, [0]])
    for i, byte in enumerate(item.tolist()):
        inside = (place >= 0) & (place < len(text))
        same = inside & (padded[np.clip(place, 0, len(text))] == byte)
        across = np.where(inside, cost + ~same, far)  # item byte i against the text byte before i + 1
        skip = np.append(cost[1:], far) + 1  # item byte left out
        best = np.minimum(across, skip)
        place = place + 1
        best = np.where((place >= 0) & (place <= len(text)), best, far)
        cost = np.minimum.accumulate(best - lane) + lane  # text bytes left out
        cost = np.where((place >= 0) & (place <= len(text)), cost, far)
        if i % 8 == 7 and cost.min() > budget:
            return far, place[:0]
    edits = int(cost.min())
    return edits, place[cost == edits]


def places(needle: bytes, text: bytes) -> Iterator[int]:
    """Where ``needle`` begins in ``text``, overlapping occurrences included."""
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def verify(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of occurrences on these diagonals: all exact ones, or else the best within the budget."""
    a, b = max(0, low), min(len(text), high + len(item))
    part = text[a:b]
    exact = [(a + at, a + at + len(item), 0) for at in places(item.tobytes(), part.tobytes())]
    if exact or not budget:
        return exact
    edits, ends = align(item, text, low, high, budget)
    if edits > budget:
        return []
    end = int(ends[0])
    # backwards from the end
    back = text[max(0, end - len(item) - budget) : end][::-1]
    again, starts = align(item[::-1], back, -budget, budget, budget)
    return [(end - int(starts[0]), end, min(edits, again))]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, k1, k2 (see ``row_key``), item_id, start, end (bytes), edits: one row for each occurrence of an item."""
    spark = docs.sparkSession
    python_tasks(spark)
    docs = with_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    items = with_text(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.filter(F.col("block") == b).orderBy("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(Items(rows, q, rate))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for part, data, off in chunks(batches):
                data = FOLD[data]
                # bands overlap, so an occurrence may be found twice; of those that end at one place one is enough
                best: dict[tuple[int, int, int], tuple[int, int]] = {}
                for row, item, low, high in block.regions(data, off):
                    text = data[off[row] : off[row + 1]]
                    for start, end, edits in verify(block.texts[item], text, low, high, int(block.budget[item])):
                        best[row, item, end] = min(best.get((row, item, end), (edits, start)), (edits, start))
                for item in block.short:
                    needle = block.texts[item].tobytes()
                    for row in range(part.num_rows):
                        for start in places(needle, data[off[row] : off[row + 1]].tobytes()):
                            best[row, item, start + len(needle)] = (0, start)
                if best:
                    keys = sorted(best)
                    rows = [k[0] for k in keys]
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column(0), own.column(2), own.column(3),
                            pa.array([block.ids[k[1]] for k in keys], pa.int64()),
                            pa.array([best[k][1] for k in keys], pa.int64()),
                            pa.array([k[2] for k in keys], pa.int64()),
                            pa.array([best[k][0] for k in keys], pa.int32()),
                        ],
                        ["doc_id", "k1", "k2", "item_id", "start", "end", "edits"],
                    )

        found = docs.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """Rows of documents that hold no item. What has to go is few rows next to the table; it is written once."""
    bad = stored(contaminated(docs, benchmark, q, rate).select("k1", "k2").distinct(), "contaminated")
    keyed = docs.select(*DOCUMENT).withColumn("text", F.coalesce("text", F.lit(""))).select("*", *row_key())
    return keyed.join(bad, ["k1", "k2"], "leftanti").select(*DOCUMENT)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits of each benchmark passage in a document."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", "edits")
