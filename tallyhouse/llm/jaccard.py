"""Similarity join of documents on word n-grams, with components of linked documents.

A document's set holds the hashes of its distinct n-grams; documents with equal sets are one node from then on. Two
nodes link when 100 * intersection >= percent * union. The join is exact and works in steps:

1. Count n-grams that are frequent in some task, so that frequent ones can be put last in the token orders.
2. Near copies are found first: nodes are sorted by their smallest tokens under several hash orders, and neighbours
   that agree under most orders are compared. Each node meets the next few in some sortings, never its whole
   group; what links is connected into components, and later rounds look only across components.
3. Prefix filter for the rest. Sorted by (frequency, hash), similar sets share at least ``SHARED`` of their first
   n - ceil(percent * n / 100) + SHARED tokens. Only tokens whose nodes lie in several components are looked at, and in
   each of them the members of its largest component are not compared with one another. Pairs are counted by shared
   tokens and filtered by size. Tokens of more than ``FEW`` nodes, as those of dense groups, make no row for each pair:
   their nodes meet in blocks with signatures, a byte for each of ``BUCKETS`` parts of the set. Parts that differ hold
   a token of one side only, so a pair with more of them than a link allows is left out before it becomes a row. Nodes
   with up to ``LISTED`` tokens of this kind carry all of them, so that a pair of such nodes becomes one row, at its
   smallest common token, and not one for each.
4. Before a pair is verified, its sets must share prefix tokens under ``ORDERS`` further orders as well; only pairs that
   pass every filter are compared token by token.
5. Components of all links.
6. Number of links. Every link lies within a component, so the pairs of each component are compared there, also those
   that the steps before left out because their nodes were connected already. A large component is dealt into blocks;
   each pair of blocks is a group of its own, and only counts leave it. Documents with equal sets link as well.

Only texts of nodes that have a candidate pair travel, read from the table again for each step. Nodes are dealt over blocks of at most ``GROUP``, near copies into the
same, and a text goes once to each pair of blocks in which it has candidates, so all tasks are bounded. Frequent tokens are broadcast, at most ``FREQUENT`` of them, 8 MB; the bound decides which
tokens come last, not which pairs are found.

Null texts count as empty; texts without words have n = 0 and are linked with nothing. Texts with fewer words than an
n-gram have one token, the whole sequence. Repeated rows, also with one doc_id, are rows of the result each; a missing
doc_id is null in component_id only if nobody in its component has one. Empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, Hashes, chunks, distinct_by_row, mix, ragged, text_bytes, words
from .common import passes, python_tasks, remove, row_key, scratch, sieve, stored, table, with_text

SHARED = 4
ORDERS = 2
#: Sortings by smallest tokens, and the hash orders that each looks at.
KEYS, DEPTH = 16, 4
#: Sortings that are used, orders under which neighbours must agree to be compared, and how far apart they may lie in
#: each round.
SORTINGS, AGREE, ROUNDS = 6, 9, ((1, 1), (2, 6))
GROUP = 200
#: Bytes of text in a block, besides ``GROUP`` nodes, and tokens that are compared at once.
BLOCK_BYTES, AT_ONCE = 4 << 20, 1 << 12
#: Pairs for each set, up to which sets are compared one by one.
FEW_PAIRS = 4
#: Nodes of a token up to which a join pairs them, nodes in a block beyond that, and pairs that are looked at at once.
FEW, MEET, PAIRS_AT_ONCE = 16, 4096, 1 << 17
#: Parts of a signature, how many of them are looked at first, and rows that get theirs at once.
BUCKETS, FIRST, ROWS_AT_ONCE = 256, 64, 1 << 12
#: Tokens of many nodes that a node carries, if it has no more, and pairs whose lists are compared at once.
LISTED, LISTS_AT_ONCE = 32, 1 << 11
#: Tokens seen so often are put last, and in a task at least so often to be counted.
OFTEN, OFTEN_IN_TASK = 32, 2
FREQUENT = 1 << 20
#: Stands for no token where a list has ended.
UNLISTED = np.iinfo(np.int64).max
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, KEYS + ORDERS, dtype=np.uint64)


# ---- sets ---------------------------------------------------------------------


def token_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct n-grams of each row."""
    data = LOWER[data]
    start, end, row = words(data, off)
    h = Hashes(data).of(start, end)
    grams, rows = [], []
    for k in range(n, 0, -1):
        if k > len(h):
            continue
        last = len(h) - k + 1
        inside = row[:last] == row[k - 1 :]
        if k < n:  # whole texts of k words
            count = np.bincount(row, minlength=len(off))
            inside &= count[row[:last]] == k
            if not inside.any():
                continue
        g = np.full(last, np.uint64(k))
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + last]
        grams.append(mix(g[inside]))
        rows.append(row[:last][inside])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return distinct_by_row(np.concatenate(rows), np.concatenate(grams))


def sieved(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows (k1, k2, text) whose k2 may be wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, batch.column(1).to_numpy())))

    return docs.mapInArrow(run, docs.schema)


def required(size: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set must share with any set it links with."""
    return (size * percent + 99) // 100


def prefix(row: np.ndarray, key: np.ndarray, length: np.ndarray, rows: int) -> np.ndarray:
    """Places of the first ``length`` tokens of each row in the order of ``key``."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    size = np.bincount(row, minlength=rows)
    first = np.cumsum(size) - size
    return order[np.arange(len(row)) - first[row[order]] < length[row[order]]]


def frequency(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    tokens, counts = frequent
    out = np.zeros(len(values), np.uint64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
        hit = tokens[at] == values
        out[hit] = counts[at[hit]]
    return out


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and counts. Each task keeps a bounded table of what it has seen repeatedly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged(seen, count, new):
            v, c = np.unique(np.concatenate(new), return_counts=True)
            both = np.concatenate([seen, v])
            u, at = np.unique(both, return_inverse=True)
            total = np.bincount(at, np.concatenate([count, c])).astype(np.int64)
            while len(u) > FREQUENT:  # forget what was seen least
                keep = total > total.min()
                u, total = u[keep], total[keep] - total.min()
            return u, total

        for _, data, off in chunks(batches):
            _, v = token_sets(data, off, n)
            new.append(v)
            size += len(v)
            if size > 1 << 20:
                seen, count = merged(seen, count, new)
                new, size = [], 0
        if new:
            seen, count = merged(seen, count, new)
        often = count >= OFTEN_IN_TASK
        yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(count[often])], ["token", "n"])

    found = (
        docs.mapInArrow(run, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= OFTEN)
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy().astype(np.uint64)[order]


# ---- verification ---------------------------------------------------------------


def pairs_linked(row: np.ndarray, value: np.ndarray, rows: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of rows link: first whether they share prefix tokens under the further orders, then, of
    those that do, whether their whole sets are similar enough."""
    size = np.bincount(row, minlength=rows)
    length = size - required(size, percent) + 1
    possible = np.ones(len(a), bool)
    for seed in SEEDS[-ORDERS:]:
        at = prefix(row, mix(value ^ seed), length, rows)
        possible[possible] = shared_counts(row[at], value[at], rows, a[possible], b[possible]) > 0
    common = np.zeros(len(a), np.int64)
    wanted = np.zeros(rows, bool)
    wanted[a[possible]] = wanted[b[possible]] = True
    some = wanted[row]
    common[possible] = shared_counts(row[some], value[some], rows, a[possible], b[possible])
    union = size[a] + size[b] - common
    return possible & (union > 0) & (100 * common >= percent * union)


def shared_counts(row: np.ndarray, value: np.ndarray, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common values of the pairs (a, b) of rows: one matrix product for many pairs, set by set for few."""
    if len(a) > FEW_PAIRS * rows:
        return overlaps(row, value, rows)[a, b].astype(np.int64)
    order = np.argsort(row, kind="stable")
    edge = np.searchsorted(row[order], np.arange(rows + 1))
    sets = value[order]
    return np.array([len(np.intersect1d(sets[edge[x] : edge[x + 1]], sets[edge[y] : edge[y + 1]], True)) for x, y in zip(a, b, strict=True)], np.int64)


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """k1, k2, text of the documents that ``rows`` names; others are sieved out before anything is shuffled."""
    some = sieved(docs.select("k1", "k2", "text"), sieve(rows, "k2"))
    return some.join(rows.select("k1", "k2").distinct(), ["k1", "k2"], "leftsemi")


def homes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, k1, k2, home: a block for each node of ``pairs``. Nodes with the same smallest token, as most near copies
    have, share a block, up to ``GROUP`` nodes or ``BLOCK_BYTES`` of text; more of them are dealt over several."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keyed = ends.join(nodes.select("node", F.col("keys")[0].alias("key"), "k1", "k2", "bytes"), "node")
    blocks = keyed.groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("long").alias("blocks")
    )
    home = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("home")
    return keyed.join(blocks, "key").select("node", "k1", "k2", home)


def links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, stored as ``name``. Pairs meet where their blocks do, and a text goes there once for all of its
    pairs, so a group of near copies moves its texts a few times instead of once for each pair."""
    with scratch() as made:
        found = _links(stored(pairs, f"{name}_pairs"), nodes, docs, n, percent)
    out = stored(found, name)
    remove(pairs.sparkSession, made)
    return out


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    home = stored(homes(pairs, nodes), "homes")
    met = pairs.join(home.select(F.col("node").alias("a"), F.col("home").alias("x")), "a").join(
        home.select(F.col("node").alias("b"), F.col("home").alias("y")), "b"
    )
    met = stored(met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"), "met")
    guests = met.select(F.col("i").alias("p"), F.col("j").alias("q"), F.explode(F.array("a", "b")).alias("node")).distinct()
    guests = guests.join(home.select("node", "k1", "k2"), "node").join(texts_of(docs, home), ["k1", "k2"]).select("p", "q", "node", "text")

    def compare(pairs: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        node = guests["node"].to_numpy(np.int64)
        order = np.argsort(node)
        a, b = (order[np.searchsorted(node[order], pairs[c].to_numpy(np.int64))] for c in "ab")
        raw = [t.encode() for t in guests["text"]]
        row, value = token_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)
        return pairs.loc[pairs_linked(row, value, len(raw), a, b, percent), ["a", "b"]]

    return met.groupBy("i", "j").cogroup(guests.groupBy("p", "q")).applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node with an edge reaches. Labels spread to neighbours and are then
    replaced by their own labels, so that rounds grow with the logarithm of a component's width."""
    edges = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = stored(
            spread.join(jump, "comp", "left").select("node", F.least("comp", "further").alias("comp"), "old"), "labels"
        )
        if new.filter("comp < old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def neighbours(nodes: DataFrame, first: int, near: int, far: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that lie ``near`` to ``far`` places apart when sorted by their
    smallest tokens, from the ``first`` order on, and agree under ``AGREE`` orders. Pairs across two partitions are left
    to the other steps."""
    order = [F.col("keys")[(first + i) % KEYS] for i in range(DEPTH)]
    flat = nodes.select("node", "comp", "keys", *(k.alias(f"s{i}") for i, k in enumerate(order)))
    sorting = [f"s{i}" for i in range(DEPTH)] + ["node"]

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            node, comp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = batch.column(2).flatten().to_numpy().reshape(-1, KEYS)
            before = 0
            if held is not None:
                before = len(held[0])
                node, comp, keys = (np.concatenate(x) for x in zip(held, (node, comp, keys), strict=True))
            held = tuple(x[max(0, len(node) - far) :].copy() for x in (node, comp, keys))
            for k in range(near, min(far, len(node) - 1) + 1):
                begin = max(0, before - k)  # pairs within what was held are known
                x, y = slice(begin, len(node) - k), slice(begin + k, len(node))
                alike = ((keys[x] == keys[y]).sum(1) >= AGREE) & (comp[x] != comp[y])
                a, b = node[x][alike], node[y][alike]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = flat.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    return ordered.select("node", "comp", "keys").mapInArrow(pairs, "a long, b long")


# ---- tokens of many nodes ---------------------------------------------------------


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """A byte for each of ``BUCKETS`` parts of each row's set: equal parts have equal bytes. Values are sorted by row."""
    out = np.empty((rows, BUCKETS), np.uint8)
    part, byte = (value % np.uint64(BUCKETS)).astype(np.int64), (value >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
    for at in range(0, rows, ROWS_AT_ONCE):
        end = min(rows, at + ROWS_AT_ONCE)
        x, y = np.searchsorted(row, [at, end])
        sums = np.bincount((row[x:y] - at) * BUCKETS + part[x:y], byte[x:y].astype(np.float64), (end - at) * BUCKETS)
        out[at:end] = (sums % 256).astype(np.uint8).reshape(-1, BUCKETS)
    return out


def apart(sig: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) differ in more than ``most`` parts, and so in more tokens than that."""
    differ = np.count_nonzero(sig[a, :FIRST] != sig[b, :FIRST], axis=1)
    some = np.flatnonzero(differ <= most)
    differ[some] += np.count_nonzero(sig[a[some], FIRST:] != sig[b[some], FIRST:], axis=1)
    return differ > most


def common_listed(token: np.ndarray, listed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of listed tokens that the pairs (a, b) of rows have in common, or 0 if one of these is smaller than the ``token``
    that brought them together."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), LISTS_AT_ONCE):
        some = slice(at, at + LISTS_AT_ONCE)
        x, y = listed[a[some]], listed[b[some]]
        both = (x[:, :, None] == y[:, None, :]).any(2) & (x < UNLISTED)
        before = (both & (x < token[a[some], None])).any(1)
        out[some] = np.where(before, 0, both.sum(1))
    return out


def common_of_many(found: DataFrame, percent: int) -> DataFrame:
    """a, b, need, common: how many tokens a pair has in common, over one or more rows, of pairs that signatures leave possible.
    ``found``: token, node, size, comp, total (nodes of the token), sig."""
    tokens = F.when(F.count(F.lit(1)) <= LISTED, F.collect_list("token")).alias("listed")
    found = found.join(found.groupBy("node").agg(tokens), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        found.withColumn("blocks", F.ceil(F.col("total") / MEET).cast("long"))
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "comp", "sig", "listed")
    )

    def pairs(group: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, i, j, own, node, size, comp = (group.column(c).to_numpy() for c in ("token", "i", "j", "own", "node", "size", "comp"))
        size = size.astype(np.int64)
        lists = group.column("listed").combine_chunks()
        whole = lists.is_valid().to_numpy(zero_copy_only=False)
        listed = np.full((len(node), LISTED), UNLISTED)
        listed[np.arange(LISTED) < pc.list_value_length(lists).fill_null(0).to_numpy()[:, None]] = lists.flatten().to_numpy()
        sig = text_bytes(group.column("sig").combine_chunks())[0].reshape(-1, BUCKETS)
        later = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(node)) - 1
        before = np.concatenate([[0], np.cumsum(later)])
        at = 0
        while at < len(node):
            end = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, "right")) - 1)
            a, b = np.repeat(np.arange(at, end), later[at:end]), ragged(np.arange(at, end) + 1, later[at:end])
            at = end
            x, y = size[a], size[b]
            few = (comp[a] != comp[b]) & ((i[a] == j[a]) | (own[a] != own[b])) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            a, b = a[few], b[few]
            both = size[a] + size[b]
            # sets that link differ in at most so many tokens
            near = ~apart(sig, a, b, both * (100 - percent) // (100 + percent))
            a, b = a[near], b[near]
            common, both_whole = np.ones(len(a), np.int64), whole[a] & whole[b]
            common[both_whole] = common_listed(token, listed, a[both_whole], b[both_whole])
            a, b, common, both = (x[common > 0] for x in (a, b, common, both[near]))
            slack = [np.minimum(required(size[c], percent), SHARED) - required(size[c], percent) for c in (a, b)]
            need = np.maximum(1, -(-percent * both // (100 + percent)) + np.minimum(*slack))
            columns = [np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), need, common]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "need", "common"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, ["token", "i", "j"]):
            yield from pairs(rows, edges)

    ordered = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, need long, common long")


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups of sorted batches, and where each group begins and the last ends."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        keys = np.column_stack([rows.column(c).to_numpy() for c in key])
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        held = rows.slice(edges[-1])
        if edges[-1]:
            yield rows.slice(0, edges[-1]), edges
    if held is not None:
        yield held, np.array([0, held.num_rows])


# ---- number of links --------------------------------------------------------------


def overlaps(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Common tokens of each two of ``rows`` sets."""
    _, token, count = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    some = count[token] > 1
    row, token = row[some], place[token[some]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((rows, rows))
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, AT_ONCE):
        at = slice(*np.searchsorted(token, [first, first + AT_ONCE]))
        x = np.zeros((rows, int(token[at.stop - 1]) - first + 1), np.float32)
        x[row[at], token[at] - first] = 1
        out += x @ x.T
    return out


def link_counts(comps: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """node, links: with how many documents of other nodes each node of ``comps`` links."""
    members = stored(comps.join(nodes.select("node", "copies", "row.k1", "row.k2"), "node"), "reps")
    members = members.join(texts_of(docs, members), ["k1", "k2"])
    members = stored(members.select("comp", "node", "copies", "text"), "linked")
    blocks = members.groupBy("comp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("long").alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        members.join(blocks, "comp")
        .select("comp", "node", "copies", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "text")
    )

    def counted(group: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        i, j, own, node, copies = (group.column(c).to_numpy() for c in ("i", "j", "own", "node", "copies"))
        row, value = token_sets(*text_bytes(group.column("text").combine_chunks()), n)
        size = np.bincount(row, minlength=len(node))
        place = np.searchsorted(row, edges)
        out = np.zeros(len(node), np.int64)
        for a, b, p, q in zip(edges[:-1], edges[1:], place[:-1], place[1:], strict=True):
            common = overlaps(row[p:q] - a, value[p:q], b - a)
            union = size[a:b, None] + size[None, a:b] - common
            link = (union > 0) & (100 * common >= percent * union)
            if i[a] == j[a]:
                np.fill_diagonal(link, False)
            else:
                link &= own[a:b, None] != own[None, a:b]
            out[a:b] = link @ copies[a:b]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(out)], ["node", "links"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, ["comp", "i", "j"]):
            yield counted(rows, edges)

    ordered = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return ordered.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


# ---- join -----------------------------------------------------------------------


def similar_documents(docs: DataFrame, n: int, percent: int, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; k1, k2, which tell rows apart (see ``row_key``), and
    comp, equal within a component; n_links, the number of rows that the row links with. Without ``count_links``
    there is no n_links, and pairs within a component are not compared."""
    python_tasks(docs.sparkSession)
    number = ["n_links"] if count_links else []
    with scratch() as made:
        found = placed_documents(with_text(docs).select("doc_id", "text", *row_key()), n, percent, count_links)
    placed = stored(found.select("doc_id", "k1", "k2", "n_shingles", "comp", *number), "placed")
    remove(docs.sparkSession, made)
    smallest = placed.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "comp", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "k1",
        "k2",
        "comp",
        *number,
    )


def placed_documents(docs: DataFrame, n: int, percent: int, count_links: bool) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, k1, k2) with their components."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequent_tokens(docs.select("doc_id", "text"), n))

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            rows = part.num_rows
            row, value = token_sets(data, off, n)
            size = np.bincount(row, minlength=rows)
            first = np.cumsum(size) - size
            some = size > 0
            node = np.zeros(rows, np.uint64)
            keys = np.zeros((rows, KEYS), np.uint64)
            if some.any():
                at = first[some]
                node[some] = np.add.reduceat(mix(value ^ SEEDS[0]), at)
                keys[some] = np.column_stack([np.minimum.reduceat(mix(value ^ s), at) for s in SEEDS[:KEYS]])
            columns = [part.column(i) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(size),
                    pa.array(mix(node + size.astype(np.uint64)).view(np.int64), mask=~some),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), KEYS).cast(pa.list_(pa.int64())),
                    pa.array(np.diff(off)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(BUCKETS), rows, [None, pa.py_buffer(signatures(row, value, rows))]).cast(pa.binary()),
                ],
                ["doc_id", "k1", "k2", "n_shingles", "node", "keys", "bytes", "sig"],
            )

    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            rows = part.num_rows
            row, value = token_sets(data, off, n)
            if not len(row):
                continue
            size = np.bincount(row, minlength=rows)
            some = size > 0
            node = np.zeros(rows, np.uint64)
            node[some] = np.add.reduceat(mix(value ^ SEEDS[0]), (np.cumsum(size) - size)[some])
            node = mix(node + size.astype(np.uint64)).view(np.int64)
            need = required(size, percent)
            rank = np.minimum(frequency(value, sent.value), np.uint64((1 << 24) - 1)) << np.uint64(40) | value >> np.uint64(24)
            at = prefix(row, rank, size - need + np.minimum(need, SHARED), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[at].view(np.int64)), pa.array(node[row[at]]), pa.array(size[row[at]].astype(np.int32))],
                ["token", "node", "size"],
            )

    columns = "doc_id long, k1 long, k2 long, n_shingles long, node long, keys array<long>, bytes long, sig binary"
    sets = stored(docs.mapInArrow(summaries, columns), "sets")
    nodes = sets.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("k1", "k2", "bytes", "sig")).alias("row"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("copies")
    )
    nodes = stored(nodes, "nodes")
    found = docs.select("doc_id", "text").mapInArrow(postings, "token long, node long, size int")
    shared = found.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("token")
    shared = stored(found.join(shared, "token", "leftsemi").groupBy("token", "node").agg(F.first("size").alias("size")), "shared")
    rows = nodes.join(shared.select("node").distinct(), "node", "leftsemi").select("node", "keys", "row.k1", "row.k2", "row.bytes", "row.sig")
    rows = stored(rows, "rows")
    placed = rows.select("node", "keys", F.col("node").alias("comp"))
    near = None
    for lo, hi in ROUNDS:
        if near is not None:
            comp = F.coalesce("comp", "node").alias("comp")
            placed = stored(rows.select("node", "keys").join(comps, "node", "left").select("node", "keys", comp), "looked_at")
        pairs = functools.reduce(DataFrame.unionByName, [neighbours(placed, k, lo, hi) for k in range(SORTINGS)])
        new = links(pairs.distinct(), rows, docs, n, percent, "near")
        if near is not None and new.isEmpty():
            continue
        near = new if near is None else near.unionByName(new)
        comps = components(near)

    members = stored(
        shared.join(comps, "node", "left").select("token", "node", "size", F.coalesce("comp", "node").alias("comp")), "members"
    )
    per_comp = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_tokens = per_comp.groupBy("token").agg(
        F.max(F.struct("m", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("total")
    ).filter("comps > 1").select("token", F.col("largest.comp").alias("main"), "total")
    still = stored(members.join(open_tokens, "token"), "open")
    few = still.filter(F.col("total") <= FEW)
    left = few.filter("comp <> main").alias("x")
    right = few.select("token", F.col("node").alias("node2"), F.col("size").alias("size2"), F.col("comp").alias("comp2"))
    # the i-th common token of sets with overlap o is at place i + size - o at most, so that many lie in both prefixes
    alpha = "((%s * {p} + 99) div 100)".format(p=percent)
    slack = [f"least({alpha % x}, {SHARED}) - {alpha % x}" for x in ("size", "size2")]
    overlap = f"ceil({percent} * (size + size2) / {100 + percent})"
    need = F.expr(f"greatest(1, {overlap} + least({slack[0]}, {slack[1]}))")
    candidates = (
        left.join(right, "token")
        .filter(
            (F.col("comp") != F.col("comp2"))
            & ((F.col("comp2") == F.col("main")) | (F.col("node") < F.col("node2")))
            & (100 * F.least("size", "size2") >= percent * F.greatest("size", "size2"))
        )
        .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), need.cast("long").alias("need"))
    )
    many = still.filter(F.col("total") > FEW).drop("main").join(rows.select("node", "sig"), "node")
    candidates = (
        candidates.withColumn("common", F.lit(1).cast("long"))
        .unionByName(common_of_many(many, percent))
        .groupBy("a", "b")
        .agg(F.sum("common").alias("common"), F.min("need").alias("need"))
        .filter("common >= need")
        .select("a", "b")
    )
    more = links(candidates, rows, docs, n, percent, "more")
    if not more.isEmpty():
        comps = components(near.unionByName(more))

    placed = sets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if count_links:
        counts = stored(link_counts(comps, nodes, docs, n, percent), "counts")
        placed = placed.join(nodes.select("node", "copies"), "node", "left").join(counts, "node", "left")
        # texts without words are no node and have no links
        placed = placed.withColumn("n_links", F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    return placed


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three columns of ``OP7_SQL``. They need components only; ``op7_ngram_jaccard_links`` counts the links too."""
    docs = table(spark, sf_dir, "documents")
    return similar_documents(docs, 3, 90, count_links=False).select("doc_id", "n_shingles", "component_id")


def op7_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return similar_documents(docs, 3, 90).select("doc_id", "n_shingles", "component_id", "n_links")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS t
  FROM w
), n AS (
  SELECT doc_id, len(t)::BIGINT AS n_shingles, t FROM s
), e AS (
  SELECT doc_id, n_shingles, unnest(t) AS token FROM n
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n_shingles) AS nx, any_value(b.n_shingles) AS ny, count(*) AS c
  FROM e a JOIN e b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 90 * (nx + ny - c)
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM n
  UNION
  SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x
)
SELECT n.doc_id, n.n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""

OP7_LINKS_SQL = OP7_SQL[: OP7_SQL.rindex("SELECT n.doc_id")] + r"""
SELECT n.doc_id, n.n_shingles, min(r.reach) AS component_id, (SELECT count(*) FROM l WHERE l.x = n.doc_id) AS n_links
FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
