"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces and words; a pointer stands for the suffix that begins at its word and ends with its piece.
Each task sorts pointers word by word to the depth of the longest phrase: three-way partitions around a pivot word, where
the part that equals the pivot goes one word deeper. A part that has become equal in all words is a phrase, and its size
is the phrase's count within the task. These counts are routed by the leading words and added up, longer phrases after
shorter ones: a part goes deeper only if its leading words, and the words that end the longer phrase, are frequent in the
whole table. What is infrequent there is abandoned by a bitmap of bounded size, which lets a few more pass but never
drops a frequent phrase; exact sums decide afterwards.

Frequent words combine in each task before they are shuffled, sums are split by the whole phrase, and joins with the
counts of a phrase's parts are left to skew handling, so no task holds all phrases of one word or language.

Letters A-Z are compared in lower case. A null text is empty, a null language ``und``. Empty texts and pieces have no
words; repeated rows count again; texts are read whole, in bounded blocks of pointers. Other columns are never read.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import chunks
from .common import passes, python_tasks, sieve, stored, table

#: Words of the longest phrase, occurrences of a candidate, percentage of occurrences within a longer one that drops it.
WORDS, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Bytes of text that a task sorts at once, and phrases that leave it at once.
BLOCK, GIVEN = 8 << 20, 1 << 17
#: Bytes after folding: A-Z in lower case, piece separators as line feeds, tabs as spaces.
FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
)
#: Ids of a piece's end and of nothing.
END, NONE = 0, 1
COUNTED = "key string, n long"
SALTS = 64


def numbered(own: bytes, beyond: bytes = b"") -> tuple[np.ndarray, int, list[bytes]]:
    """Word ids of folded texts with END behind each piece, how many of them belong to ``own``, and the words by id."""
    parts = [b"\n  " + own.replace(b"\n", b" \n "), beyond.replace(b"\n", b" \n ")]
    lists = pc.split_pattern(pa.array(parts, pa.large_binary()), b" ")
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy()
    real = ids != NONE
    return np.append(ids[real], np.int32(END)), int(real[: lists.offsets[1].as_py()].sum()), coded.dictionary.to_pylist()


def blocks(texts: list[bytes], beyond: int) -> Iterator[tuple[bytes, bytes]]:
    """The texts as one, and what follows for phrases that end ``beyond`` words later; a long text in several blocks."""
    short = [t for t in texts if len(t) <= BLOCK]
    if short:
        yield b"\n".join(short), b""
    gap, words = re.compile(rb"[ \n]"), re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % beyond)
    for text in texts:
        at = 0
        while len(text) > BLOCK and at < len(text):
            cut = gap.search(text, at + BLOCK)  # a word is never cut
            end = cut.start() if cut else len(text)
            yield text[at:end], words.match(text, end).group()
            at = end


def quicksort(ids: np.ndarray, pointers: np.ndarray, sizes: np.ndarray, depth: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in parts that are equal in ``deepest`` words, and the size of each part.

    ``pointers`` come in parts of ``sizes`` that are equal in ``depth`` words. All parts are split at once: less than,
    equal to and greater than each part's pivot, the median of its first, middle and last word. Pointers whose piece ends
    before ``deepest`` words are left out. ``ids`` has at least ``deepest`` ENDs at its end.
    """
    ready, ready_sizes = [pointers[:0]], [sizes[:0]]
    deep = np.full(len(sizes), depth, np.int32)
    while len(sizes):
        first = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        key = ids[pointers + deep[part]]
        a, b, c = key[first], key[first + sizes // 2], key[first + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        side = 1 + np.sign(key - pivot[part])
        cell = part * 3 + side
        new = np.bincount(cell, minlength=3 * len(sizes))
        begin = np.cumsum(new) - new
        place = np.empty(len(pointers), np.int32)
        for s in range(3):
            here = np.flatnonzero(side == s)
            run = np.cumsum(new[s::3]) - new[s::3]  # members of this side in earlier parts
            place[here] = begin[cell[here]] + np.arange(len(here)) - run[part[here]]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        deep = np.repeat(deep, 3)
        deep[1::3] += 1
        ended = np.zeros(len(new), bool)
        ended[1::3] = pivot == END
        whole = (deep == deepest) & ~ended & (new > 0)
        ready.append(moved[np.repeat(whole, new)])
        ready_sizes.append(new[whole])
        go = (deep < deepest) & ~ended & (new > 0)
        # a single pointer needs no more sorting, only its words up to the depth
        alone = go & (new == 1)
        single, at = moved[begin[alone]], deep[alone]
        lasting = np.ones(len(single), bool)
        for d in range(depth, deepest):
            lasting &= (ids[single + d] != END) | (d < at)
        ready.append(single[lasting])
        ready_sizes.append(np.ones(int(lasting.sum()), np.int64))
        go &= ~alone
        pointers, sizes, deep = moved[np.repeat(go, new)], new[go], deep[go]
    return np.concatenate(ready), np.concatenate(ready_sizes)


def counted(
    ids: np.ndarray, own: int, names: list[bytes], lang: bytes, sieves: list[np.ndarray]
) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases of ``len(sieves) + 1`` words that begin at the first ``own`` of the ids, and their counts; for words also
    how many there are in all, under the empty phrase. The language stands before each phrase, in a line of its own."""
    sizes = np.bincount(ids if sieves else ids[:own], minlength=len(names))
    sizes[[END, NONE]] = 0
    here = np.flatnonzero(sizes)
    lead = lang + b"\n"
    if not sieves:
        yield [lead, *[lead + names[i] for i in here]], np.append(sizes.sum(), sizes[here])
        return

    hashes = np.zeros(len(names), np.uint64)
    hashes[here] = [xxhash.xxh64_intdigest(lead + names[i], 42) for i in here]
    known = np.zeros(len(names), bool)
    known[here] = passes(sieves[0], hashes[here])
    good = known[ids]
    deepest = len(sieves) + 1
    ids = np.append(ids, np.zeros(deepest, ids.dtype))
    good = np.append(good, np.zeros(deepest, bool))
    pointers = np.flatnonzero(good[:-1] & good[1:]).astype(np.int32)
    pointers = pointers[pointers < own + deepest - 2]
    sizes = np.array([len(pointers)] if len(pointers) else [], np.int64)
    for words in range(2, deepest):
        pointers, sizes = quicksort(ids, pointers, sizes, words - 1 if words > 2 else 0, words)
        first = pointers[np.cumsum(sizes) - sizes]
        h = hashes[ids[first]]
        for d in range(1, words):
            h = (h << np.uint64(1) | h >> np.uint64(63)) ^ hashes[ids[first + d]]
        go = np.repeat(passes(sieves[words - 1], h), sizes)
        good = np.zeros(len(ids), bool)
        good[pointers[go]] = True
        # the longer phrase has to end in frequent words as well
        go &= good[pointers + 1] & (pointers < own + deepest - words - 1)
        part = np.repeat(np.arange(len(sizes)), sizes)[go]
        pointers, sizes = pointers[go], np.bincount(part, minlength=len(sizes))
        sizes = sizes[sizes > 0]
    pointers, sizes = quicksort(ids, pointers, sizes, deepest - 1 if deepest > 2 else 0, deepest)
    first = pointers[np.cumsum(sizes) - sizes]
    heads = [lead + n for n in names]
    for at in range(0, len(first), GIVEN):
        some = first[at : at + GIVEN]
        columns = [map((names if d else heads).__getitem__, ids[some + d].tolist()) for d in range(deepest)]
        yield list(map(b" ".join, zip(*columns, strict=True))), sizes[at : at + GIVEN]


def phrase_hash() -> Column:
    """The hash of a phrase in the tasks: those of its words with their language, rotated and mixed."""
    words = F.transform(F.split("phrase", " ", -1), lambda w: F.xxhash64(F.concat("lang", F.lit("\n"), w)))
    return F.reduce(F.slice(words, 2, 1 << 20), words[0], lambda h, w: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)).bitwiseXOR(w))


def local_counts(texts: DataFrame, sieves: list[np.ndarray]) -> DataFrame:
    """key (language, line feed, phrase), n: counts by task of phrases of ``len(sieves) + 1`` words."""
    sent = texts.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, folded in held.items():
                for own, beyond in blocks(folded, len(sent.value)):
                    ids, n_own, names = numbered(own, beyond)
                    for phrases, n in counted(ids, n_own, names, lang.encode(), sent.value):
                        keys = pa.array(phrases, pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64())], ["key", "n"])
            held.clear()

        for part, data, off in chunks(batches):
            raw = data.tobytes().translate(FOLD)
            for i, lang in enumerate(part.column(part.schema.get_field_index("lang")).to_pylist()):
                held[lang].append(raw[off[i] : off[i + 1]])
            size += len(raw)
            if size >= BLOCK:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, COUNTED)


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """lang, phrase, f of all phrases of one word, two words ... that occur ``least`` times; with the words also one row
    for each language whose phrase is null: all of its words."""
    python_tasks(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    out: list[DataFrame] = []
    sieves: list[np.ndarray] = []
    for size in range(1, words + 1):
        total = local_counts(texts, sieves).groupBy("key").agg(F.sum("n").alias("f")).withColumn("phrase", F.substring_index("key", "\n", -1))
        total = total.filter((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("lang", F.expr("left(key, char_length(key) - char_length(phrase) - 1)"))
        out.append(stored(total.select("lang", F.nullif("phrase", F.lit("")).alias("phrase"), "f"), f"phrases{size}"))
        if size < words:
            sieves.append(sieve(out[-1].filter("phrase is not null").select(phrase_hash().alias("h")), "h"))
    return out


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    levels = phrase_counts(docs, words, least)
    totals = levels[0].filter("phrase is null").select("lang", F.col("f").alias("n"))
    levels[0] = levels[0].filter("phrase is not null")
    parts, longer = levels[0], None
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    tokens = F.split("phrase", " ", -1)
    sized = found.select("lang", "phrase", F.col("f").alias("a"), tokens.alias("w"), F.size(tokens).alias("size"))

    def slices(size: int) -> Column:
        return F.expr(f"transform(sequence(1, size - {size} + 1), i -> array_join(slice(w, i, {size}), ' '))")

    # dropped: phrases within a longer one that holds enough of their occurrences
    for size in range(2, words):
        inner = sized.filter(F.col("size") > size).select("lang", F.explode(slices(size)).alias("phrase"), "a")
        longer = inner if longer is None else longer.unionByName(inner)
    if longer is not None:
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
        sized = sized.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"within is null or 100 * within < {covered} * a"))

    cuts = F.explode(
        F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') as head, array_join(slice(w, k + 1, size - k), ' ') as tail))")
    ).alias("cut")
    cut = sized.select("lang", "phrase", "a", cuts).select("lang", "phrase", "a", "cut.*")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = {c: f"cast({c} as decimal(19,0))" for c in "alr"}
    score = F.expr(f"cast(({wide['a']} * {wide['a']} * cast(1000000 as decimal(7,0))) div ({wide['l']} * {wide['r']}) as long)")
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return salted.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first 2000 phrases."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with words as (
    select lang, doc_id, piece, i, w from (
        select lang, doc_id, piece, generate_subscripts(ws, 1) as i, unnest(ws) as w from (
            select lang, doc_id, piece, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as ws from (
                select lang, doc_id, generate_subscripts(ps, 1) as piece, unnest(ps) as p from (
                    select coalesce(lang, 'und') as lang, row_number() over () as doc_id, string_split_regex(
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps
                    from documents))))),
next as (
    select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by doc_id, piece order by i)),
f as (
    select lang, w1 as phrase, count(*) as f from next group by all
    union all select lang, w1 || ' ' || w2, count(*) from next where w2 is not null group by all
    union all select lang, w1 || ' ' || w2 || ' ' || w3, count(*) from next where w3 is not null group by all),
candidates as (
    select lang, phrase, f as a, string_split(phrase, ' ') as w from f where f >= 10 and contains(phrase, ' ')),
kept as (
    select * from candidates c where len(w) = 3 or not exists (
        select 1 from candidates d where d.lang = c.lang and len(d.w) = 3 and 100 * d.a >= 50 * c.a
            and (d.w[1] || ' ' || d.w[2] = c.phrase or d.w[2] || ' ' || d.w[3] = c.phrase))),
cuts as (
    select lang, phrase, a, 1 as k, w[1] as head, array_to_string(w[2:], ' ') as tail from kept
    union all select lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] from kept where len(w) = 3),
scored as (
    select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail),
worst as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
totals as (select lang, count(*) as n from words group by lang)
select lang, rank, phrase, a, l, r, n, score from (
    select worst.*, row_number() over (partition by worst.lang order by score desc, a desc, encode(phrase)) as rank from worst)
join totals using (lang) where rank <= 2000
"""
