"""Spelling variants: words that differ by one letter, found by search schemes in a bidirectional FM-index.

A word is cut behind half of its letters. Of a word that differs by one inserted, deleted or replaced letter, either the
left half is the beginning or the right half is the end (pigeonhole). So each word is routed to the tasks of the two
halves that it may share with a word of its own length or one more or less. A task indexes its words (see ``fm_index``)
and searches: a half matched exactly, the other one with one error. Each pair is found by the left half if it shares
that, else by the right half, so it counts once.

Runs of letters are counted in the tasks before anything is shuffled, and the halves of a large vocabulary spread over
many tasks. A half that more than ``GROUP`` words share is dealt to several tasks by a hash of the word, and its
searches go to all of these; near words are counted where they are found and added up. Following forms to their root
takes a few joins, as each form is at least ``RATIO`` times as frequent as its word.

Null texts have no words; a null id is hashed as an empty text. Repeated rows count again. Texts are read whole, in slices
that end between words. Words of equal count are told apart by code points. Other columns are never read; an empty table,
or one without words, gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER
from .common import python_tasks, stored, table
from .fm_index import Vocabulary

#: Letters of a word, occurrences of a word, and how many times as frequent a form is.
LETTERS, LEAST, RATIO = 6, 5, 5
#: A run loses a letter where this divides its hash.
LOSES = 199
#: Routed words of a task, and words that share a half in one task.
TASK, GROUP = 60_000, 50_000
#: Code points of a text that are split at once, and distinct words that a task holds.
SLICE, HELD = 1 << 21, 400_000
RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
NO_LETTER = re.compile("[^a-zÀ-ÿ]")
FOUND = "word string, n_near long, form_n long, form string"


def runs(text: str) -> Iterator[list[str]]:
    """Runs of enough letters, slice by slice."""
    low = text.encode().translate(LOWER.tobytes()).decode()
    at = 0
    while at < len(low):
        cut = NO_LETTER.search(low, at + SLICE)
        end = cut.start() if cut else len(low)
        yield RUN.findall(low, at, end)
        at = end


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n of the words that occur ``least`` times; runs lose a letter by the hash of their document and letters."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for found in runs(text.as_py()):
                    for letters, n in Counter(found).items():
                        h = zlib.crc32(letters.encode(), seed)
                        if h % LOSES:
                            held[letters] += n
                        elif len(letters) > LETTERS:
                            i = h % len(letters)
                            held[letters[:i] + letters[i + 1 :]] += n
                    if len(held) > HELD:
                        yield flush()
        yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def routed(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, half, left, target, query: each word under the halves it is found by, and the two it searches with.

    A half of more than ``group`` words is split: a word is a target in one part and searches in all."""
    size = "char_length(word)"
    ends = F.expr(
        f"""array(
        struct(true as left, ({size} - 1) div 2 as letters, {size} div 2 as own),
        struct(true as left, ({size} - 1) div 2 + 1 as letters, {size} div 2 as own),
        struct(false as left, {size} div 2 as letters, {size} - {size} div 2 as own),
        struct(false as left, {size} div 2 + 1 as letters, {size} - {size} div 2 as own))"""
    )
    each = words.select("word", "n", F.explode(ends).alias("e")).select(
        "word",
        "n",
        "e.left",
        F.expr("if(e.left, left(word, int(e.letters)), right(word, int(e.letters)))").alias("half"),
        F.expr("e.letters = e.own").alias("query"),
    )
    # few: no more than the routed words divided by the group size
    many = each.groupBy("left", "half").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group)
    many = many.select("left", "half", F.ceil(F.col("size") / group).alias("parts"))
    dealt = each.join(F.broadcast(many), ["left", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.expr("pmod(xxhash64(word), parts)")
    parts = F.explode(F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own)))
    return dealt.withColumn("own", own).withColumn("part", parts).select(
        "word", "n", F.concat_ws(":", F.when(F.col("left"), "<").otherwise(">"), "part", "half").alias("half"), "left",
        (F.col("part") == F.col("own")).alias("target"), "query",
    )


def found_near(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of the queries of one task: word, n_near, and the most frequent near word."""
    targets = rows[rows["target"]]
    names = sorted(targets["word"].unique())
    n = targets.drop_duplicates("word").set_index("word")["n"].reindex(names).to_numpy(np.int64)
    number = pd.Series(np.arange(len(names)), index=pd.Index(names, dtype=object))
    half, halves = pd.factorize(rows["half"])
    # where a word is a target: pairs of half and word
    there = np.unique(half[rows["target"].to_numpy()] * len(names) + number[targets["word"]].to_numpy())
    # a query of a split half may stand where its word is no target: it needs a place in the index to be read from
    asked = rows["query"].to_numpy()
    guests = sorted(set(rows.loc[asked, "word"]) - set(names))
    every = names + guests
    number = pd.Series(np.arange(len(every)), index=pd.Index(every, dtype=object))
    index = Vocabulary(every)
    out = []
    for left in (True, False):
        here = np.flatnonzero(asked & (rows["left"].to_numpy() == left))
        which = number[rows["word"].iloc[here]].to_numpy(np.int64)
        query, word = index.near(which, left)
        own = word < len(names)
        query, word = query[own], word[own]
        pair = half[here[query]] * len(names) + word
        real = there[np.minimum(np.searchsorted(there, pair), len(there) - 1)] == pair if len(there) else np.zeros(0, bool)
        query, word = query[real], word[real]
        if not left:
            # those that share the left half are found there
            apart = [not every[v].startswith(every[w][: len(every[w]) // 2]) for w, v in zip(which[query], word, strict=True)]
            query, word = query[np.array(apart, bool)], word[np.array(apart, bool)]
        out.append(pd.DataFrame({"w": which[query], "v": word}, dtype=np.int64))
    pairs = pd.concat(out, ignore_index=True)
    pairs["n"] = n[pairs["v"].to_numpy()]
    # words are numbered in code-point order
    best = pairs.sort_values(["w", "n", "v"], ascending=[True, False, True]).groupby("w").agg(n_near=("v", "size"), form_n=("n", "first"), v=("v", "first"))
    return pd.DataFrame(
        {
            "word": [every[w] for w in best.index],
            "n_near": best["n_near"].to_numpy(np.int64),
            "form_n": best["form_n"].to_numpy(np.int64),
            "form": [every[v] for v in best["v"]],
        }
    )


def near_words(words: DataFrame, group: int = GROUP, task: int = TASK) -> DataFrame:
    """word, n_near, form_n, form (most frequent near word, the first of equal ones) of words that have near words.
    ``words``: distinct words of two code points or more, and their counts n."""
    spark = words.sparkSession
    python_tasks(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // task))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            found = found_near(pd.concat(rows, ignore_index=True))
            if len(found):
                yield found

    found = routed(words, group).repartition(tasks, "half").mapInPandas(run, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"
    )


def roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, root: the last of a word's chain of forms. A chain at least multiplies n by ``ratio`` with each step, so its
    length is bounded by the largest n, and each round of joins doubles the steps taken."""
    most = forms.agg(F.max("form_n")).first()[0]
    chain = forms.select("word", F.col("form").alias("root"))
    if most is None:
        return chain
    for i in range(math.ceil(math.log2(max(1, math.log(most, ratio)) + 1))):
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = stored(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{i}")
    return chain


def variants(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(word_counts(docs, least), "words")
    near = stored(near_words(words), "near_words")
    joined = words.join(near, "word", "left").withColumn("taken", F.expr(f"coalesce(form_n >= {ratio} * n, false)"))
    joined = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), F.col("form")).alias("form"),
            F.when(F.col("taken"), F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(joined.filter("form is not null"), ratio)
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents."""
    return variants(table(spark, sf_dir, "documents"))


#: The hash's table by its rule, and UTF-8 bytes of code points below U+0100; near words share a form with one letter less.
OP12_SQL = r"""
with recursive crc_table as (
    select list(list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i::bigint) order by i) as t
    from range(0, 256) as r(i)),
runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
    from documents),
counted as (select id, run, count(*) as n from runs where length(run) >= 6 group by all),
hashed as (
    select run, n, xor(list_reduce(flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [(192 + ord(c) // 64)::bigint, (128 + ord(c) % 64)::bigint] end)),
        lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1]), 4294967295::bigint), 4294967295) as h
    from counted, crc_table),
words as (
    select word, sum(n)::bigint as n, length(word) as size from (
        select case when h % 199 = 0 then run[1:(h % length(run))] || run[(h % length(run) + 2):] else run end as word, n from hashed)
    where length(word) >= 6 group by word having sum(n) >= 5),
shorter as (select distinct word, n, i, word[1:(i - 1)] || word[(i + 1):] as less from (select *, unnest(range(1, size + 1)) as i from words)),
pairs as (
    select a.word, b.word as other, b.n as other_n from shorter a join shorter b on a.less = b.less and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from shorter a join words b on a.less = b.word
    union select b.word, a.word, a.n from shorter a join words b on a.less = b.word),
best as (
    select word, count(*) over (partition by word) as n_near, other, other_n from pairs
    qualify row_number() over (partition by word order by other_n desc, encode(other)) = 1),
forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n
    from words left join best using (word)),
chain as (
    select word, word as root, 0 as step from forms
    union all select c.word, f.form, c.step + 1 from chain c join forms f on f.word = c.root where f.form is not null)
select forms.word, form, root, n, n_near, form_n
from forms join (select word, arg_max(root, step) as root from chain group by word) using (word)
"""
