"""Documents from aggregates, their vectors, and two-stage retrieval for a batch of questions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dollars, fill, fixed2
from ..operators.lookup import small_side
from ..operators.ranking import top_per_group
from ..operators.report import stack
from ..sources.store import work_dir, write_files
from . import kpi
from .enrich import Generator, prompt, with_text
from .star import Star

WIDTH = 1 << 20
CANDIDATES = 15
KEPT = 5
QUERIES_PER_BLOCK, CORPUS_BLOCK = 1_000, 4_096
#: Documents in a block of the inverted index.
DOCUMENT_BLOCK = 4_096
DIGITS, SCALE = 6, 10**12
TERM_SATURATION = 1.2
LENGTH_WEIGHT = 0.75

TEMPLATES = {
    "slow_product": (
        "[SLOW-MOVING PRODUCT] Product: {product}. Category: {category}. Region: {region}. Status: {status}. "
        "Orders: {orders}. Total sales: {sales}."
    ),
    "vendor": (
        "[VENDOR PERFORMANCE] Vendor: {vendor}. Returns: {returns}. Return value: {value}. "
        "Average return ratio: {ratio}. Rank {rank} by return ratio; rank 1 performs worst."
    ),
    "category": (
        "[CATEGORY SALES BY REGION] Region: {region}. Category: {category}. Orders: {orders}. Revenue: {revenue}. "
        "Average order value: {average}."
    ),
    "high_return_product": (
        "[HIGH RETURN PRODUCT] Product: {product}. Category: {category}. Returns: {returns}. Return value: {value}. "
        "Average return ratio: {ratio}. Rank {rank} by return value."
    ),
}


def documents(star: Star) -> DataFrame:
    """(doc_id, kind, text): one text per aggregate row; the id is a digest of the text."""
    parts = []
    for kind, rows, values in [
        (
            "slow_product",
            kpi.slow_products_by_region(star),
            {"product": F.col("product_name"), "category": F.col("category"), "region": F.col("region_name"),
             "status": F.col("movement_status"), "orders": F.col("order_count"), "sales": dollars("total_sales")},
        ),
        (
            "vendor",
            kpi.ranked_vendors(star),
            {"vendor": F.col("vendor_name"), "returns": F.col("total_returns"), "value": dollars("total_return_value"),
             "ratio": fixed2("avg_return_ratio"), "rank": F.col("vendor_rank")},
        ),
        (
            "category",
            kpi.top_categories_by_region(star),
            {"region": F.col("region_name"), "category": F.col("category"), "orders": F.col("total_orders"),
             "revenue": dollars("total_revenue"), "average": dollars("avg_order_value")},
        ),
        (
            "high_return_product",
            kpi.ranked_return_products(star),
            {"product": F.col("product_name"), "category": F.col("category"), "returns": F.col("return_count"),
             "value": dollars("total_return_value"), "ratio": fixed2("avg_return_ratio"), "rank": F.col("product_rank")},
        ),
    ]:
        text = fill(TEMPLATES[kind], **values)
        parts.append(rows.select(F.md5(text).alias("doc_id"), F.lit(kind).alias("kind"), text.alias("text")))
    return stack(parts)


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


#: Questions to try the documents with; any list of texts does.
QUESTIONS = [
    "vendors by value of returned goods",
    "vendor with many returns and a high ratio",
    "slow products of the Central region",
    "slow movement status of products in the West region",
    "category sales and orders in the Central region",
    "category with most orders in the East region",
    "product returned most often",
    "high return product of the Women category",
    "average return ratio of vendors",
]


def questions(spark: SparkSession, texts: list[str] | None = None) -> DataFrame:
    rows = list(enumerate(texts or QUESTIONS, 1))
    return spark.createDataFrame(rows, "question_id int, question string")


def slot(word: Column, width: int = WIDTH) -> Column:
    """A word's place in the vectors, by a digest that other engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(width))


def slot_counts(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, slot, tf): words counted by slot. Figures tell nothing about the subject and would dominate by their rarity."""
    subject = F.filter(words(text), lambda w: ~w.rlike("^[0-9]+$"))
    return df.select(key, F.explode(subject).alias("_w")).groupBy(key, slot(F.col("_w"), width).alias("slot")).agg(F.count(F.lit(1)).alias("tf"))


def sparse_vectors(counts: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """(key, vector): slots and tf-idf weights in order of slots, of unit length. Slots that all documents or none have
    weigh nothing and are left out."""
    rows = counts.join(dictionary.filter("idf > 0"), "slot").withColumn("w", F.col("tf") * F.col("idf"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x["w"] * x["w"]))
    return listed.withColumn("norm", norm).select(
        key, F.transform("v", lambda x: F.struct(x["slot"].alias("slot"), (x["w"] / F.col("norm")).alias("weight"))).alias("vector")
    )


@dataclass(frozen=True)
class Index:
    """An inverted index by blocks of documents: (slot, block, places, weights), where the documents of a block that have the
    slot stand in it and their weights; (block, ids), a block's documents in order of ids; and (slot, df, idf)."""

    postings: DataFrame
    blocks: DataFrame
    dictionary: DataFrame
    width: int


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, parts): texts cut at what is no letter or digit."""
    return docs.select("doc_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("parts"))


def _counter(width: int):
    # nested, so that tasks need no installed copy of this package
    def counted(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and tf, in order of rows and slots: the words of ``slot_counts``."""
        rows = np.repeat(np.arange(len(parts)), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = parts.flatten().dictionary_encode()
        found = coded.dictionary.to_pylist()
        slots = [-1 if w == "" or w.isdigit() else int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width for w in found]
        slot = np.array(slots, np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        order = np.lexsort((slot, rows))
        rows, slot = rows[order], slot[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (slot[1:] != slot[:-1])])) if len(rows) else np.zeros(0, np.int64)
        return rows[first], slot[first], np.diff(np.append(first, len(rows)))

    return counted


def dictionary_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(slot, df, idf) over all documents, with distinct ids. Tasks add up a batch before anything is shuffled."""
    counted = _counter(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, df = np.unique(counted(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(df)], ["slot", "df"])

    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    seen = _parts(docs).select("parts").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    # the total is one row
    return seen.join(F.broadcast(total), F.lit(True)).select("slot", "df", F.ln((F.col("docs") + 1) / (F.col("df") + 1)).alias("idf"))


def _weigher(dictionary: DataFrame, width: int):
    """Row, slot and weight of documents' vectors, as in ``sparse_vectors``. Vectors are made where the text is, row by row,
    so no task holds more than a batch; the slots that weigh something, at most ``width``, are sent to the tasks."""
    rows = dictionary.filter("idf > 0").select("slot", "idf").toPandas().sort_values("slot")
    sent = dictionary.sparkSession.sparkContext.broadcast((rows["slot"].to_numpy(np.int64), rows["idf"].to_numpy(np.float64)))
    counted = _counter(width)

    def weighed(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots, idf = sent.value
        row, slot, tf = counted(parts)
        at = np.searchsorted(slots, slot)
        some = at < len(slots)
        some[some] = slots[at[some]] == slot[some]
        row, slot = row[some], slot[some]
        w = tf[some] * idf[at[some]]
        # adds up in order of slots
        norm = np.sqrt(np.bincount(row, w * w, len(parts)))
        return row, slot, w / norm[row]

    return weighed


def build_index(docs: DataFrame, width: int = WIDTH) -> Index:
    """Index of documents with distinct ids, stored block by block. A block's lists are in order of slots."""
    spark = docs.sparkSession
    dictionary = write_files(dictionary_of(docs, width), work_dir(spark, "dictionary"))
    weighed, size = _weigher(dictionary, width), DOCUMENT_BLOCK
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                some = some.take(pc.array_sort_indices(some.column(0), null_placement="at_start"))
                row, slot, weight = weighed(some.column(1))
                order = np.argsort(slot, kind="stable")
                slots, first = np.unique(slot[order], return_index=True)
                edges = pa.array(np.append(first, len(order)), pa.int32())
                places = pa.ListArray.from_arrays(edges, pa.array(row[order].astype(np.int32)))
                weights = pa.ListArray.from_arrays(edges, pa.array(weight[order]))
                ids = some.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(np.full(len(slots), block)), places, weights, pa.nulls(len(slots), pa.list_(ids.type))], names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.array([block]), pa.nulls(1, places.type), pa.nulls(1, weights.type), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                    names,
                )
                block += 1

    names = ["slot", "block", "places", "weights", "ids"]
    made = _parts(docs).mapInArrow(run, f"slot long, block long, places array<int>, weights array<double>, ids array<{id_type}>")
    kept = write_files(made, work_dir(spark, "index"))
    return Index(kept.filter("slot is not null").drop("ids"), kept.filter("slot is null").select("block", "ids"), dictionary, width)


def search(index: Index, asked: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(question_id, doc_id, distance, rank): the documents nearest to each question by squared distance of unit vectors,
    among those that share a word with it. ``asked`` has question_id and question.

    The words of a question meet their lists, a block of documents at a time; products of weights are added up there, and
    ``k`` documents per question leave a block. Products are whole numbers of 1e-12, so sums do not depend on their order.
    """
    counts = slot_counts(asked, "question_id", "question", index.width)
    terms = sparse_vectors(counts, "question_id", index.dictionary).select("question_id", F.inline("vector")).withColumnRenamed("weight", "asked_weight")
    terms = small_side(write_files(terms, work_dir(asked.sparkSession, "question_terms")))
    hits = index.postings.join(terms, "slot").select("question_id", "block", "places", "weights", "asked_weight")
    question_type = asked.schema["question_id"].dataType.simpleString()

    def best(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        dot = np.zeros(1 + max(p[-1] for p in lists["places"]), np.int64)
        met = np.zeros(len(dot), bool)
        for places, weights, asked_weight in zip(lists["places"], lists["weights"], lists["asked_weight"], strict=True):
            dot[places] += np.floor(weights * asked_weight * SCALE).astype(np.int64)
            met[places] = True
        place = np.flatnonzero(met)
        # 2 - 2 dot, rounded to six digits
        far = (2 * SCALE - 2 * dot[place] + unit // 2) // unit
        # places are in order of ids
        first = np.lexsort((place, far))[:k]
        return pd.DataFrame({"question_id": [key[0]] * len(first), "block": key[1], "place": place[first], "far": far[first]})

    unit = SCALE // 10**DIGITS
    found = hits.groupBy("question_id", "block").applyInPandas(best, f"question_id {question_type}, block long, place int, far long")
    near = found.join(index.blocks, "block").select("question_id", F.col("ids")[F.col("place")].alias("doc_id"), (F.col("far") / 10**DIGITS).alias("distance"))
    return top_per_group(near, ["question_id"], [F.col("distance"), F.col("doc_id")], k)


def vectors(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, kind, dimensions, nonzero, norm) of the document vectors."""
    once = write_files(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), work_dir(docs.sparkSession, "once"))
    weighed = _weigher(write_files(dictionary_of(once, width), work_dir(docs.sparkSession, "dictionary")), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, weight = weighed(batch.column(1))
            nonzero = np.bincount(row, minlength=batch.num_rows)
            norm = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nonzero.astype(np.int32)), pa.array(norm)], ["doc_id", "nonzero", "norm"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = _parts(once).mapInArrow(run, f"doc_id {id_type}, nonzero int, norm double").select("doc_id", "nonzero", F.round("norm", 4).alias("norm"))
    return docs.join(shape, "doc_id", "left").select(
        "doc_id", "kind", F.lit(width).alias("dimensions"), F.coalesce("nonzero", F.lit(0)).alias("nonzero"), F.coalesce("norm", F.lit(0.0)).alias("norm")
    )


def label_queries(embeddings: DataFrame) -> DataFrame:
    """(query_id, vector): the first vector of every label."""
    first = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.col("label").alias("query_id"), "vector")


def nearest(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, distance, rank): exact squared-L2 nearest ``k`` per query. Null vectors take no part.

    Vectors of either side are packed into blocks, and each block of queries meets each block of the corpus in a join; one
    matrix product gives all distances of the two, and ``k`` rows per query leave it. Query blocks are dealt to as many
    parts as the corpus, so the join spreads over all tasks; Spark broadcasts them where they are small. The corpus is
    read once, however many queries there are, and no query is in the driver.
    """
    spark = corpus.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((corpus, "doc_id"), (queries, "query_id")))
    whole = corpus.filter("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    packed = whole.mapInPandas(_pack("doc_id", CORPUS_BLOCK), f"ids array<{id_type}>, vectors binary")
    packed = packed.withColumn("part", F.pmod(F.xxhash64("vectors"), F.lit(parts)))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.filter("vector is not null").select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.struct("query_id", F.col("vector").cast("array<double>").alias("vector")).alias("q")
    )
    asked = asked.groupBy("block").agg(F.collect_list("q").alias("asked"))
    asked = asked.select("block", F.col("asked.query_id").alias("query_ids"), F.col("asked.vector").alias("wanted"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = packed.join(asked, ["block", "part"]).select("ids", "vectors", "query_ids", "wanted")
    local = met.mapInPandas(_block_nearest(k, DIGITS), f"query_id {query_type}, doc_id {id_type}, distance double")
    return top_per_group(local, ["query_id"], [F.col("distance"), F.col("doc_id")], k)


def _pack(key: str, size: int):
    # nested, so that tasks need no installed copy of this package
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                some = pdf.iloc[at : at + size]
                yield pd.DataFrame({"ids": [some[key].to_numpy()], "vectors": [np.stack(some["vector"].to_numpy()).astype(np.float64).tobytes()]})

    return run


def _block_nearest(k: int, digits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, packed, query_ids, wanted in zip(pdf["ids"], pdf["vectors"], pdf["query_ids"], pdf["wanted"], strict=True):
                docs = np.frombuffer(packed, np.float64).reshape(len(ids), -1)
                asked = np.stack(list(wanted)).astype(np.float64)
                rough = (asked * asked).sum(axis=1)[:, None] + (docs * docs).sum(axis=1) - 2 * asked @ docs.T
                most = min(k, len(ids))
                # what rounding could bring among the first k stays
                slack = 2 * 10.0**-digits + 1e-9 * np.abs(rough).max()
                limit = np.partition(rough, most - 1, axis=1)[:, most - 1] + slack
                q, d = np.nonzero(rough <= limit[:, None])
                # the same additions in the same order as a plain sum
                exact = np.round(np.add.accumulate(np.square(docs[d] - asked[q]), axis=1)[:, -1], digits)
                found = pd.DataFrame({"q": q, "query_id": np.asarray(query_ids)[q], "doc_id": np.asarray(ids)[d], "distance": exact})
                found = found.sort_values(["q", "distance", "doc_id"])
                yield found[found.groupby("q").cumcount() < k][["query_id", "doc_id", "distance"]]

    return run


def rerank(candidates: DataFrame, docs: DataFrame, asked: DataFrame, k: int = KEPT) -> DataFrame:
    """(question_id, doc_id, score, rank): BM25 of the question's words over its few candidates.

    ``candidates`` is (question_id, doc_id). Document frequencies are counted
    over the whole corpus, for the words of the questions only.
    """
    tokens = docs.select("doc_id", words("text").alias("tokens"))
    terms = small_side(asked.select("question_id", F.explode(F.array_distinct(words("question"))).alias("term")))
    corpus = tokens.agg(F.count(F.lit(1)).alias("docs"), (F.sum(F.size("tokens")) / F.count(F.lit(1))).alias("usual_length"))
    # every document has the usual words of a question, so its words meet the few terms where they are
    wanted = small_side(terms.select("term").distinct())
    seen = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    few = small_side(candidates.select("question_id", "doc_id").distinct())
    found = docs.select("doc_id", "text").join(few, "doc_id").select("question_id", "doc_id", words("text").alias("tokens"))
    # the corpus figures are one row
    pairs = found.join(terms, "question_id").join(seen, "term")
    pairs = pairs.join(F.broadcast(corpus), F.lit(True))
    tf = F.size(F.filter("tokens", lambda t: t == F.col("term")))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.size("tokens") / F.col("usual_length")
    weight = idf * tf * (TERM_SATURATION + 1) / (tf + TERM_SATURATION * length)
    # a question has few words, so its sum is taken in word order
    per_pair = pairs.groupBy("question_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("term", F.when(tf > 0, weight).otherwise(0.0).alias("w")))).alias("ws")
    )
    scored = per_pair.select(
        "question_id", "doc_id", F.round(F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"]), DIGITS).alias("score")
    )
    return top_per_group(scored, ["question_id"], [F.desc("score"), F.asc("doc_id")], k)


def retrieve(docs: DataFrame, asked: DataFrame, candidates: int = CANDIDATES, k: int = KEPT) -> DataFrame:
    """Both stages for all questions at once: nearest vectors by the inverted index, then the rerank."""
    # equal texts have one id; copies would use up candidates and count their terms twice
    spark = docs.sparkSession
    docs = write_files(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), work_dir(spark, "once"))
    near = write_files(search(build_index(docs), asked, candidates).select("question_id", "doc_id"), work_dir(spark, "candidates"))
    return rerank(near, docs, asked, k)


def answers(docs: DataFrame, asked: DataFrame, generate: Generator | None = None) -> DataFrame:
    """(question_id, question, answer, retrieved_docs): the kept documents, best first, and a text about them."""
    best = small_side(write_files(retrieve(docs, asked), work_dir(docs.sparkSession, "kept")))
    kept = docs.select("doc_id", "text").join(best, "doc_id").dropDuplicates(["question_id", "doc_id"])
    # at most KEPT documents per question
    listed = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    rows = asked.join(listed, "question_id").select(
        "question_id", "question", F.array_join(F.col("found.text"), "\n").alias("retrieved_docs"), F.col("found")[0]["text"].alias("_best")
    )
    asked_prompt = prompt("answer", docs=F.col("retrieved_docs"), question=F.col("question"))
    told = fill("Best match: {best}", best=F.col("_best"))
    return with_text(rows, "answer", asked_prompt, told, generate).select("question_id", "question", "answer", "retrieved_docs")
