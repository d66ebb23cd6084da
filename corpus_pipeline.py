"""A training corpus from raw documents: five stages, each written and read again as the next one's input.

Rows with null texts count as empty ones. Repeated rows are rows of their own until the join, which keeps one of each
group. Documents without words are in a group by themselves. Clashing column names of other tables never meet the
documents; columns beyond those of the documents table are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, jaccard, packing, pii, quality
from tallyhouse.llm.common import DOCUMENT, remove, row_key, scratch, stored, table, with_text


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says label 1."""
    texts = with_text(docs)
    model = quality.fit(texts, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(*DOCUMENT).withColumn("text", F.coalesce("text", F.lit(""))), model, DOCUMENT)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 connect: the smallest doc_id,
    of equal ids the row with the smallest hash."""
    with scratch() as made:
        groups = jaccard.similar_documents(docs, 5, 80, count_links=False)
    row = F.struct("doc_id", "k1", "k2")
    # copies of one row share all of its keys, so the first of them in order of the other columns stays
    keep = stored(groups.filter("n_shingles > 0").groupBy("comp").agg(F.min(row).alias("row")).select("row.k1", "row.k2"), "keep")
    remove(spark, made)
    keyed = docs.select(*DOCUMENT).withColumn("text", F.coalesce("text", F.lit(""))).select("*", *row_key())
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # a third of the rows may be equal: each task keeps one of them before anything is shuffled
    first = F.min(F.struct("n_chars", "lang", "source", "doc_id", "text")).alias("row")
    one_each = keyed.filter(has_words).groupBy("k1", "k2").agg(first).join(keep, ["k1", "k2"], "leftsemi")
    return one_each.select(*[f"row.{c}" for c in DOCUMENT]).unionByName(keyed.filter(~has_words).select(*DOCUMENT))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and tagger decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
