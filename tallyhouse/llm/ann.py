"""Nearest vectors by multi-index hashing.

Vectors become 64-bit codes: the signs of a rotation that is learned (iterative quantisation) on a bounded sample. For
the inner product, vectors first get one more component that brings them all to the same length, which turns the
largest product into the smallest angle. A code is split into eight substrings of eight bits. If two codes differ in at
most r bits, they differ in at most r // 8 bits of some substring (pigeonhole), so looking up, for each substring, the
buckets that near a query's finds every code within r. Those are counted exactly, and the vectors within r are ranked
by their inner product in double precision.

The radius is the one that finds ``recall`` of the true neighbours within the sample. Neighbours only get closer as a
table grows, so it holds for the whole. Where fewer than k codes lie within it, it grows bit by bit.

Every vector is indexed, in blocks of ``block`` rows with tables of their own; every block of queries meets every block
of vectors in one task of bounded size, and leaves k rows per query. A bucket that a third of all vectors share is
spread over all blocks like any other.

Vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor as candidates;
shorter vectors count as padded with zeros. Rows with the query's own vec_id are not its candidates; a repeated row is a
candidate each time, and a query once. Rows without vec_id are candidates of all queries, listed last among ties. Ties go to the smaller
vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import python_tasks, stored, table

NEIGHBOURS = 20
#: Rows the rotation and the radius are fitted on.
SAMPLE = 10_000
#: Share of the true neighbours that the radius has to reach.
RECALL = 0.97
BLOCK = 8_192
BITS, PART = 64, 8
#: Bits in which two bytes differ.
DIFFERENT = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
FOUND = "query_id long, vec_id long, score double"


class Codes:
    """Learned binary codes of vectors of one length."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7, steps: int = 40):
        self.longest = longest
        x = self.level(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        d, rng = x.shape[1], np.random.default_rng(seed)
        axes = np.linalg.svd(x, full_matrices=False)[2].T if len(x) >= d else np.eye(d)
        axes = axes[:, : min(BITS, d)]
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        v = x @ axes
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        more = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-BITS // d))]
        self.project = np.hstack([axes @ turn, *more])[:, :BITS]

    def level(self, x: np.ndarray) -> np.ndarray:
        """One more component, so that all vectors are as long as the longest."""
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of eight bytes. A query points in its own direction only."""
        if query:
            x = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        else:
            x = self.level(x)
        return np.packbits((x - self.mean) @ self.project >= 0, axis=1)


class Index:
    """For each substring, the rows of each of its 256 values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.ends = [np.cumsum(np.bincount(c, minlength=256)) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        seen = np.zeros(len(self.codes), bool)
        for part, own in enumerate(code):
            ends = self.ends[part]
            near = np.flatnonzero(DIFFERENT[own] <= radius // PART)
            near = near[ends[near] > np.where(near > 0, ends[near - 1], 0)]
            for value in near:
                seen[self.rows[part][ends[value - 1] if value else 0 : ends[value]]] = True
        rows = np.flatnonzero(seen)
        apart = np.bitwise_count(self.codes[rows] ^ code).sum(1)
        return rows[apart <= radius]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the components."""
    return np.cumsum(x * q, axis=1)[:, -1]


def nearest(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best candidates; ``ids`` are sorted, so that ties go to the smaller one."""
    rough = x @ q
    rough[ids == own] = -np.inf
    some = np.flatnonzero(rough > -np.inf)
    if len(some) > k:
        bound = np.partition(rough[some], -k)[-k]
        some = some[rough[some] >= bound - 1e-9 * max(1.0, abs(bound))]
    score = products(x[some], q)
    order = np.argsort(-score, kind="stable")[:k]
    return some[order], score[order]


def radius_for(codes: Codes, sample: np.ndarray, recall: float, k: int, queries: int = 200) -> int:
    """The smallest radius within which lie ``recall`` of the k nearest sample vectors of some of them."""
    all_codes, q = codes.of(sample), sample[:queries]
    q_codes, apart = codes.of(q, query=True), []
    for i in range(len(q)):
        rows, _ = nearest(np.arange(len(sample)), sample, i, q[i], k)
        apart.append(np.bitwise_count(all_codes[rows] ^ q_codes[i]).sum(1))
    apart = np.concatenate(apart)
    return int(np.quantile(apart, recall, method="higher")) if len(apart) else BITS


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, codes: Codes, radius: int, k: int):
    """The k nearest of one block for each query of another."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    index, q_codes = Index(codes.of(x)), codes.of(q, query=True)
    out = []
    for own, vector, code in zip(query_ids, q, q_codes, strict=True):
        r, enough = radius, min(k, int((ids != own).sum()))
        rows = index.within(code, r)
        while (ids[rows] != own).sum() < enough:
            r += 1
            rows = index.within(code, r)
        best, score = nearest(ids[rows], x[rows], own, vector, k)
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows][best], "score": score}))
    return out


#: Stands for a missing id within a task; sorts last.
NO_ID = np.iinfo(np.int64).max


def usable(df: DataFrame) -> DataFrame:
    """Vectors that take part, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine)


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK, recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors``. Both have vec_id,
    embedding."""
    spark = vectors.sparkSession
    python_tasks(spark)
    x, q = stored(usable(vectors), "vectors"), stored(usable(queries).filter("vec_id is not null").distinct(), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    n, dim, longest = x.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    nq, q_dim = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(dim, q_dim)

    def matrix(values) -> np.ndarray:
        out = np.zeros((len(values), dim))
        for i, v in enumerate(values):
            out[i, : len(v)] = v
        return out

    sample = matrix([r[0] for r in x.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()])
    codes = Codes(sample, longest)
    radius = radius_for(codes, sample, recall, k)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = left["vec_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        found = search(
            ids, matrix(left["v"].to_numpy()), right["vec_id"].to_numpy(), matrix(right["v"].to_numpy()), codes, radius, k
        )
        out = pd.concat(found, ignore_index=True)
        out["vec_id"] = out["vec_id"].astype("Int64").mask(out["vec_id"] == NO_ID)
        return out

    x_blocks, q_blocks = -(-n // block), -(-nq // block)
    # blocks are equally large whatever the ids and vectors are
    number = F.monotonically_increasing_id()
    x = x.withColumn("xb", F.pmod(F.xxhash64(number), F.lit(x_blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    q = q.withColumn("qb", F.pmod(F.xxhash64(number), F.lit(q_blocks)).cast("int")).withColumn(
        "xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1)))
    )
    found = x.groupBy("xb", "qb").cogroup(q.groupBy("xb", "qb")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.filter("vec_id % 20 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
