"""Retrieval against brute force."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.plans import retrieval


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)).astype("float32")
    # a third of the corpus are exact copies of one vector
    base[::3] = base[0]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "doc_id long, vector array<float>").repartition(5)
    asked = rng.normal(size=(9, 12)).astype("float32")
    asked[0] = base[0]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)], "query_id int, vector array<float>")
    expected = []
    for q, v in enumerate(asked):
        dist = [(round(float(((v.astype("float64") - d.astype("float64")) ** 2).sum()), 6), i) for i, d in enumerate(base)]
        expected += [(q, i, rank) for rank, (_, i) in enumerate(sorted(dist)[:7], 1)]
    found = retrieval.nearest(docs, queries, 7).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found) == sorted(expected)
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 30)
    again = retrieval.nearest(docs, queries, 7).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in again) == sorted(expected)


def test_rerank_equals_brute_force(spark):
    texts = ["red shoe west region", "blue shoe blue shoe", "vendor returns west", "women shoe revenue in the west region west", "desk"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    asked = retrieval.questions(spark, ["Shoe revenue in the West region?", "blue vendor"])
    pairs = asked.select("question_id").crossJoin(docs.select("doc_id"))
    tokens = {f"d{i}": t.split() for i, t in enumerate(texts)}
    usual = sum(map(len, tokens.values())) / len(tokens)
    expected = []
    for qid, q in enumerate(["Shoe revenue in the West region?", "blue vendor"], 1):
        terms = sorted(set(re.findall(r"[a-z0-9]+", q.lower())))
        scores = []
        for d, words in tokens.items():
            s = 0.0
            for t in terms:
                df, tf = sum(t in w for w in tokens.values()), words.count(t)
                if df and tf:
                    s += math.log1p((len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / usual))
            scores.append((-round(s, 6), d))
        expected += [(qid, d, rank, -s) for rank, (s, d) in enumerate(sorted(scores)[:3], 1)]
    found = retrieval.rerank(pairs, docs, asked, 3).collect()
    assert sorted((r.question_id, r.doc_id, r["rank"], r.score) for r in found) == sorted(expected)


def test_questions_find_their_documents(spark, layers):
    docs = layers.documents
    asked = retrieval.questions(spark)
    found = retrieval.answers(docs, asked)
    rows = {r.question_id: r for r in found.collect()}
    assert len(rows) == len(retrieval.QUESTIONS) and all(r.answer and r.retrieved_docs for r in rows.values())
    assert "Central" in rows[5].retrieved_docs
    told = retrieval.answers(docs, asked, lambda prompts: prompts.str.slice(0, 6)).filter("question_id = 1").first()
    assert told.answer == "Answer"


def test_vectors_have_unit_length(layers):
    v = retrieval.vectors(layers.documents)
    assert v.filter(F.col("norm") != 1.0).count() == 0 and v.count() == layers.documents.count()


def test_copies_and_missing_queries_change_nothing(spark, layers):
    docs = layers.documents
    asked = retrieval.questions(spark, ["category sales in the Central region"])
    once = retrieval.retrieve(docs, asked).orderBy("rank").collect()
    assert retrieval.retrieve(docs.unionByName(docs), asked).orderBy("rank").collect() == once
    corpus = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, vector array<double>")
    none = spark.createDataFrame([], "query_id int, vector array<double>")
    assert retrieval.nearest(corpus, none).collect() == []


def test_index_search_equals_dense_vectors(spark):
    texts = ["red shoe west region", "blue shoe blue shoe 7", "vendor returns west", "women shoe revenue in the west region west", "desk", "", "12 34", "shoe"]
    docs = spark.createDataFrame([(f"d{i}", t, "k") for i, t in enumerate(texts)], "doc_id string, text string, kind string")
    asked = {1: "Shoe revenue in the West region?", 2: "blue vendor vendor", 3: "nothing known", 4: "9 9", 5: ""}
    frame = spark.createDataFrame(list(asked.items()), "question_id int, question string")
    split = {i: [w for w in re.findall("[a-z0-9]+", t.lower()) if not w.isdigit()] for i, t in enumerate(texts)}
    known = sorted({w for ws in split.values() for w in ws})
    idf = {w: math.log((len(texts) + 1) / (1 + sum(w in ws for ws in split.values()))) for w in known}

    def unit(ws):
        v = np.array([ws.count(w) * idf[w] for w in known])
        return v / (np.linalg.norm(v) or 1)

    want = []
    for q, text in asked.items():
        a = unit(re.findall("[a-z0-9]+", text.lower()))
        near = sorted((round(float(2 - 2 * a @ unit(ws)), 6), f"d{i}") for i, ws in split.items() if a @ unit(ws) > 0)
        want += [(q, d, rank, dist) for rank, (dist, d) in enumerate(near[:3], 1)]
    for width in (1 << 20, 1 << 40):
        index = retrieval.build_index(docs, width)
        got = retrieval.search(index, frame, 3).collect()
        assert sorted((r.question_id, r.doc_id, r["rank"], r.distance) for r in got) == sorted(want)
    plan = index.postings.filter("slot = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(slot), EqualTo(slot,5)]" in plan
    shapes = {r.doc_id: (r.nonzero, r.norm) for r in retrieval.vectors(docs.unionByName(docs)).collect()}
    assert shapes["d5"] == shapes["d6"] == (0, 0.0) and shapes["d1"] == (2, 1.0) and len(shapes) == len(texts)


def test_vectors_that_are_null_take_no_part(spark):
    docs = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [3.0, 1.0])], "doc_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id int, vector array<float>")
    assert [tuple(r) for r in retrieval.nearest(docs, asked, 5).orderBy("rank").collect()] == [(1, "a", 1.0, 1), (1, "c", 10.0, 2)]
    assert retrieval.nearest(docs.limit(0), asked).collect() == []


def test_index_has_a_list_for_each_slot_of_a_block(spark, monkeypatch):
    texts = [f"red shoe of the {'west' if i % 3 else 'east'} region {'blue ' * (i % 4)}" for i in range(40)] + ["desk"]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    asked = retrieval.questions(spark, ["blue shoe", "east region", "desk"])
    index = retrieval.build_index(docs)
    # red shoe of the west east region blue desk, however many documents have them
    assert index.postings.count() == 9
    found = retrieval.search(index, asked, 6).orderBy("question_id", "rank").collect()
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", 4)
    blocks = retrieval.build_index(docs)
    assert blocks.blocks.count() == 11
    assert retrieval.search(blocks, asked, 6).orderBy("question_id", "rank").collect() == found and len(found) == 13


def test_vectors_are_made_without_grouping_words_by_document(spark):
    docs = spark.createDataFrame([("a", "k", "red shoe"), ("b", "k", "red desk"), (None, "k", "red lamp"), ("c", "k", None)], "doc_id string, kind string, text string")
    v = retrieval.vectors(docs)
    assert {r.doc_id: (r.nonzero, r.norm) for r in v.collect()} == {"a": (2, 1.0), "b": (2, 1.0), None: (0, 0.0), "c": (0, 0.0)}
    assert "collect_list" not in v._jdf.queryExecution().toString()
