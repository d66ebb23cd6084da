"""The pipeline, stage by stage, against what each stage promises."""

import functools
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tallyhouse.llm import packing
from tallyhouse.llm.common import stored

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), name.replace(" ", "_")))
    return out


def shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def test_columns_and_order(stages):
    for df in stages[:5]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_near_copies_are_brute_force_representatives(stages):
    before = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    ids = sorted(before)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            s, t = before[a], before[b]
            if a < b and s | t and 5 * len(s & t) >= 4 * len(s | t):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(set(group.values()))


def test_equal_rows_need_no_window(spark):
    text = "a b c d e f g"
    docs = [(1, text), (1, text), (2, "other words in this one here"), (3, text)]
    docs += [(None, None), (None, ""), (None, ""), (4, " \n"), (4, " \n"), (None, "x y"), (None, "x y")]
    given = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, given, SMALL)
    want = [(1, text), (2, docs[2][1]), *[(None, "")] * 3, *[(4, " \n")] * 2, (None, "x y")]
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, want))
    assert "Window" not in got._jdf.queryExecution().toString()


def test_no_benchmark_and_no_personal_data_left(spark, stages):
    bench = [r["text"].lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    after = {r["doc_id"] for r in stages[3].collect()}
    held = {r["doc_id"] for r in stages[2].collect() if any(b in r["text"].lower() for b in bench)}
    assert not after & held and len(after) >= stages[2].count() - len(held) - 1
    masked = stages[4].collect()
    assert {r["doc_id"] for r in masked} == after
    assert not [r for r in masked if re.search(r"[\w.]+@[\w-]+\.[\w.]+", r["text"])]
    assert stages[4].filter(F.col("n_chars") != F.char_length("text")).isEmpty()


def test_packing_holds_every_document(stages):
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("s")).filter("s > 1024").isEmpty()


def test_packing_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "pack", functools.partial(packing.pack, group_rows=10))
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.lit(" a" * 299).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(598).alias("n_chars"))
    got = corpus_pipeline.pack_sequences(spark, docs, SMALL)
    assert got.select("doc_id").distinct().count() == got.count() == 1300
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("s"), F.count("*").alias("n")).collect()
    assert len(bins) == -(-1300 // 3) and {r["s"] for r in bins if r["n"] == 3} == {900}


def test_intermediate_tables_of_the_join_are_removed(spark):
    import glob

    from tallyhouse.llm import common

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = set(glob.glob(f"{shared}/*"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{shared}/*")) - before}
    assert left == {"keep"} and kept.count() > 0
    with common.scratch() as made:
        one = stored(spark.range(3), "one")
    assert one.count() == 3 and len(made) == 1
    common.remove(spark, made)
    assert not made and not [p for p in glob.glob(f"{shared}/*") if "/one-" in p]
