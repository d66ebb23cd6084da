"""Batch results equal stream results; retried batches change nothing."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import cleanse, standardise
from tallyhouse.plans.star import Star
from tallyhouse.streaming import progress
from tallyhouse.streaming import tables as streams


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.fixture(scope="module")
def raw_orders(spark, layers, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw_orders") / "t")
    layers.raw("orders").repartition(3).write.parquet(path)
    return path


def test_split_stream_equals_batch(spark, layers, raw_orders, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    streams.split_stream(streams.table_stream(spark, raw_orders, 1), "orders", good, bad, str(tmp_path / "c"))
    clean, quarantine = spark.read.parquet(good).drop("batch_id"), spark.read.parquet(bad).drop("batch_id")
    assert same(clean, standardise.drop_lineage(cleanse.RULES["orders"].clean(layers.std("orders"))))
    assert same(quarantine, layers.quarantine("orders"))
    assert clean.count() + quarantine.count() == layers.raw("orders").count()


def test_stream_dedup_keeps_one_row_per_key(spark, layers, raw_orders, tmp_path):
    out = str(tmp_path / "o")
    streams.append_table(streams.first_rows_stream(streams.table_stream(spark, raw_orders, 1), "orders", "order_id"), out, str(tmp_path / "c"))
    assert same(spark.read.parquet(out).select("order_id"), layers.clean("orders").select("order_id"))


def test_best_records_over_batches(spark, layers, tmp_path):
    path, table = str(tmp_path / "raw"), str(tmp_path / "best")
    layers.raw("customers").repartition(5).write.parquet(path)
    streams.best_record_stream(streams.table_stream(spark, path, 1), table, str(tmp_path / "c"))
    assert len({r.batch_id for r in spark.read.parquet(table).select("batch_id").distinct().collect()}) == 5
    assert same(streams.best_records(spark, table), layers.clean("customers"))
    assert same(streams.compact(spark, table, str(tmp_path / "one")), layers.clean("customers"))


def test_stream_static_returns(spark, layers, tmp_path):
    path, out = str(tmp_path / "returns"), str(tmp_path / "facts")
    layers.clean("returns").repartition(2).write.parquet(path)
    star: Star = layers.star()
    streams.append_table(star.enrich_returns(streams.table_stream(spark, path, 1), star.order_sales), out, str(tmp_path / "c"))
    assert same(spark.read.parquet(out), star.fact_returns())


def test_a_retried_batch_overwrites_itself(spark, layers, tmp_path):
    out = str(tmp_path / "t")
    rows = layers.clean("vendors")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{out}/batch_id=0")
    assert spark.read.parquet(out).count() == rows.count()
    assert spark.read.parquet(out).select(F.max("batch_id")).first()[0] == 0


@pytest.mark.parametrize("entity", ["customers", "orders", "products", "vendors", "returns"])
def test_streamed_clean_tables_equal_the_batch_ones(spark, layers, tmp_path, entity):
    raw, good, bad = (str(tmp_path / n) for n in ("raw", "good", "bad"))
    rows = layers.raw(entity)
    # every key comes again in later batches
    rows.unionByName(rows.sample(0.3, seed=1)).repartition(3).write.parquet(raw) if entity != "returns" else rows.repartition(3).write.parquet(raw)
    query = streams.clean_stream(streams.table_stream(spark, raw, 1), entity, good, bad, str(tmp_path / "c"))
    assert len(query.recentProgress) >= 3 and all(not p["stateOperators"] for p in query.recentProgress)
    assert same(streams.clean_table(spark, good, entity), layers.clean(entity))
    assert same(streams.compact(spark, good, str(tmp_path / "one"), entity), layers.clean(entity))
    assert same(spark.read.parquet(bad).drop("batch_id").distinct(), layers.quarantine(entity).distinct())


def test_progress_of_each_run_is_stored(spark, layers, tmp_path):
    raw, log, good, bad, point = (str(tmp_path / n) for n in ("raw", "log", "good", "bad", "c"))
    rows = layers.raw("vendors").repartition(3)
    rows.write.parquet(raw)
    for _ in range(2):
        with progress.recorded(spark, log):
            streams.split_stream(streams.table_stream(spark, raw, 1), "vendors", good, bad, point)
        layers.raw("vendors").coalesce(1).write.mode("append").parquet(raw)
    found = spark.read.parquet(log)
    runs = sorted((r.input_rows, r.batches >= n, r.state_rows) for r, n in zip(progress.run_report(found).orderBy("batches").collect(), (1, 3), strict=True))
    n = layers.raw("vendors").count()
    assert runs == [(n, True, 0), (n, True, 0)]
    held = [spark.read.option("basePath", p).parquet(p).select("batch_id") for p in (good, bad)]
    assert progress.batch_gaps(found, held[0].unionByName(held[1])).isEmpty()
    gap = progress.batch_gaps(found, held[0].unionByName(held[1]).filter("batch_id > 0")).collect()
    assert [(r.batch_id, r.stored_rows) for r in gap] == [(0, 0)]


def test_progress_survives_a_failing_run(spark, layers, tmp_path):
    raw, log = str(tmp_path / "raw"), str(tmp_path / "log")
    layers.raw("vendors").write.parquet(raw)

    def fail(batch, batch_id):
        raise ValueError("no space")

    with pytest.raises(Exception, match="no space"), progress.recorded(spark, log) as seen:
        streams.run_batches(streams.table_stream(spark, raw, 1), fail, str(tmp_path / "c"))
    assert len(seen.failed) == 1 and spark.read.parquet(log).filter("input_rows > 0").isEmpty()
