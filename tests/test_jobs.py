"""Clean layer, star schema and reports on hand-written rows."""

import json
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import audit, cleanse, enrich, fraud, kpi, profiling, quality, verify
from tallyhouse.plans.star import Star
from tallyhouse.sources.entities import ENTITIES

LINEAGE = "source_region string, _source_file_path string, _source_file_name string, _source_modified_time timestamp, _ingested_at timestamp, _rescued_data string"
NOW = dt.datetime(2024, 1, 2, 3, 4, 5)


def raw(spark, entity, rows):
    """Raw rows of an entity from dicts; missing columns are NULL."""
    spec = ENTITIES[entity]
    columns = ", ".join(f"`{c}` {spec.hints.get(c, 'string')}" for c in spec.columns)
    names = [*spec.columns, "source_region", "_source_file_path", "_source_file_name", "_source_modified_time", "_ingested_at", "_rescued_data"]
    filled = [{"source_region": "Region 1", "_source_file_path": "/x", "_source_file_name": f"{entity}_1.csv", "_source_modified_time": NOW, "_ingested_at": NOW, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], f"{columns}, {LINEAGE}")


ORDER = {
    "customer_id": "A", "vendor_id": "VEN1", "order_purchase_date": "2018-01-10", "order_approved_at": "01/11/2018 10:00", "order_delivered_carrier_date": "2018-01-12 08:00:00",
    "order_delivered_customer_date": "2018-01-15", "order_status": "delivered", "ship_mode": "1st Class",
}
LINE = {"discount": "0.1", "Quantity": "1", "payment_type": " card ", "payment_installments": "1"}


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "customers": raw(spark, "customers", [
            {"customer_id": "A", "customer_email": "a@x", "customer_name": "Ann", "segment": "Cosumer", "region": "W", "city": "Texas", "state": "Austin", "source_region": "Region 4"},
            {"customer_identifier": "A", "customer_email": "a@x", "customer_name": "Ann", "customer_segment": "Consumer", "region": "West", "source_region": "Region 6"},
            {"cust_id": "B", "email_address": "b@x", "full_name": "Bob", "segment": "HO", "region": "C", "source_region": "Region 3"},
            {"customer_id": "C", "customer_name": "Cy", "segment": "HO", "region": "C", "source_region": "Region 5"},
            {"customer_id": "D", "customer_email": "d@x", "customer_name": "  ", "segment": None, "region": "C"},
        ]),
        "orders": raw(spark, "orders", [
            {"order_id": "O1", **ORDER}, {"order_id": "O1", **ORDER, "source_region": "Region 3"},
            {"order_id": "O2", **ORDER, "customer_id": "Z", "vendor_id": None},
            {"order_id": "O3", **ORDER, "order_status": None}, {"order_id": "O4", **ORDER, "order_purchase_date": "soon"},
        ]),
        "transactions": raw(spark, "transactions", [
            {"Order_id": "O1", "Product_id": "P1", "Sales": "100", "profit": -5.0, **LINE},
            {"_rescued_data": '{"Order_ID":"O1","Product_ID":"P2"}', "Sales": "300", **LINE, "discount": "40%"},
            {"Order_id": "O2", "Product_id": "P1", "Sales": "50", **LINE}, {"Order_id": "O9", "Product_id": "P1", "Sales": "7", **LINE},
            {"Order_id": "O2", "Product_id": "P1", "Sales": "?", **LINE}, {"Order_id": "O2", "Product_id": "P1", "Sales": "5", **LINE, "discount": "1.5"},
        ]),
        "returns": raw(spark, "returns", [
            {"order_id": "O1", "return_reason": "Damaged", "return_date": "2018-01-11", "_rescued_data": '{"refund_amount":"$1,130.65"}'},
            {"order_id": "O1", "return_reason": "Late", "return_date": "09-01-2018", "refund_amount": 40.0},
            {"OrderId": "OX", "reason": "Wrong", "date_of_return": "01/20/2018", "amount": 10.0},
            {"order_id": "O1", "return_reason": "?", "return_date": "2018-01-11", "refund_amount": 1.0},
            {"order_id": "O1", "return_reason": "Late", "return_date": "NULL", "refund_amount": float("nan")},
        ]),
        "products": raw(spark, "products", [
            {"product_id": "P1", "product_name": " Shoe ", "categories": "Women shoe"}, {"product_id": "P1", "product_name": " Shoe b", "categories": "Women shoe"},
            {"product_id": "P2", "product_name": "Desk", "categories": "Office", "weight": "500 g"}, {"product_id": "P3", "product_name": None, "categories": " "},
        ]),
        "vendors": raw(spark, "vendors", [{"vendor_id": " VEN1 ", "vendor_name": "acme ltd"}, {"vendor_id": "VEN1", "vendor_name": "zed"}, {"vendor_id": "V2", "vendor_name": "x"}, {"vendor_name": " "}]),
    }
    clean = {e: cleanse.clean(df, e).cache() for e, df in tables.items()}
    return tables, clean, Star(clean)


def pick(df, key):
    return {r[key]: r for r in df.collect()}


def test_clean_customers(shop):
    _, clean, _ = shop
    got = pick(clean["customers"], "customer_id")
    assert set(got) == {"A", "B"}
    # equal scores: the lowest region wins, with city and state back in place
    assert (got["A"].source_region, got["A"].city, got["A"].state, got["A"].segment) == ("Region 4", "Austin", "Texas", "Consumer")


def test_quarantine_labels(shop):
    tables, _, _ = shop
    labels = {e: sorted(r.issue_type for r in cleanse.quarantine(df, e).collect()) for e, df in tables.items()}
    assert labels["customers"] == ["missing_customer_email", "missing_customer_name, invalid_segment"]
    assert labels["orders"] == ["invalid_order_status", "missing_purchase_date"]
    assert labels["transactions"] == ["invalid_discount", "invalid_sales"]
    assert labels["returns"] == ["missing_return_date, missing_refund_amount", "missing_return_reason"]
    assert labels["products"] == ["missing_product_name, missing_category"]
    assert labels["vendors"] == ["invalid_vendor_id_format", "missing_vendor_id, missing_vendor_name"]


def test_one_clean_row_per_key(shop):
    _, clean, _ = shop
    for entity, key in quality.CLEAN_KEY.items():
        assert clean[entity].count() == clean[entity].select(key).distinct().count()
    assert pick(clean["products"], "product_id")["P1"].product_name == "Shoe"
    assert pick(clean["vendors"], "vendor_id")["VEN1"].vendor_name == "Acme Ltd"


def test_transactions_fact(shop):
    _, _, star = shop
    facts = {(r.order_id, r.sales_amount): r for r in star.fact_transactions.collect()}
    assert len(facts) == 4
    linked, unknown, unlinked = facts["O1", 100.0], facts["O2", 50.0], facts["O9", 7.0]
    assert linked.customer_key == 1 and linked.date_key == 20180110 and linked.order_link_flag and linked.region_key is not None
    assert unknown.customer_key == -1 and unknown.vendor_key is None and unknown.order_link_flag
    assert unlinked.customer_key == -1 and not unlinked.order_link_flag and unlinked.date_key is None


def test_returns_fact_at_both_grains(shop):
    _, _, star = shop
    per_return = star.fact_returns().collect()
    assert len(per_return) == 3
    big = next(r for r in per_return if r.return_amount == 1130.65)
    assert big.transaction_amount == 400.0 and big.suspicious_ratio_flag and big.high_return_flag and big.quick_return_flag
    early = next(r for r in per_return if r.return_amount == 40.0)
    assert early.days_to_return == -1 and early.quick_return_flag and early.data_quality_flag == "NEGATIVE_DAYS"
    lost = next(r for r in per_return if r.order_id == "OX")
    assert lost.return_without_order_flag and lost.missing_txn_flag and lost.return_to_purchase_ratio is None and lost.customer_key == -1
    per_line = star.fact_returns("per_line").collect()
    assert len(per_line) == 5
    assert sorted(r.return_to_purchase_ratio for r in per_line if r.return_amount == 40.0) == [40 / 300, 0.4]
    with pytest.raises(ValueError):
        star.fact_returns("per_month")


def test_kpis(shop):
    _, _, star = shop
    revenue = {r.source_region: (r.total_revenue, r.total_orders, r.avg_order_value) for r in kpi.revenue_by_region(star).collect()}
    assert revenue == {"West": (400.0, 1, 200.0), None: (57.0, 2, 28.5)}
    vendors = {r.vendor_name: (r.total_returns, r.total_return_value) for r in kpi.vendor_returns(star).collect()}
    assert vendors == {"Acme Ltd": (2, 1170.65), None: (1, 10.0)}
    shared = {r.product_name: (r.return_count, r.total_return_value) for r in kpi.high_return_products(star).collect()}
    # 1170.65 shared 100 : 300
    assert shared == {"Shoe": (2, 292.6625), "Desk": (2, 877.9875)}


def test_fraud_scores(shop):
    _, _, star = shop
    row = fraud.scored_customers(star).first()
    assert (row.customer_id, row.anomaly_score, row.flagged) == ("A", 90, True)
    assert row.rules_triggered == "high_return_value,high_return_ratio,suspicious_pattern,quick_return_behavior"
    note = enrich.investigations(star).first().investigation
    assert note.startswith("Customer A returned 2 times for $1170.65 in total and reached 90 points")
    loud = enrich.investigations(star, lambda prompts: prompts.str.len().astype(str)).first()
    assert int(loud.investigation) > 50


def test_quality_and_audit(shop):
    tables, clean, star = shop
    counts = {r.entity: (r.clean_count, r.quarantine_count, r.quarantine_rate_pct) for r in quality.split_counts(tables).collect()}
    assert counts["orders"] == (2, 2, 50.0) and counts["customers"] == (2, 2, 50.0)
    checks = {r.integrity_check: r.orphaned_count for r in quality.integrity(clean, star.order_sales).collect()}
    assert checks == {"orders_without_customer": 1, "returns_without_order": 1, "transactions_without_order": 1, "orders_with_multiple_transactions": 1, "returns_above_order_value": 1}
    figures = {r.metric: r.value for r in quality.business_metrics(clean).collect()}
    assert figures["Total Sales"] == "$457.00" and figures["Return Rate"] == "150.00%" and figures["Net Revenue"] == "$-723.65"
    over = audit.overstatement(tables["customers"], clean["orders"], clean["transactions"]).first()
    assert (over.naive_revenue, over.matched_revenue, over.overstatement_pct) == (800.0, 400.0, 100.0)
    assert verify.row_counts(tables).filter("entity = 'orders'").first().row_count == 5


def test_profile_flags(spark):
    df = spark.createDataFrame([(i, "x", None, None if i else "r", i % 2) for i in range(10)], "id int, one string, none string, _rescued_data string, two int")
    exact = {r.column_name: (r.nulls, r.null_pct, r.distinct_values, r.flag) for r in profiling.profile(df).collect()}
    assert exact == {
        "id": (0, 0.0, 10, "candidate_key"), "one": (0, 0.0, 1, "constant"), "none": (10, 100.0, 1, "all_null"),
        "_rescued_data": (9, 90.0, 2, "mostly_null"), "two": (0, 0.0, 2, ""),
    }
    rough = {r.column_name: (r.nulls, r.distinct_values, r.flag) for r in profiling.profile(df, approximate=True).collect()}
    assert rough == {k: (v[0], v[2], v[3]) for k, v in exact.items()}


def test_profile_estimates_only_what_no_flag_needs(spark):
    df = spark.range(40_000).select(
        "id", (F.col("id") % 20_000).alias("half"), F.col("id").cast("double").alias("d"), F.expr("date '2020-01-01' + cast(id % 700 as int)").alias("day"),
        F.expr("timestamp_seconds(id div 3)").alias("at"), F.when(F.col("id") > 0, F.col("id")).alias("nearly"),
    )
    found = {r.column_name: r for r in profiling.profile(df, exact_up_to=1_000).collect()}
    assert (found["id"].distinct_values, found["d"].distinct_values, found["day"].distinct_values) == (40_000, 40_000, 700)
    assert found["id"].flag == found["d"].flag == "candidate_key" and found["nearly"].flag == "" and found["nearly"].nulls == 1
    assert abs(found["half"].distinct_values - 20_000) < 800 and abs(found["at"].distinct_values - 13_334) < 600
    assert {r.column_name: r.distinct_values for r in profiling.profile(df).collect()}["half"] == 20_000
    assert profiling.profile(df.limit(0)).filter("total_rows = 0 and distinct_values = 0").count() == 6


def test_profile_is_exact_beyond_a_million_values(spark):
    df = spark.range(2_400_000).select((F.col("id") % 1_200_000).alias("half"), F.when(F.col("id") % 3 > 0, F.col("id")).cast("string").alias("some"))
    found = {r.column_name: (r.total_rows, r.nulls, r.distinct_values, r.flag) for r in profiling.profile(df).collect()}
    assert found == {"half": (2_400_000, 0, 1_200_000, ""), "some": (2_400_000, 800_000, 1_600_001, "")}


def test_readiness_reads_each_table_once(spark, layers):
    raw = layers.all_raw
    report = profiling.readiness(raw)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(raw)
    rows = {(r.check_group, r.label): (r.fails, r.total) for r in report.collect()}
    assert len(rows) == 22 and rows["products", "product_id unique"][1] == raw["products"].count()
    few = raw["orders"].select("order_id").filter("order_id is not null").distinct()
    back = raw["returns"].select(F.coalesce("order_id", "OrderId").alias("order_id"))
    assert rows["references", "returns to orders"] == (back.count() - back.join(few, "order_id").count(), back.count())


def test_quantiles_by_region_are_exact_for_few_products(spark, layers):
    rows = kpi.movement_by_quantile(layers.star()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.region_name, []).append(r.order_count)
    for r in rows:
        counts = sorted(by[r.region_name])
        low, high = (counts[max(0, -(-int(q * len(counts) * 100) // 100) - 1)] for q in (0.25, 0.75))
        want = "slow-moving" if r.order_count <= r.slow_up_to else "fast-moving" if r.order_count > r.fast_above else "steady"
        assert r.movement_status == want and r.slow_up_to in (low, *counts) and r.fast_above >= r.slow_up_to and high >= low


def test_rates_are_scalar_subqueries(spark, layers):
    bad = {e: layers.quarantine(e) for e in quality.REPORTED}
    report = quality.counted_by_subqueries(layers.all_clean, bad)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") >= 2 * len(quality.REPORTED)
    want = {r.entity: tuple(r) for r in quality.split_counts(layers.all_raw).collect()}
    assert {r.entity: tuple(r) for r in report.collect()} == want


def test_decimal_sums_keep_small_addends(spark):
    from tallyhouse.functions.columns import decimal_sum, exact_sum

    df = spark.range(1000).select(F.lit(0.00004).alias("x"))
    assert float(df.agg(decimal_sum("x")).first()[0]) == 0.04 and df.agg(exact_sum("x")).first()[0] == 0.0


def test_a_third_of_all_rows_under_one_order(spark, shop):
    """Hot order: facts stay whole, and no step collects its rows."""
    _, clean, _ = shop
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "O1").otherwise(F.concat(F.lit("N"), F.col("id"))).alias("order_id"), F.lit("P1").alias("product_id"), F.lit(2.0).alias("sales")
    )
    back = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "O1").otherwise(F.concat(F.lit("N"), F.col("id"))).alias("order_id"), F.lit("Late").alias("return_reason"),
        F.lit("2018-02-01").cast("date").alias("return_date"), F.lit(1.0).alias("refund_amount"),
    )
    star = Star({**clean, "transactions": hot, "returns": back})
    assert star.fact_transactions.count() == 30_000
    facts = star.fact_returns()
    assert facts.count() == 3_000
    assert facts.filter("order_id = 'O1'").select("transaction_amount").distinct().collect()[0][0] == 20_000.0
    assert kpi.high_return_products(star).first().total_return_value == 3_000.0


def test_queries_store_only_the_tables_they_need(spark, monkeypatch):
    from tallyhouse.testbed import tables as T

    b, made = T.Tables(spark, "/root/testdata/sf0.001"), []
    monkeypatch.setattr(T, "write_landing", lambda spark, sf_dir, root, entities: made.append(entities) or root)
    monkeypatch.setattr(T.Tables, "clean", lambda self, e: made.append(e) or T.cleanse.clean(T.raw_frame(spark, self.sf_dir, e), e))
    assert b.star().dim_product.count() > 0 and made == ["products"]
    assert b.landed("vendors") == b.landing and sorted(b.all_clean) == sorted(T.ENTITIES)
    assert made[1:] == [[e] for e in ["vendors", *(e for e in T.ENTITIES if e != "vendors")]]


def test_documents_need_no_shuffle(layers):
    from tallyhouse.testbed import landing

    rows = layers.clean("vendors")
    documents = landing._documents(rows)
    assert "Exchange" not in documents._jdf.queryExecution().executedPlan().toString()
    held = [r for d in documents.collect() for r in json.loads(d.value)]
    assert sorted(r["vendor_id"] for r in held) == sorted(r.vendor_id for r in rows.collect())


def test_stream_batches_are_written_by_many_tasks(spark, layers):
    from tallyhouse.testbed import queries_files, tables as T

    b, seen = T.Tables(spark, "/root/testdata/sf0.001"), {}
    orders = layers.raw("orders").repartition(6)
    b.raw = lambda entity: orders

    def keep(batch, batch_id):
        seen[batch_id] = (batch.count(), batch.select(F.input_file_name()).distinct().count())

    queries_files.streams.run_batches(queries_files._raw_batches(b, "orders", 4, ["source_region"]), keep, b.folder("c"))
    assert len(seen) >= 4 and sum(n for n, _ in seen.values()) == orders.count()
    assert sum(files for _, files in seen.values()) >= 12
