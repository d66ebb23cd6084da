"""Data-quality reports over the clean and quarantine layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import exact_avg, exact_sum, percent, scaled
from ..functions.text import dollars, fixed2
from ..operators.lookup import count_orphans
from ..operators.report import metrics, stack
from .cleanse import RULES, tagged

# entity -> key that the clean table is unique on
CLEAN_KEY = {"customers": "customer_id", "orders": "order_id", "products": "product_id", "vendors": "vendor_id"}
REPORTED = ["customers", "orders", "products", "returns", "transactions"]


def customer_field() -> Column:
    issue = F.col("issue_type")
    return (
        F.when(issue.contains("email"), "customer_email")
        .when(issue.contains("segment"), "segment")
        .when(issue.contains("postal"), "postal_code")
        .otherwise("unknown")
    )


def _delivered_early() -> Column:
    return F.coalesce(F.col("order_delivered_customer_date") < F.col("order_purchase_date"), F.lit(False))


def order_issue() -> Column:
    """First failing condition of an order."""
    return (
        F.when(F.col("order_id").isNull(), "missing_order_id")
        .when(F.col("customer_id").isNull(), "missing_customer_id")
        .when(F.col("vendor_id").isNull(), "missing_vendor_id")
        .when(F.col("order_purchase_date").isNull(), "missing_purchase_date")
        .when(_delivered_early(), "invalid_delivery_date")
        .when(F.col("order_status").isNull(), "missing_order_status")
        .otherwise("other_issue")
    )


def order_field() -> Column:
    out = None
    for c in ["order_id", "customer_id", "vendor_id", "order_purchase_date"]:
        out = F.when(F.col(c).isNull(), c) if out is None else out.when(F.col(c).isNull(), c)
    out = out.when(_delivered_early(), "order_delivered_customer_date")
    for c in [
        "order_estimated_delivery_date",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_approved_at",
    ]:
        out = out.when(F.col(c).isNull(), c)
    return out.otherwise("unknown")


def issue_report(bad_customers: DataFrame, bad_orders: DataFrame) -> DataFrame:
    """(entity, field, issue, issue_type, count) of both entities in one table."""
    parts = []
    for entity, df, field, issue in [
        ("customers", bad_customers, customer_field(), F.split_part("issue_type", F.lit(", "), F.lit(1))),
        ("orders", bad_orders, order_field(), order_issue()),
    ]:
        labelled = df.select(F.lit(entity).alias("entity"), field.alias("field"), issue.alias("issue"), "issue_type")
        parts.append(labelled.groupBy("entity", "field", "issue", "issue_type").agg(F.count(F.lit(1)).alias("count")))
    return stack(parts)


def split_counts(raw: dict[str, DataFrame], entities: list[str] = REPORTED) -> DataFrame:
    """(entity, clean_count, quarantine_count, quarantine_rate_pct), one pass per entity."""
    parts = []
    for e in entities:
        rows = tagged(raw[e], e)
        if e in CLEAN_KEY:
            good = F.count_distinct(F.when(~F.col("is_quarantined"), F.col(CLEAN_KEY[e])))
        else:
            good = F.count_if(~F.col("is_quarantined"))
        parts.append(
            rows.agg(good.alias("clean_count"), F.count_if("is_quarantined").alias("quarantine_count")).select(
                F.lit(e).alias("entity"), "clean_count", "quarantine_count"
            )
        )
    total = F.col("clean_count") + F.col("quarantine_count")
    return stack(parts).withColumn("quarantine_rate_pct", percent(F.col("quarantine_count"), total))


def counted_by_subqueries(clean: dict[str, DataFrame], quarantine: dict[str, DataFrame], entities: list[str] = REPORTED) -> DataFrame:
    """(entity, clean_count, quarantine_count, quarantine_rate_pct) of stored tables: one row for each entity, whose
    figures are scalar subqueries of its projection."""
    spark = next(iter(clean.values())).sparkSession

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    parts = [
        spark.range(1).select(F.lit(e).alias("entity"), rows(clean[e]).alias("clean_count"), rows(quarantine[e]).alias("quarantine_count"))
        for e in entities
    ]
    total = F.col("clean_count") + F.col("quarantine_count")
    return stack(parts).withColumn("quarantine_rate_pct", percent(F.col("quarantine_count"), total))


def alerts(counts: DataFrame, threshold: float = vocab.QUARANTINE_ALERT_PCT) -> DataFrame:
    status = F.when(F.col("quarantine_rate_pct") > threshold, "ALERT").otherwise("OK")
    text = F.concat(
        F.col("entity"), F.lit(": "), fixed2("quarantine_rate_pct"), F.lit("% of rows quarantined, review "),
        F.col("entity"), F.lit("_quarantine"),
    )
    return counts.withColumns({"status": status, "alert": F.when(status == "ALERT", text)})


def quality_scores(clean: dict[str, DataFrame]) -> DataFrame:
    """Id completeness and two more rates per entity."""
    tests = {
        "customers": ("customer_id", F.col("customer_email").contains("@"), F.col("customer_name").isNotNull()),
        "orders": ("order_id", F.col("order_estimated_delivery_date").isNotNull(), F.col("customer_id").isNotNull()),
        "products": ("product_id", F.col("category") != vocab.CATEGORY_OTHER, F.col("sizes") != vocab.NO_SIZE),
        "returns": ("order_id", F.col("refund_amount") >= 0, F.col("return_date").isNotNull()),
        "transactions": ("order_id", F.col("sales") > 0, F.col("product_id").isNotNull()),
    }
    parts = []
    for e, (key, second, third) in tests.items():
        n = F.count(F.lit(1))
        parts.append(
            clean[e]
            .agg(
                n.alias("total_records"),
                F.count(key).alias("valid_ids"),
                percent(F.count(key), n).alias("id_completeness_pct"),
                percent(F.count_if(second), n).alias("quality_metric_2_pct"),
                percent(F.count_if(third), n).alias("quality_metric_3_pct"),
            )
            .select(F.lit(e).alias("entity"), "*")
        )
    return stack(parts)


def entity_metrics(clean: dict[str, DataFrame], order_values: DataFrame) -> DataFrame:
    """(entity, metric, value) blocks of the five entities; ``order_values`` is (order_id, sales)."""
    n = F.count(F.lit(1))
    valued = clean["orders"].select("order_id", "customer_id").join(order_values, "order_id", "left")
    return stack(
        [
            metrics(clean["customers"], "customers", {
                "total_records": n,
                "valid_emails": F.count_if(F.col("customer_email").contains("@")),
                "missing_name": F.count_if(F.col("customer_name").isNull()),
                "duplicate_ids": n - F.count_distinct("customer_id"),
            }),
            metrics(valued, "orders", {
                "total_records": n,
                "total_order_value": F.coalesce(exact_sum("sales"), F.lit(0.0)),
                "avg_order_value": exact_avg("sales"),
                "without_value": F.count_if(F.coalesce(F.col("sales"), F.lit(0.0)) <= 0),
                "missing_customer": F.count_if(F.col("customer_id").isNull()),
            }),
            metrics(clean["products"], "products", {
                "total_records": n,
                "without_category": F.count_if(F.col("category") == vocab.CATEGORY_OTHER),
                "without_size": F.count_if(F.col("sizes") == vocab.NO_SIZE),
                "without_weight": F.count_if(F.col("weight").isNull()),
                "duplicate_ids": n - F.count_distinct("product_id"),
            }),
            metrics(clean["returns"], "returns", {
                "total_records": n,
                "total_refund_amount": exact_sum("refund_amount"),
                "avg_refund_amount": exact_avg("refund_amount"),
                "not_positive": F.count_if(F.col("refund_amount") <= 0),
                "missing_order": F.count_if(F.col("order_id").isNull()),
            }),
            metrics(clean["transactions"], "transactions", {
                "total_records": n,
                "total_sales": exact_sum("sales"),
                "avg_sales": exact_avg("sales"),
                "not_positive": F.count_if(F.col("sales") <= 0),
                "missing_order": F.count_if(F.col("order_id").isNull()),
            }),
        ]
    )


SAMPLE_COLUMNS = {
    "customers": ["customer_id", "customer_name", "customer_email"],
    "orders": ["order_id", "customer_id", "order_status"],
    "products": ["product_id", "product_name", "categories"],
    "returns": ["order_id", "return_reason", "return_status"],
    "transactions": ["order_id", "product_id", "payment_type"],
}


def quarantine_sample(bad: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """The first ``k`` quarantined rows with their first failing rule."""
    columns = SAMPLE_COLUMNS[entity]
    first = RULES[entity].first_issue("other_failure").alias("first_issue")
    rows = bad.select(F.lit(entity).alias("entity"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)], first)
    return rows.orderBy(*[F.asc_nulls_first(f"c{i}") for i in range(len(columns))], "first_issue").limit(k)


def integrity(clean: dict[str, DataFrame], order_values: DataFrame) -> DataFrame:
    """(integrity_check, orphaned_count): five referential checks."""

    def row(name: str, counted: DataFrame) -> DataFrame:
        return counted.select(F.lit(name).alias("integrity_check"), "orphaned_count")

    several = clean["transactions"].groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    above = clean["returns"].join(order_values, "order_id").filter("refund_amount > sales")
    count = F.count(F.lit(1)).alias("orphaned_count")
    return stack(
        [
            row("orders_without_customer", count_orphans(clean["orders"], "customer_id", clean["customers"], "customer_id")),
            row("returns_without_order", count_orphans(clean["returns"], "order_id", clean["orders"], "order_id")),
            row("transactions_without_order", count_orphans(clean["transactions"], "order_id", clean["orders"], "order_id")),
            row("orders_with_multiple_transactions", several.agg(count)),
            row("returns_above_order_value", above.agg(count)),
        ]
    )


def business_metrics(clean: dict[str, DataFrame]) -> DataFrame:
    """(metric, value text): ten figures; every table is aggregated on its own first."""
    n = F.count(F.lit(1))
    totals = (
        clean["customers"].agg(n.alias("customers"))
        .join(F.broadcast(clean["orders"].agg(n.alias("orders"))), F.lit(True))
        .join(F.broadcast(clean["products"].agg(n.alias("products"))), F.lit(True))
        .join(F.broadcast(clean["transactions"].agg(n.alias("lines"), F.coalesce(F.sum(scaled("sales")), F.lit(0)).alias("sales"))), F.lit(True))
        .join(F.broadcast(clean["returns"].agg(n.alias("returns"), F.coalesce(F.sum(scaled("refund_amount")), F.lit(0)).alias("refunds"))), F.lit(True))
    )
    sales, refunds = F.col("sales") / 10000.0, F.col("refunds") / 10000.0
    rate = F.col("returns") * 100.0 / F.nullif("orders", F.lit(0))
    values = {
        "Total Customers": F.col("customers").cast("string"),
        "Total Orders": F.col("orders").cast("string"),
        "Total Products": F.col("products").cast("string"),
        "Total Transactions": F.col("lines").cast("string"),
        "Total Sales": dollars(sales),
        "Total Refunds": dollars(refunds),
        "Total Returns": F.col("returns").cast("string"),
        "Net Revenue": dollars((F.col("sales") - F.col("refunds")) / 10000.0),
        "Return Rate": F.concat(fixed2(rate), F.lit("%")),
        "Avg Order Value": dollars(sales / F.nullif("orders", F.lit(0))),
    }
    row = totals.select(*[v.alias(k) for k, v in values.items()])
    return row.unpivot([], list(values), "metric", "value")


def temporal_coverage(clean: dict[str, DataFrame]) -> DataFrame:
    """(table_name, latest, earliest, date_range_days) on the real date columns."""
    ordered = clean["orders"].select("order_id", "order_purchase_date")
    sold = clean["transactions"].select("order_id").distinct().join(ordered, "order_id")
    parts = []
    for name, df, c in [
        ("orders", clean["orders"], "order_purchase_date"),
        ("products", clean["products"], "dateUpdated"),
        ("returns", clean["returns"], "return_date"),
        ("transactions", sold, "order_purchase_date"),
    ]:
        parts.append(
            df.agg(F.max(c).alias("latest"), F.min(c).alias("earliest")).select(
                F.lit(name).alias("table_name"), "latest", "earliest", F.datediff("latest", "earliest").alias("date_range_days")
            )
        )
    return stack(parts)


def quality_trend(raw: dict[str, DataFrame], entities: list[str] = REPORTED) -> DataFrame:
    """Rows and quarantine rate per entity and load day."""
    parts = []
    for e in entities:
        rows = tagged(raw[e], e).select(F.lit(e).alias("entity"), F.to_date("_ingested_at").alias("load_day"), "is_quarantined")
        parts.append(
            rows.groupBy("entity", "load_day").agg(
                F.count(F.lit(1)).alias("total_rows"), F.count_if("is_quarantined").alias("quarantined_rows")
            )
        )
    return stack(parts).withColumn("quarantine_rate_pct", percent(F.col("quarantined_rows"), F.col("total_rows")))


def trend_anomalies(trend: DataFrame, earlier: int = 3, limit: float = 3.0) -> DataFrame:
    """The trend with mean and deviation of each entity's earlier loads, z-score and flag.

    A load is flagged if at least ``earlier`` loads came before and its rate is more than ``limit`` deviations away
    from their mean, or differs from it at all where they were all alike. Rates have two digits, so they are added up
    as whole hundredths. A window holds the days of one entity.
    """
    before = Window.partitionBy("entity").orderBy("load_day").rowsBetween(Window.unboundedPreceding, -1)
    cents = F.round(F.col("quarantine_rate_pct") * 100).cast("bigint")
    t = trend.withColumns(
        {
            "earlier_loads": F.count("quarantine_rate_pct").over(before),
            "_s": F.sum(cents).over(before).cast("double"),
            "_q": F.sum(cents * cents).over(before).cast("double"),
        }
    )
    n = F.col("earlier_loads").cast("double")
    t = t.withColumn("_mean", F.try_divide("_s", n))
    t = t.withColumn("_sd", F.when(n > 1, F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_mean"), F.lit(0.0)) / (n - 1))))
    gap = cents.cast("double") - F.col("_mean")
    away = F.when(F.col("_sd") > 0, F.abs(gap) > limit * F.col("_sd")).otherwise(gap != 0)
    return t.select(
        *trend.columns,
        "earlier_loads",
        (F.floor(F.col("_mean") * 100 + 0.5) / 10000.0).alias("earlier_mean"),
        F.when(F.col("_sd") > 0, F.floor(gap / F.col("_sd") * 100 + 0.5) / 100.0).alias("z_score"),
        F.coalesce((F.col("earlier_loads") >= earlier) & away, F.lit(False)).alias("is_anomaly"),
    )
