"""KPI views over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_avg, exact_sum, scaled
from ..functions.text import fixed2
from ..operators.numbering import number_rows
from ..operators.report import stack, with_share
from .star import Star

QUANTILE_ACCURACY = 100_000
SLOW_SHARE = 0.5


def revenue_by_region(star: Star) -> DataFrame:
    by_key = star.fact_transactions.groupBy("region_key").agg(
        exact_sum("sales_amount").alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
        exact_avg("sales_amount").alias("avg_order_value"),
    )
    return by_key.join(star.regions, "region_key", "left").drop("region_key")


def vendor_returns(star: Star, grain: str = "per_return") -> DataFrame:
    by_key = star.fact_returns(grain).groupBy("vendor_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(scaled("return_amount")).alias("value"),
        F.sum(scaled("return_to_purchase_ratio", 6)).alias("ratio"),
        F.count("return_to_purchase_ratio").alias("ratios"),
    )
    named = by_key.join(star.dim_vendor.select("vendor_key", "vendor_name"), "vendor_key", "left")
    return named.groupBy("vendor_name").agg(
        F.sum("n").alias("total_returns"),
        (F.sum("value") / 10000.0).alias("total_return_value"),
        F.try_divide(F.sum("ratio") / 1000000.0, F.sum("ratios")).alias("avg_return_ratio"),
    )


def inventory_velocity(star: Star) -> DataFrame:
    """Sales per product; lines are added up per key before names are joined."""
    by_key = star.fact_transactions.groupBy("product_key").agg(
        F.sum(scaled("sales_amount")).alias("sales"), F.count("order_id").alias("orders")
    )
    named = by_key.join(star.dim_product.select("product_key", "product_name"), "product_key", "left")
    return named.groupBy("product_name").agg(
        (F.sum("sales") / 10000.0).alias("total_sales"), F.sum("orders").alias("order_count")
    )


def revenue_rollup(revenue: DataFrame) -> DataFrame:
    return revenue.agg(
        exact_sum("total_revenue").alias("total_revenue"), exact_avg("total_revenue").alias("avg_revenue")
    )


def vendor_rollup(vendors: DataFrame) -> DataFrame:
    return vendors.agg(
        exact_avg("avg_return_ratio", 6).alias("avg_return_rate"),
        exact_sum("avg_return_ratio", 6).alias("total_return_rate"),
    )


def inventory_rollup(velocity: DataFrame) -> DataFrame:
    return velocity.agg(
        exact_sum("total_sales").alias("total_slow_inventory"),
        exact_avg("total_sales").alias("avg_inventory"),
        F.sum("order_count").alias("total_orders"),
        exact_avg("order_count").alias("avg_orders"),
    )


def insight_rows(star: Star) -> DataFrame:
    """(insight_type, kpi_data): each rollup as one JSON text."""

    def row(kind: str, rollup: DataFrame) -> DataFrame:
        # numbers as text: a JSON double of this size would be written with an exponent
        values = [fixed2(c).alias(c) for c in rollup.columns]
        return rollup.select(F.lit(kind).alias("insight_type"), F.to_json(F.struct(*values)).alias("kpi_data"))

    return stack(
        [
            row("revenue_performance", revenue_rollup(revenue_by_region(star))),
            row("vendor_return_rate", vendor_rollup(vendor_returns(star))),
            row("slow_moving_inventory", inventory_rollup(inventory_velocity(star))),
        ]
    )


def _sales_by_product_region(star: Star) -> DataFrame:
    by_key = star.fact_transactions.groupBy("product_key", "region_key").agg(
        F.sum(scaled("sales_amount")).alias("sales"), F.count("order_id").alias("order_count")
    )
    products = star.dim_product.select("product_key", "product_name", "category")
    regions = star.regions.withColumnRenamed("source_region", "region_name")
    return by_key.join(products, "product_key").join(regions, "region_key")


def slow_products_by_region(star: Star, slow_share: float = SLOW_SHARE) -> DataFrame:
    """Products that sold, per region, and how they move.

    A product is slow-moving in a region when it has fewer than ``slow_share``
    of the region's average orders per product, fast-moving above the average
    times ``2 - slow_share``, steady otherwise.
    """
    sold = _sales_by_product_region(star)
    usual = sold.groupBy("region_key").agg((F.sum("order_count") / F.count(F.lit(1))).alias("usual"))
    status = (
        F.when(F.col("order_count") < F.col("usual") * slow_share, "slow-moving")
        .when(F.col("order_count") > F.col("usual") * (2 - slow_share), "fast-moving")
        .otherwise("steady")
    )
    return sold.join(usual, "region_key").select(
        "product_name", "category", "region_name", status.alias("movement_status"), "order_count",
        (F.col("sales") / 10000.0).alias("total_sales"),
    )


def movement_by_quantile(star: Star, slow: float = 0.25, fast: float = 0.75, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Products that sold, per region, and how they move beside the region's other products.

    A product is slow-moving when its orders are at most the region's ``slow`` quantile, fast-moving above the ``fast``
    one, steady otherwise. Quantiles come from a mergeable sketch per region; their rank is off by at most
    1 / ``accuracy`` of the region's products, so a region of fewer products has exact ones.
    """
    sold = _sales_by_product_region(star)
    limits = F.approx_percentile("order_count", F.array(F.lit(slow), F.lit(fast)), F.lit(accuracy))
    usual = sold.groupBy("region_key").agg(limits.alias("limits"))
    status = (
        F.when(F.col("order_count") <= F.col("limits")[0], "slow-moving").when(F.col("order_count") > F.col("limits")[1], "fast-moving").otherwise("steady")
    )
    # one row for each region
    return sold.join(usual, "region_key").select(
        "product_name", "category", "region_name", status.alias("movement_status"), "order_count",
        F.col("limits")[0].alias("slow_up_to"), F.col("limits")[1].alias("fast_above"),
    )


def top_categories_by_region(star: Star) -> DataFrame:
    lines = star.fact_transactions.join(star.dim_product.select("product_key", "category"), "product_key").join(
        star.regions.withColumnRenamed("source_region", "region_name"), "region_key"
    )
    return lines.groupBy("region_name", "category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        exact_sum("sales_amount").alias("total_revenue"),
        (exact_sum("sales_amount") / F.count_distinct("order_id")).alias("avg_order_value"),
    )


def _returns_by_product(star: Star) -> DataFrame:
    """Returns per product id; an order's refunds are shared over its lines by sales.

    Refunds and lines are added up per order first, so an order with many of
    both contributes one row per product, never returns times lines.
    """
    lines = star.tables["transactions"]
    parts = lines.groupBy("order_id", "product_id").agg(F.sum(scaled("sales")).alias("part"))
    whole = lines.groupBy("order_id").agg(F.sum(scaled("sales")).alias("whole"))
    back = star.tables["returns"].groupBy("order_id").agg(
        F.sum(scaled("refund_amount")).alias("refund"), F.count(F.lit(1)).alias("returns")
    )
    shared = (
        back.join(whole, "order_id")
        .join(parts, "order_id")
        .withColumns(
            {
                "value": F.floor(F.col("refund") * (F.col("part") / F.col("whole")) + 0.5).cast("bigint"),
                "ratio": F.col("refund") / F.col("whole"),
            }
        )
    )
    by_product = shared.groupBy("product_id").agg(
        F.sum("returns").alias("return_count"),
        (F.sum("value") / 10000.0).alias("total_return_value"),
        exact_avg("ratio", 6).alias("avg_return_ratio"),
    )
    return by_product.join(star.dim_product.select("product_id", "product_name", "category"), "product_id").select(
        "product_id", "product_name", "category", "return_count", "total_return_value", "avg_return_ratio"
    )


def high_return_products(star: Star) -> DataFrame:
    """Returns per product; an order's refunds are shared over its lines by sales."""
    return _returns_by_product(star).drop("product_id")


def ranked_vendors(star: Star) -> DataFrame:
    """Vendors with ``vendor_rank`` 1 for the worst return ratio."""
    named = vendor_returns(star).withColumn("vendor_name", F.coalesce("vendor_name", F.lit("Unknown Vendor")))
    worst_first = F.coalesce(-F.col("avg_return_ratio"), F.lit(0.0))
    return number_rows(named, [worst_first, "vendor_name"], "vendor_rank")


def ranked_return_products(star: Star) -> DataFrame:
    # products of equal value and name are told apart by their id
    found = number_rows(_returns_by_product(star), [-F.col("total_return_value"), "product_name", "product_id"], "product_rank")
    return found.drop("product_id")


def revenue_trend(star: Star) -> DataFrame:
    """Revenue by month and region."""
    month = F.floor(F.col("date_key") / 100).cast("int").alias("month_key")
    by_key = star.fact_transactions.filter("order_link_flag").groupBy(month, "region_key").agg(
        exact_sum("sales_amount").alias("total_revenue"), F.count_distinct("order_id").alias("total_orders")
    )
    return by_key.join(star.regions, "region_key", "left").drop("region_key")


def customer_lifetime_value(star: Star) -> DataFrame:
    """Per known customer: orders, revenue, refunds and net value."""
    bought = star.fact_transactions.groupBy("customer_key").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.sum(scaled("sales_amount")).alias("sales"),
        F.min("date_key").alias("first_order_key"),
        F.max("date_key").alias("last_order_key"),
    )
    back = star.fact_returns().groupBy("customer_key").agg(F.sum(scaled("return_amount")).alias("refunds"))
    names = star.dim_customer.filter("customer_key <> -1").select("customer_key", "customer_id", "region", "customer_segment")
    refunds = F.coalesce("refunds", F.lit(0))
    return names.join(bought, "customer_key").join(back, "customer_key", "left").select(
        "customer_id", "region", "customer_segment", "order_count",
        (F.col("sales") / 10000.0).alias("gross_value"),
        (refunds / 10000.0).alias("refund_value"),
        ((F.col("sales") - refunds) / 10000.0).alias("net_value"),
        "first_order_key", "last_order_key",
    )


def return_reasons(star: Star) -> DataFrame:
    """Returns and refunds per reason, with their share of all returns."""
    grouped = star.tables["returns"].groupBy("return_reason").agg(
        F.count(F.lit(1)).alias("return_count"), exact_sum("refund_amount").alias("refund_value")
    )
    return with_share(grouped, "return_count", name="share_pct")


def return_rate(star: Star) -> DataFrame:
    """Returned orders as a percentage of all orders, per region of the customer."""
    orders = star.keyed_orders.select("order_id", "source_region")
    returned = star.tables["returns"].select("order_id").distinct().withColumn("came_back", F.lit(1))
    grouped = orders.join(returned, "order_id", "left").groupBy("source_region").agg(
        F.count(F.lit(1)).alias("total_orders"), F.count("came_back").alias("returned_orders")
    )
    rate = F.floor(F.col("returned_orders") * 100.0 / F.col("total_orders") * 100 + 0.5) / 100.0
    return grouped.withColumn("return_rate_pct", rate)
