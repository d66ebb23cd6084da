"""Double-count audit: how often customers and orders occur across regions, and what that costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent, scaled, unify
from ..operators.dedup import group_sizes
from .standardise import CUSTOMER_ID


def _regions():
    return F.array_join(F.array_sort(F.collect_set("source_region")), ",")


def order_copies(raw_orders: DataFrame) -> DataFrame:
    """(copies, num_orders, region_combinations)."""
    sizes = group_sizes(raw_orders, F.col("order_id"), {"regions": _regions()})
    return sizes.groupBy("copies").agg(
        F.count(F.lit(1)).alias("num_orders"),
        F.array_join(F.array_sort(F.collect_set("regions")), " | ").alias("region_combinations"),
    )


def customer_copies(raw_customers: DataFrame) -> DataFrame:
    sizes = group_sizes(raw_customers, unify(raw_customers, *CUSTOMER_ID))
    return sizes.groupBy("copies").agg(F.count(F.lit(1)).alias("num_customers"))


def shared_customers(raw_customers: DataFrame) -> DataFrame:
    sizes = group_sizes(raw_customers, unify(raw_customers, *CUSTOMER_ID), {"regions": _regions()})
    return sizes.groupBy("regions").agg(F.count(F.lit(1)).alias("num_customers"))


def email_agreement(raw_customers: DataFrame) -> DataFrame:
    mail = unify(raw_customers, "customer_email", "email_address")
    sizes = group_sizes(raw_customers, unify(raw_customers, *CUSTOMER_ID), {"copies_with_email": F.count(mail)})
    return sizes.groupBy("copies", "copies_with_email").agg(F.count(F.lit(1)).alias("num_customers"))


def overstatement(raw_customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Revenue counted once per customer copy (the manual way) against counted once per order.

    Revenue per order and copies per customer are aggregated before they meet,
    so no order is multiplied by copies in between.
    """
    per_order = lines.groupBy("order_id").agg(F.sum(scaled("sales")).alias("sales"))
    per_customer = (
        orders.select("order_id", "customer_id")
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("sales").alias("sales"))
    )
    copies = raw_customers.groupBy(unify(raw_customers, *CUSTOMER_ID).alias("customer_id")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    both = per_customer.join(copies, "customer_id").agg(
        F.sum(F.col("sales") * F.col("copies")).alias("naive"), F.sum("sales").alias("matched")
    )
    return both.select(
        (F.col("naive") / 10000.0).alias("naive_revenue"),
        (F.col("matched") / 10000.0).alias("matched_revenue"),
        percent(F.col("naive") - F.col("matched"), F.col("matched")).alias("overstatement_pct"),
    )


def lineage_trace(raw_customers: DataFrame, raw_orders: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Revenue with the files it rests on: order file, customer file, revenue, orders."""
    per_order = lines.groupBy("order_id").agg(F.sum(scaled("sales")).alias("sales"))
    order_files = raw_orders.groupBy("order_id").agg(F.min("_source_file_name").alias("order_file"))
    customer_files = raw_customers.groupBy(unify(raw_customers, *CUSTOMER_ID).alias("customer_id")).agg(
        F.min("_source_file_name").alias("customer_file")
    )
    traced = (
        orders.select("order_id", "customer_id")
        .join(per_order, "order_id")
        .join(order_files, "order_id")
        .join(customer_files, "customer_id", "left")
    )
    return traced.groupBy("order_file", "customer_file").agg(
        (F.sum("sales") / 10000.0).alias("revenue"), F.count(F.lit(1)).alias("order_count")
    )
