"""Star schema: five dimensions and two facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import date_key, exact_sum
from ..operators.lookup import look_up, look_up_sparse, small_side
from ..operators.numbering import number_rows

UNKNOWN_CUSTOMER = {
    "customer_key": vocab.UNKNOWN_KEY,
    "customer_id": vocab.UNKNOWN_TEXT,
    "customer_name": vocab.UNKNOWN_TEXT,
    "customer_email": None,
    "customer_segment": vocab.UNKNOWN_TEXT,
    "region": vocab.UNKNOWN_TEXT,
    "country": vocab.UNKNOWN_TEXT,
    "city": None,
    "state": None,
    "source_region": vocab.UNKNOWN_TEXT,
}


def dim_date(orders: DataFrame) -> DataFrame:
    days = orders.select(F.col("order_purchase_date").alias("date")).filter("date is not null").distinct()
    return days.select(
        "date",
        date_key("date").alias("date_key"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
    )


def dim_region(customers: DataFrame) -> DataFrame:
    """At most one row per region name the rules allow."""
    names = customers.select(F.col("region").alias("source_region")).distinct()
    return number_rows(names, ["source_region"], "region_key")


def dim_product(products: DataFrame) -> DataFrame:
    return number_rows(products, ["product_id"], "product_key")


def dim_vendor(vendors: DataFrame) -> DataFrame:
    return number_rows(vendors, ["vendor_id"], "vendor_key")


def dim_customer(customers: DataFrame) -> DataFrame:
    known = number_rows(customers.filter("customer_id is not null"), ["customer_id"], "customer_key").select(
        "customer_key", "customer_id", "customer_name", "customer_email", F.col("segment").alias("customer_segment"),
        "region", "country", "city", "state", "source_region",
    )
    spark = customers.sparkSession
    unknown = spark.createDataFrame([tuple(UNKNOWN_CUSTOMER.values())], known.schema)
    return known.unionByName(unknown)


class Star:
    """Star schema over clean tables.

    ``keep(df, name)`` may store a table the first time it is needed and return
    the stored one, so that reports read columns of a table instead of
    computing the joins again. Without it everything stays one lazy plan.

    Dimension look-ups happen on orders, which are fewer than lines and
    returns; the facts then join the keyed orders once, on ``order_id``.
    ``region_source`` is ``"customer"`` (the customer's sales region) or
    ``"order"`` (the regional system that sent the order).
    """

    def __init__(
        self,
        tables: dict[str, DataFrame],
        region_source: str = "customer",
        keep: Callable[[DataFrame, str], DataFrame] | None = None,
    ):
        self.tables = tables
        self.region_source = region_source
        self._keep = keep or (lambda df, name: df)
        self._returns: dict[str, DataFrame] = {}

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._keep(dim_date(self.tables["orders"]), "dim_date")

    @cached_property
    def dim_region(self) -> DataFrame:
        if self.region_source == "order":
            names = self.tables["orders"].select(F.col("source_region").alias("region"))
        else:
            names = self.tables["customers"]
        return self._keep(dim_region(names), "dim_region")

    @cached_property
    def regions(self) -> DataFrame:
        """``dim_region`` for joins: few rows, and few keys that would all meet in a few shuffle partitions."""
        return small_side(self.dim_region)

    @cached_property
    def dim_product(self) -> DataFrame:
        return self._keep(dim_product(self.tables["products"]), "dim_product")

    @cached_property
    def dim_vendor(self) -> DataFrame:
        return self._keep(dim_vendor(self.tables["vendors"]), "dim_vendor")

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self._keep(dim_customer(self.tables["customers"]), "dim_customer")

    @cached_property
    def keyed_orders(self) -> DataFrame:
        """Orders with customer, vendor and region keys, one row per order."""
        orders = self.tables["orders"].select(
            "order_id", "customer_id", "vendor_id", "order_purchase_date", F.col("source_region").alias("order_region")
        )
        known = self.dim_customer.filter(F.col("customer_key") != vocab.UNKNOWN_KEY)
        orders = look_up(orders, known, "customer_id", ["customer_key", "region"])
        orders = look_up(orders, self.dim_vendor, "vendor_id", ["vendor_key"])
        name = "order_region" if self.region_source == "order" else "region"
        orders = orders.withColumn("source_region", F.col(name))
        return self._keep(look_up(orders, self.regions, "source_region", ["region_key"]), "keyed_orders")

    @cached_property
    def fact_transactions(self) -> DataFrame:
        lines = self.tables["transactions"].filter("sales > 0").select("order_id", "product_id", "sales")
        orders = self.keyed_orders.select("order_id", "customer_key", "vendor_key", "region_key", "order_purchase_date")
        linked = lines.join(orders, "order_id", "left")
        products = self.dim_product.select("product_id", "product_key")
        facts = linked.join(products, "product_id", "left").select(
            "order_id",
            F.coalesce("customer_key", F.lit(vocab.UNKNOWN_KEY)).alias("customer_key"),
            "product_key",
            "vendor_key",
            date_key("order_purchase_date").alias("date_key"),
            "region_key",
            F.col("sales").alias("sales_amount"),
            F.col("order_purchase_date").isNotNull().alias("order_link_flag"),
        )
        return self._keep(facts, "fact_transactions")

    @cached_property
    def order_sales(self) -> DataFrame:
        """Lines added up per order; the product, and its key, are kept only where it is the same on all lines."""
        lines = self.tables["transactions"]
        sales = lines.groupBy("order_id").agg(
            exact_sum("sales").alias("sales"),
            F.when(F.min("product_id") == F.max("product_id"), F.min("product_id")).alias("product_id"),
        )
        # most orders have several products, so most rows have none to look up
        return self._keep(look_up_sparse(sales, self.dim_product, "product_id", ["product_key"], ["order_id"]), "order_sales")

    @cached_property
    def line_sales(self) -> DataFrame:
        """Lines with the keys of their products."""
        lines = self.tables["transactions"].select("order_id", "product_id", "sales")
        return look_up_sparse(lines, self.dim_product, "product_id", ["product_key"], ["order_id"])

    def fact_returns(self, grain: str = "per_return") -> DataFrame:
        """Returns with order, customer and sales context.

        ``per_return`` has one row per return and compares the refund with the
        whole order. ``per_line`` has one row per return and line of its order,
        and compares the refund with that line.
        """
        if grain == "per_line":
            sold = self.line_sales
        elif grain == "per_return":
            sold = self.order_sales
        else:
            raise ValueError(f"unknown grain: {grain}")
        if grain not in self._returns:
            facts = self.enrich_returns(self.tables["returns"], sold)
            self._returns[grain] = self._keep(facts, f"fact_returns_{grain}")
        return self._returns[grain]

    def enrich_returns(self, returns: DataFrame, sold: DataFrame) -> DataFrame:
        """Left joins of returns, batch or stream, with static tables, and the flags.

        ``sold`` has the key of the product already, so nothing is dealt by the product of a return, which is mostly NULL.
        """
        orders = self.keyed_orders.select(
            "order_id", "customer_id", "customer_key", "vendor_key", "region_key", "order_purchase_date",
            F.lit(True).alias("has_order_flag"),
        )
        joined = (
            returns.select("order_id", "return_reason", "return_date", "refund_amount")
            .join(orders, "order_id", "left")
            .join(sold.select("order_id", "product_key", "sales"), "order_id", "left")
        )
        refund, sales = F.col("refund_amount"), F.col("sales")
        has_order = F.coalesce("has_order_flag", F.lit(False))
        key = F.coalesce("customer_key", F.lit(vocab.UNKNOWN_KEY))
        ratio = F.try_divide(refund, sales)
        days = F.datediff("return_date", "order_purchase_date")
        quality = (
            F.when(refund.isNull(), "MISSING_AMOUNT")
            .when(refund <= 0, "INVALID_AMOUNT")
            .when(key == vocab.UNKNOWN_KEY, "MISSING_CUSTOMER")
            .when(days < 0, "NEGATIVE_DAYS")
            .otherwise("VALID")
        )
        return joined.select(
            "order_id",
            "customer_id",
            key.alias("customer_key"),
            "product_key",
            "vendor_key",
            date_key("return_date").alias("date_key"),
            "region_key",
            refund.alias("return_amount"),
            sales.alias("transaction_amount"),
            "order_purchase_date",
            "return_date",
            "return_reason",
            has_order.alias("has_order_flag"),
            sales.isNotNull().alias("has_transaction_flag"),
            sales.isNull().alias("missing_txn_flag"),
            (refund > vocab.HIGH_RETURN_OVER).alias("high_return_flag"),
            (refund > 0).alias("is_valid_return"),
            quality.alias("data_quality_flag"),
            ratio.alias("return_to_purchase_ratio"),
            (ratio > vocab.SUSPICIOUS_RATIO_OVER).alias("suspicious_ratio_flag"),
            (~has_order).alias("return_without_order_flag"),
            days.alias("days_to_return"),
            (days <= vocab.QUICK_RETURN_DAYS).alias("quick_return_flag"),
        )
