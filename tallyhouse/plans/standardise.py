"""Raw tables to standardised tables: one function per entity, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import (
    category_of,
    garbage_to_null,
    money,
    nan_to_null,
    normalise,
    number,
    parse_date,
    percent_or_fraction,
    presence_score,
    rescued_any,
    rescued_text,
    return_date,
    size_list,
    swap_if_state,
    unify,
)

LINEAGE = ["_rescued_data", "_source_file_path", "_source_file_name", "_source_modified_time", "_ingested_at"]
CUSTOMER_ID = ["customer_id", "CustomerID", "cust_id", "customer_identifier"]
COMPLETENESS = {"customer_email": 2, "customer_name": 1, "segment": 1, "region": 1}


def _lineage(df: DataFrame) -> list[str]:
    return [c for c in LINEAGE if c in df.columns]


def drop_lineage(df: DataFrame) -> DataFrame:
    return df.drop(*LINEAGE)


def customers(raw: DataFrame) -> DataFrame:
    city, state = swap_if_state("city", "state")
    return raw.select(
        unify(raw, *CUSTOMER_ID).alias("customer_id"),
        unify(raw, "customer_email", "email_address").alias("customer_email"),
        unify(raw, "customer_name", "full_name").alias("customer_name"),
        normalise(unify(raw, "segment", "customer_segment"), vocab.SEGMENTS).alias("segment"),
        "country",
        city.alias("city"),
        state.alias("state"),
        "postal_code",
        normalise("region", vocab.REGIONS).alias("region"),
        "source_region",
        *_lineage(raw),
    )


def completeness():
    return presence_score(COMPLETENESS)


def orders(raw: DataFrame) -> DataFrame:
    dates = {c: parse_date(c, vocab.ORDER_DATE_FORMATS) for c in vocab.ORDER_DATE_COLUMNS}
    return raw.withColumns(
        {
            **dates,
            "order_status": normalise("order_status", vocab.ORDER_STATUSES),
            "ship_mode": normalise("ship_mode", vocab.SHIP_MODES, default=F.initcap(F.trim("ship_mode"))),
        }
    )


def transactions(raw: DataFrame) -> DataFrame:
    """Ids come from the rescued JSON where a file spells them differently."""
    return raw.select(
        F.coalesce(rescued_any(["Order_ID", "Order_id"]), F.col("Order_id")).alias("order_id"),
        F.coalesce(rescued_any(["Product_ID", "Product_id"]), F.col("Product_id")).alias("product_id"),
        number("Sales").alias("sales"),
        number("Quantity", "int").alias("quantity"),
        percent_or_fraction("discount").alias("discount"),
        F.coalesce(number("profit"), F.lit(0.0)).alias("profit"),
        number("profit").isNull().alias("profit_was_null"),
        F.trim("payment_type").alias("payment_type"),
        number("payment_installments", "int").alias("payment_installments"),
        "source_region",
        *_lineage(raw),
    )


def returns(raw: DataFrame, garbage: list[str] | None = None) -> DataFrame:
    return raw.select(
        unify(raw, "order_id", "OrderId").alias("order_id"),
        garbage_to_null(unify(raw, "return_reason", "reason"), garbage).alias("return_reason"),
        return_date(unify(raw, "return_date", "date_of_return")).alias("return_date"),
        F.coalesce(
            money(rescued_text("refund_amount")),
            nan_to_null(number("refund_amount")),
            nan_to_null(number("amount")),
        ).alias("refund_amount"),
        unify(raw, "return_status", "status").alias("return_status"),
        *_lineage(raw),
    )


def products(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "sizes": size_list("sizes"),
            "dateAdded": parse_date("dateAdded", [vocab.ISO_UTC_FORMAT]),
            "dateUpdated": parse_date("dateUpdated", [vocab.ISO_UTC_FORMAT]),
            "category": category_of("categories"),
            "colors": F.coalesce("colors", F.lit(vocab.NO_COLOR)),
        }
    )


def vendors(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"vendor_id": F.trim("vendor_id"), "vendor_name": F.initcap(F.trim("vendor_name"))})


STANDARDISE = {
    "customers": customers,
    "orders": orders,
    "transactions": transactions,
    "returns": returns,
    "products": products,
    "vendors": vendors,
}
