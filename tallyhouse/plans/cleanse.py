"""Rules per entity, and the clean and quarantine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import kilograms
from ..operators.dedup import best_record, keep_first
from ..operators.rules import Rule, RuleSet
from . import standardise


def _one_of(column: str, values) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def _present(column: str) -> str:
    return f"{column} is not null"


def _filled(column: str) -> str:
    return f"{column} is not null and trim({column}) <> ''"


RULES = {
    "customers": RuleSet(
        "customers",
        (
            Rule("valid_customer_id", _present("customer_id"), "missing_customer_id"),
            Rule("valid_customer_email", _present("customer_email"), "missing_customer_email"),
            Rule("valid_customer_name", _filled("customer_name"), "missing_customer_name"),
            Rule("valid_segment", _one_of("segment", vocab.SEGMENTS), "invalid_segment"),
            Rule("valid_region", _one_of("region", vocab.REGIONS), "invalid_region"),
        ),
    ),
    "orders": RuleSet(
        "orders",
        (
            Rule("valid_order_id", _present("order_id"), "missing_order_id"),
            Rule("valid_customer_id", _present("customer_id"), "missing_customer_id"),
            Rule("valid_purchase_date", _present("order_purchase_date"), "missing_purchase_date"),
            Rule("valid_approved_date", _present("order_approved_at"), "missing_approved_date"),
            Rule("valid_carrier_date", _present("order_delivered_carrier_date"), "missing_carrier_date"),
            Rule("valid_customer_delivery_date", _present("order_delivered_customer_date"), "missing_delivery_date"),
            Rule("valid_order_status", _one_of("order_status", vocab.ORDER_STATUSES), "invalid_order_status"),
            Rule("valid_ship_mode", _one_of("ship_mode", vocab.SHIP_MODE_DOMAIN), "invalid_ship_mode"),
        ),
    ),
    "products": RuleSet(
        "products",
        (
            Rule("valid_product_id", _present("product_id"), "missing_product_id"),
            Rule("valid_product_name", _filled("product_name"), "missing_product_name"),
            Rule("valid_category", _filled("categories"), "missing_category"),
        ),
    ),
    "returns": RuleSet(
        "returns",
        (
            Rule("valid_order_id", _present("order_id"), "missing_order_id"),
            Rule("valid_return_date", _present("return_date"), "missing_return_date"),
            Rule("valid_refund_amount", "refund_amount > 0", "missing_refund_amount"),
            Rule("valid_return_reason", _present("return_reason"), "missing_return_reason"),
        ),
    ),
    "transactions": RuleSet(
        "transactions",
        (
            Rule("valid_order_id", _present("order_id"), "missing_order_id"),
            Rule("valid_product_id", _present("product_id"), "missing_product_id"),
            Rule("valid_sales", "sales > 0", "invalid_sales"),
            Rule("valid_quantity", "quantity > 0", "invalid_quantity"),
            Rule("valid_discount", "discount between 0 and 1", "invalid_discount"),
            Rule("valid_payment_type", _present("payment_type"), "missing_payment_type"),
            Rule("valid_installments", "payment_installments > 0", "invalid_installments"),
        ),
    ),
    "vendors": RuleSet(
        "vendors",
        (
            Rule("valid_vendor_id", _filled("vendor_id"), "missing_vendor_id"),
            Rule("valid_vendor_name", _filled("vendor_name"), "missing_vendor_name"),
            # a missing id is not also a malformed one
            Rule(
                "valid_vendor_id_fmt",
                f"vendor_id is null or vendor_id rlike '{vocab.VENDOR_ID_PATTERN}'",
                "invalid_vendor_id_format",
            ),
        ),
    ),
}

CUSTOMER_TIE_BREAK = ["source_region"]


def tagged(raw: DataFrame, entity: str) -> DataFrame:
    """Standardised rows with ``is_quarantined`` and ``issue_type``."""
    return RULES[entity].tag(standardise.STANDARDISE[entity](raw))


def quarantine(raw: DataFrame, entity: str) -> DataFrame:
    return RULES[entity].quarantine(standardise.STANDARDISE[entity](raw))


def one_per_key(good: DataFrame, entity: str) -> DataFrame:
    """One row per key, where the entity has one: the smallest in a total order, so winners of parts can be merged."""
    if entity == "customers":
        return best_record(good, "customer_id", standardise.completeness(), CUSTOMER_TIE_BREAK)
    if entity == "orders":
        return keep_first(good, ["order_id"], ["source_region"])
    if entity == "products":
        return keep_first(good, ["product_id"])
    if entity == "vendors":
        return keep_first(good, ["vendor_id"])
    return good


def finish(good: DataFrame, entity: str) -> DataFrame:
    """Last projections and dedup on rows that passed the rules."""
    good = standardise.drop_lineage(good)
    if entity == "products":
        good = good.withColumns({"product_name": F.trim("product_name"), "weight": kilograms("weight")})
    return one_per_key(good, entity)


def clean(raw: DataFrame, entity: str) -> DataFrame:
    """Valid rows, one per key where the entity has one."""
    return finish(RULES[entity].clean(standardise.STANDARDISE[entity](raw)), entity)
