"""The raw entities: where their files are, which columns they have, which types are forced."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Entity:
    name: str
    format: str
    glob: str
    columns: tuple[str, ...]
    hints: dict[str, str] = field(default_factory=dict)
    multiline: bool = False


ENTITIES = {
    e.name: e
    for e in [
        Entity(
            "customers",
            "csv",
            "customers_*.csv",
            (
                "customer_id", "CustomerID", "cust_id", "customer_identifier", "customer_email", "email_address",
                "customer_name", "full_name", "segment", "customer_segment", "country", "city", "state",
                "postal_code", "region",
            ),
            {"postal_code": "string"},
        ),
        Entity(
            "orders",
            "csv",
            "orders_*.csv",
            (
                "order_id", "customer_id", "vendor_id", "order_purchase_date", "order_approved_at",
                "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
                "order_status", "ship_mode",
            ),
        ),
        Entity(
            "transactions",
            "csv",
            "transactions_*.csv",
            (
                "Order_id", "Product_id", "Sales", "Quantity", "discount", "profit", "payment_type",
                "payment_installments",
            ),
            {"profit": "double"},
        ),
        Entity(
            "returns",
            "json",
            "returns_*.json",
            (
                "order_id", "OrderId", "return_reason", "reason", "return_date", "date_of_return", "refund_amount",
                "amount", "return_status", "status",
            ),
            {"refund_amount": "double", "amount": "double"},
            multiline=True,
        ),
        Entity(
            "products",
            "json",
            "products*.json",
            (
                "product_id", "product_name", "categories", "sizes", "colors", "weight", "upc", "manufacturer",
                "dimension", "dateAdded", "dateUpdated",
            ),
            multiline=True,
        ),
        Entity("vendors", "csv", "vendors*.csv", ("vendor_id", "vendor_name")),
    ]
}
