"""Landing files (CSV, multi-line JSON) written by Spark from the derived raw tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.entities import ENTITIES
from .raw import raw_frame

ROWS_PER_DOCUMENT = 20_000

# columns that a regional system's file has, in its own order; the others are absent
_CUSTOMER_REST = ["country", "city", "state", "postal_code", "region", "loyalty"]
LAYOUTS = {
    "customers_1": ["customer_id", "customer_email", "customer_name", "segment", *_CUSTOMER_REST],
    "customers_2": ["CustomerID", "email_address", "customer_name", "segment", *_CUSTOMER_REST],
    "customers_3": ["full_name", "cust_id", "customer_segment", "customer_email", *_CUSTOMER_REST],
    "customers_4": ["customer_id", "customer_email", "customer_name", "customer_segment", *_CUSTOMER_REST],
    "customers_5": ["customer_id", "full_name", "segment", *_CUSTOMER_REST],
    "customers_6": ["region", "customer_identifier", "customer_email", "customer_name", "segment", *_CUSTOMER_REST[:-2], "loyalty"],
    "transactions_3": ["Order_ID", "Product_ID", "Sales", "Quantity", "discount", "profit", "payment_type", "payment_installments"],
    "returns_1": ["order_id", "return_reason", "return_date", "refund_amount", "return_status"],
    "returns_2": ["OrderId", "amount", "reason", "date_of_return", "status"],
}


def _as_text(df: DataFrame, entity: str) -> DataFrame:
    """Raw rows with the rescued values back in the columns they came from."""
    rescued = F.from_json("_rescued_data", "map<string,string>")
    if entity == "customers":
        return df.withColumn("loyalty", rescued["loyalty"])
    if entity == "transactions":
        return df.withColumns(
            {
                "order_key": F.coalesce(rescued["Order_ID"], rescued["Order_id"]),
                "product_key": F.coalesce(rescued["Product_ID"], rescued["Product_id"]),
                "profit": F.col("profit").cast("decimal(18,2)").cast("string"),
            }
        )
    if entity == "returns":
        plain = F.when(F.isnan("refund_amount"), F.lit("NaN")).otherwise(
            F.when(~F.isnan("refund_amount"), F.col("refund_amount")).cast("decimal(18,2)").cast("string")
        )
        return df.withColumns(
            {
                "refund_amount": F.coalesce(rescued["refund_amount"], plain),
                "amount": F.col("amount").cast("decimal(18,2)").cast("string"),
            }
        )
    return df


def _documents(rows: DataFrame) -> DataFrame:
    """(value): JSON arrays of up to ``ROWS_PER_DOCUMENT`` rows, put together in the tasks that have the rows."""

    # nested, so that tasks need no installed copy of this package
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def document(some: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(some) + "]"])], ["value"])

        some: list[str] = []
        for batch in batches:
            some += batch.column(0).to_pylist()
            while len(some) >= ROWS_PER_DOCUMENT:
                yield document(some[:ROWS_PER_DOCUMENT])
                some = some[ROWS_PER_DOCUMENT:]
        if some:
            yield document(some)

    return rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string")


def write_landing(spark: SparkSession, sf_dir: str, root: str, entities: list[str] | None = None) -> str:
    """All regional files of the entities, below ``root``; file names begin with the system's name."""
    for entity in entities or list(ENTITIES):
        spec = ENTITIES[entity]
        rows = _as_text(raw_frame(spark, sf_dir, entity), entity)
        for file, folder in _systems(entity):
            stem, _, kind = file.partition(".")
            part = rows.filter(F.col("_source_file_name") == file)
            if stem == "transactions_3":
                part = part.drop("Order_id", "Product_id").withColumnsRenamed({"order_key": "Order_ID", "product_key": "Product_ID"})
            part = part.select(*LAYOUTS.get(stem, spec.columns))
            # the file names start with the system's name instead of "part"
            named = {"mapreduce.output.basename": stem}
            if kind == "csv":
                writer = part.write.mode("append").options(**named).option("header", "true")
                writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{root}/{folder}")
            else:
                documents = _documents(part)
                # one bare value per file: separator and quote never occur in it
                bare = {"sep": "\u0001", "quote": "\u0002", "escape": "\u0002", "extension": "json", "maxRecordsPerFile": 1}
                documents.write.mode("append").options(**named, **bare).csv(f"{root}/{folder}")
    return root


def _systems(entity: str) -> list[tuple[str, str]]:
    """(file name, folder) of each regional system."""
    return {
        "customers": [(f"customers_{i}.csv", f"Region {i}") for i in range(1, 7)],
        "orders": [(f"orders_{i}.csv", f"Region {i}") for i in (1, 3, 5)],
        "transactions": [("transactions_2.csv", "Region 2"), ("transactions_3.csv", ""), ("transactions_4.csv", "Region 4")],
        "returns": [("returns_1.json", "Region 6"), ("returns_2.json", "")],
        "products": [("products.json", "")],
        "vendors": [("vendors.csv", "")],
    }[entity]
