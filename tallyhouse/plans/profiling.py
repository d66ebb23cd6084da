"""Profiling of raw tables, each in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import date_shape_name, money, nan_to_null, number, parse_timestamp, percent_or_fraction, unify
from ..operators.dedup import repeated
from ..operators.lookup import orphans
from ..operators.ranking import few_values
from ..operators.report import counts_by, finish_checks, stack, with_share
from .standardise import CUSTOMER_ID

FILE = "_source_file_name"


#: A sketch of this many address bits is off by 0.6 % at most times; columns it puts this close to one value per row may be keys.
SKETCH_BITS, NEAR_KEY = 14, 0.97


def distinct_sketch(col: Column, bits: int = SKETCH_BITS) -> Column:
    """A mergeable sketch of a column's distinct values, of any type; NULL is not among them."""
    return F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), bits)


def sketch_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, total_rows, nulls, estimate) from one aggregate: each task sends one row of sketches."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col.isNull()).alias(f"n{i}"), F.hll_sketch_estimate(distinct_sketch(col)).alias(f"d{i}")]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("estimate")) for i, c in enumerate(names)]
    return df.agg(*aggs).select("total_rows", F.inline(F.array(*cells)))


def exact_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, total_rows, nulls, distinct_values): each column is read alone and once, its values combine in the tasks."""

    def one(c: str) -> DataFrame:
        col = F.col(f"`{c}`")
        counted = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(col.isNull()).alias("nulls"), F.count_distinct(col).alias("n"))
        return counted.select(F.lit(c).alias("column_name"), "total_rows", "nulls", (F.col("n") + (F.col("nulls") > 0).cast("long")).alias("distinct_values"))

    return stack([one(c) for c in names])


def profile(df: DataFrame, mostly_null_pct: float = 80.0, exact_up_to: int | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, column_type, total_rows, nulls, null_pct, distinct_values, flag).

    Every column is counted exactly, whatever the size of the table. Estimates are for callers who ask for them: with
    ``approximate`` sketches of all columns come from one pass; with ``exact_up_to`` exact counts follow for columns that
    may be keys, since those need them for their flag, and for columns with up to that many values. As in SQL's
    ``distinct``, NULL counts as one value.
    """
    spark, names, kinds = df.sparkSession, df.columns, dict(df.dtypes)
    if approximate or exact_up_to is not None:
        # one row for each column
        found = {r.column_name: r for r in sketch_profile(df, names).collect()}
        may_be_key = [c for c in names if not found[c].nulls and found[c].estimate >= NEAR_KEY * found[c].total_rows]
        sure = [] if approximate else [c for c in names if found[c].estimate <= exact_up_to or c in may_be_key]
        rows = [(c, found[c].total_rows, found[c].nulls, found[c].estimate + (found[c].nulls > 0)) for c in names if c not in sure]
        rough = spark.createDataFrame(rows, "column_name string, total_rows long, nulls long, distinct_values long")
        long = rough.unionByName(exact_profile(df, sure)) if sure else rough
    else:
        long = exact_profile(df, names)
    kind = F.col("column_name")
    for c in names:
        kind = F.when(F.col("column_name") == c, kinds[c]).otherwise(kind)
    pct = F.floor(F.col("nulls") * 100.0 / F.col("total_rows") * 10 + 0.5) / 10.0
    flag = (
        F.when(F.col("nulls") == F.col("total_rows"), "all_null")
        .when(F.col("null_pct") > mostly_null_pct, "mostly_null")
        .when((F.col("distinct_values") == F.col("total_rows")) & (F.col("nulls") == 0), "candidate_key")
        .when(F.col("distinct_values") == 1, "constant")
        .when((F.col("column_name") == "_rescued_data") & (F.col("nulls") < F.col("total_rows")), "rescued")
        .otherwise("")
    )
    return long.withColumn("null_pct", pct).select(
        "column_name", kind.alias("column_type"), "total_rows", "nulls", "null_pct", "distinct_values", flag.alias("flag")
    )


def by_source_file(df: DataFrame) -> DataFrame:
    return df.groupBy(FILE, "source_region").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.to_date(F.min("_ingested_at")).alias("first_ingested"),
        F.to_date(F.max("_ingested_at")).alias("last_ingested"),
    )


def rescued_by_file(df: DataFrame) -> DataFrame:
    return counts_by(df.filter("_rescued_data is not null"), FILE, name="rescued_rows")


def rescued_sample(df: DataFrame, k: int = 20) -> DataFrame:
    rows = df.filter("_rescued_data is not null").select(FILE, "source_region", "_rescued_data")
    return rows.orderBy(FILE, "source_region", "_rescued_data").limit(k)


def rescued_keys(df: DataFrame) -> DataFrame:
    """(file, key, rows): every key that occurs in the rescued JSON."""
    found = F.from_json("_rescued_data", "map<string,string>")
    keys = df.filter("_rescued_data is not null").select(FILE, F.explode(F.map_keys(found)).alias("rescued_key"))
    return counts_by(keys, FILE, "rescued_key")


def recovery_rate(df: DataFrame, recovered: dict[str, Column]) -> DataFrame:
    rows = df.filter("_rescued_data is not null")
    aggs = [F.count(F.lit(1)).alias("total_rescued")]
    for name, value in recovered.items():
        aggs += [F.count(value).alias(f"{name}_recovered"), F.count_if(value.isNull()).alias(f"{name}_lost")]
    return rows.agg(*aggs)


def variant_matrix(df: DataFrame, variants: list[str], by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Non-null rows of each column variant per file or region."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(f"`{v}`").alias(f"has_{v}") for v in variants],
        *[F.count_if(c).alias(n) for n, c in (extra or {}).items()],
    )


def value_distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(value, row_count, pct, files) of the non-null values."""
    rows = df.select(value.alias(name), FILE).filter(F.col(name).isNotNull())
    grouped = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array_join(F.array_sort(F.collect_set(F.regexp_extract(FILE, r"^([^.-]+)", 1))), ",").alias("systems"),
    )
    return with_share(grouped, "row_count")


def swapped_cities(df: DataFrame) -> DataFrame:
    rows = df.filter(F.col("city").isin(vocab.US_STATES))
    return rows.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("swapped_rows"),
        # at most as many values as there are states
        F.array_join(F.array_sort(F.collect_set("city")), ",").alias("states"),
    )


def date_format_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """(file, column, format, rows, three sample values)."""
    long = df.select(FILE, *columns).unpivot(FILE, columns, "column_name", "text")
    shaped = long.withColumn("date_format", date_shape_name("text"))
    counted = counts_by(shaped, FILE, "column_name", "date_format")
    samples = few_values(shaped, [FILE, "column_name", "date_format"], "text")
    return counted.join(samples, [FILE, "column_name", "date_format"], "left")


def castability(df: DataFrame, column: str, kind: str) -> DataFrame:
    value = number(column, kind)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(value.isNull()).alias("non_numeric"),
        F.min(value).cast("double").alias("min_value"),
        F.max(value).cast("double").alias("max_value"),
        F.count_if(value <= 0).alias("zero_or_negative"),
    ).select(F.lit(column).alias("column_name"), "*")


def discount_format_census(df: DataFrame) -> DataFrame:
    d = F.col("discount")
    kind = (
        F.when(d.isNull(), "NULL")
        .when(d.endswith("%"), "PERCENT")
        .when(number(d).isNotNull(), "DECIMAL")
        .otherwise("OTHER")
    )
    return counts_by(df, FILE, kind.alias("discount_format"))


def discount_range(df: DataFrame) -> DataFrame:
    plain = df.filter(~F.col("discount").endswith("%")).select(number("discount").alias("d"))
    return plain.agg(
        F.count_if(F.expr("d > 1")).alias("above_one"),
        F.count_if(F.expr("d < 0")).alias("negative"),
        F.min("d").alias("min_discount"),
        F.max("d").alias("max_discount"),
    )


def profit_distribution(df: DataFrame) -> DataFrame:
    p = F.col("profit")
    return df.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(p.isNull()).alias("null_profit"),
        F.count_if(p < 0).alias("negative_profit"),
        F.count_if(p == 0).alias("zero_profit"),
        F.count_if(p > 0).alias("positive_profit"),
        F.min(p).alias("min_profit"),
        F.max(p).alias("max_profit"),
    )


def loss_legitimacy(df: DataFrame) -> DataFrame:
    """Losses with a discount are expected, losses without one are suspicious."""
    d = percent_or_fraction("discount")
    return df.filter("profit < 0").agg(
        F.count(F.lit(1)).alias("negative_profit_rows"),
        F.count_if(d > 0).alias("with_discount"),
        F.count_if(d == 0).alias("without_discount"),
    )


def nan_census(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col(c).isNull()).alias("null_rows"),
            F.count_if(F.isnan(c)).alias("nan_rows"),
            F.count(nan_to_null(c)).alias("number_rows"),
        ).select(F.lit(c).alias("column_name"), "*")
        for c in columns
    ]
    return stack(parts)


def domain_listing(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(column, value, rows) of the given text columns, one pass."""
    by = by or []
    long = df.select(*by, *columns).unpivot(by, columns, "column_name", "value").filter("value is not null")
    return counts_by(long, *by, "column_name", "value")


def upc_formats(df: DataFrame) -> DataFrame:
    upc = F.col("upc")
    kind = (
        F.when(upc.isNull(), "NULL")
        .when(upc.rlike(r"^\d+\.\d+E[+\-]\d+$"), "SCIENTIFIC_NOTATION")
        .when(upc.rlike(r"^\d{10,13}$"), "PROPER_NUMERIC")
        .otherwise("OTHER")
    )
    return counts_by(df, kind.alias("upc_format"))


def prefix_by_category(df: DataFrame, category: Column) -> DataFrame:
    return counts_by(df, F.substring("product_id", 1, 3).alias("prefix"), category.alias("category"))


def _regions():
    return F.array_join(F.array_sort(F.collect_set("source_region")), ",").alias("regions")


def in_several_regions(df: DataFrame, key: Column, name: str, counted: dict[str, Column] | None = None) -> DataFrame:
    """Keys seen in more than one region. The region set is as small as the number of regional systems."""
    rows = df.withColumn("_key", key).filter("_key is not null")
    grouped = rows.groupBy(F.col("_key").alias(name)).agg(
        F.size(F.collect_set("source_region")).alias("region_count"),
        F.count(F.lit(1)).alias("total_rows"),
        *[c.alias(n) for n, c in (counted or {}).items()],
        _regions(),
    )
    return grouped.filter("region_count > 1")


def line_order_id() -> Column:
    return F.coalesce(
        "Order_id", F.get_json_object("_rescued_data", "$.Order_ID"), F.get_json_object("_rescued_data", "$.Order_id")
    )


def email_key(df: DataFrame) -> Column:
    return F.lower(F.trim(unify(df, "customer_email", "email_address")))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return repeated(df.filter(F.col(key).isNotNull()), F.col(key), key)


def date_sequence(df: DataFrame, today: Column | None = None) -> DataFrame:
    """(check, fails): approved before purchase, delivered before approved, purchase in the future."""
    stamps = {n: parse_timestamp(c, vocab.SEQUENCE_FORMATS) for n, c in SEQUENCE.items()}
    rows = df.select(*[c.alias(n) for n, c in stamps.items()]).filter("bought is not null and approved is not null")
    counted = rows.agg(
        F.count_if(F.expr("approved < bought")).alias("approved_before_purchase"),
        F.count_if(F.expr("delivered < approved")).alias("delivered_before_approved"),
        F.count_if(F.col("bought") > (today if today is not None else F.current_timestamp())).alias("purchase_in_future"),
    )
    return counted.unpivot([], counted.columns, "check_name", "fails")


SEQUENCE = {"bought": "order_purchase_date", "approved": "order_approved_at", "delivered": "order_delivered_customer_date"}


#: What a row says about a key of a check: rows that depend on it, and whether the key is sound.
EVIDENCE = "check_group string, label string, consequence string, key string, rows int, known boolean"


def _evidence(group: str, label: str, consequence: str, key: Column, rows: int, known: Column | bool) -> Column:
    values = [F.lit(group), F.lit(label), F.lit(consequence), key.cast("string"), F.lit(rows), F.lit(known)]
    names = [field.split()[0] for field in EVIDENCE.split(", ")]
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])


def readiness(raw: dict[str, DataFrame]) -> DataFrame:
    """22 checks of the raw layer in long format; each table is read once, and one shuffle serves all checks.

    Every row of a table gives one piece of evidence for each of its checks: a key and whether that is known to be sound.
    A test of a row has two keys, passed and failed. A reference has the child's value as key, which only rows of the
    parent table make known. Rows of keys that nothing makes known fail; for a unique key, all rows but one.
    """
    c, o, t, r, p, v = (raw[e] for e in ["customers", "orders", "transactions", "returns", "products", "vendors"])
    bought, approved = (parse_timestamp(SEQUENCE[n], vocab.SEQUENCE_FORMATS) for n in ["bought", "approved"])
    discount = percent_or_fraction("discount")
    garbage = F.upper(F.trim("reason")).isin(vocab.GARBAGE_WIDE)
    customer, back = unify(c, *CUSTOMER_ID), unify(r, "order_id", "OrderId")

    def test(group: str, label: str, fails: Column, then: str) -> Column:
        failed = F.coalesce(fails, F.lit(False))
        return _evidence(group, label, then, failed, 1, ~failed)

    def child(label: str, key: Column, then: str) -> Column:
        return _evidence("references", label, then, key, 1, False)

    def parent(label: str, key: Column, then: str) -> Column:
        # a missing key is no parent of missing ones
        return _evidence("references", label, then, F.coalesce(key, F.lit("")), 0, key.isNotNull())

    evidence = {
        "customers": (c, [
            test("customers", "canonical id resolvable", customer.isNull(), "quarantine"),
            test("customers", "email present", unify(c, "customer_email", "email_address").isNull(), "warn"),
            test("customers", "city is not a state", F.col("city").isin(vocab.US_STATES), "swap"),
            parent("orders to customers", customer, "quarantine"),
        ]),
        "orders": (o, [
            test("orders", "order_id not null", F.col("order_id").isNull(), "quarantine"),
            test("orders", "customer_id not null", F.col("customer_id").isNull(), "quarantine"),
            test("orders", "purchase date readable", bought.isNull(), "quarantine"),
            test("orders", "approved not before purchase", approved < bought, "quarantine"),
            child("orders to customers", F.col("customer_id"), "quarantine"),
            child("orders to vendors", F.col("vendor_id"), "warn"),
            parent("transactions to orders", F.col("order_id"), "quarantine"),
            parent("returns to orders", F.col("order_id"), "quarantine"),
        ]),
        "transactions": (t, [
            test("transactions", "order_id resolvable", line_order_id().isNull(), "quarantine"),
            test("transactions", "sales castable", number("Sales").isNull(), "quarantine"),
            test("transactions", "discount in range", (discount > 1) | (discount < 0), "quarantine"),
            test("transactions", "negative profit", F.col("profit") < 0, "warn"),
            child("transactions to orders", line_order_id(), "quarantine"),
        ]),
        "returns": (r, [
            test("returns", "order_id resolvable", back.isNull(), "quarantine"),
            test("returns", "return date not the text NULL", F.upper(F.trim("date_of_return")) == "NULL", "convert"),
            test("returns", "reason not garbage", garbage, "convert"),
            test("returns", "refund amount not NaN", F.isnan("refund_amount"), "convert"),
            child("returns to orders", back, "quarantine"),
        ]),
        "products": (p, [
            test("products", "product_id not null", F.col("product_id").isNull(), "quarantine"),
            _evidence("products", UNIQUE, "deduplicate", F.col("product_id"), 1, True),
        ]),
        "vendors": (v, [
            test("vendors", "vendor_id not null", F.col("vendor_id").isNull(), "quarantine"),
            parent("orders to vendors", F.trim("vendor_id"), "warn"),
        ]),
    }
    rows = stack([df.select(F.inline(F.array(*found))) for df, found in evidence.values()])
    of = ["check_group", "label", "consequence"]
    keys = rows.groupBy(*of, "key").agg(F.sum("rows").alias("rows"), F.max("known").alias("known"))
    fails = F.when(F.col("label") == UNIQUE, F.col("rows") - 1).when(F.col("known"), 0).otherwise(F.col("rows"))
    counted = keys.groupBy(*of).agg(F.sum(fails).alias("fails"), F.sum("rows").alias("total"))
    return finish_checks(counted.select("check_group", "label", "fails", "total", "consequence"))


UNIQUE = "product_id unique"


def refund_recovery() -> Column:
    return money(F.get_json_object("_rescued_data", "$.refund_amount"))


def orphaned_returns(raw_returns: DataFrame, raw_orders: DataFrame) -> DataFrame:
    """Returns whose order is unknown."""
    back = raw_returns.select(unify(raw_returns, "order_id", "OrderId").alias("order_id"), FILE)
    return orphans(back, "order_id", raw_orders.select(F.col("order_id").alias("known_order")), "known_order", null_is_orphan=True)
