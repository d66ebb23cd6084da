"""Projections, validation rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions import vocab
from ..plans import cleanse, kpi, profiling, quality, standardise
from ..plans.cleanse import RULES
from ..plans.fraud import numeric_returns
from ..plans.standardise import CUSTOMER_ID
from . import oracle as O
from .catalog import add

# -- standardising projections ----------------------------------------------

add(
    "prj_01_unify_customer_columns",
    lambda b: b.raw("customers").select(
        "source_region",
        C.unify(b.raw("customers"), *CUSTOMER_ID).alias("customer_id"),
        C.unify(b.raw("customers"), "customer_email", "email_address").alias("customer_email"),
        C.unify(b.raw("customers"), "customer_name", "full_name").alias("customer_name"),
        C.unify(b.raw("customers"), "segment", "customer_segment").alias("segment"),
    ),
    f"select source_region, {O.CID} as customer_id, {O.MAIL} as customer_email, coalesce(customer_name, full_name) as customer_name, "
    "coalesce(segment, customer_segment) as segment from raw_customers",
)
add(
    "prj_02_unify_return_columns",
    lambda b: b.std("returns").select("order_id", "refund_amount", "return_status", "_source_file_name"),
    "select order_id, refund_amount, return_status, _source_file_name from std_returns",
)
add(
    "prj_03_city_state_swap",
    lambda b: b.std("customers").select("customer_id", "source_region", "city", "state"),
    "select customer_id, source_region, city, state from std_customers",
)
add(
    "prj_04_segment_names",
    lambda b: b.std("customers").select("customer_id", "source_region", "segment"),
    "select customer_id, source_region, segment from std_customers",
)
add(
    "prj_05_region_names",
    lambda b: b.std("customers").select("customer_id", "source_region", "region"),
    "select customer_id, source_region, region from std_customers",
)
add(
    "prj_06_order_status_names",
    lambda b: b.std("orders").select("order_id", "source_region", "order_status"),
    "select order_id, source_region, order_status from std_orders",
)
add(
    "prj_07_ship_mode_names",
    lambda b: b.std("orders").select("order_id", "source_region", "ship_mode"),
    "select order_id, source_region, ship_mode from std_orders",
)
add(
    "prj_08_completeness_score",
    lambda b: b.std("customers").select("customer_id", "source_region", standardise.completeness().alias("score")),
    f"select customer_id, source_region, {O.SCORE} as score from std_customers",
)
add(
    "prj_09_size_lists",
    lambda b: b.std("products").select("product_id", "sizes"),
    "select product_id, sizes from std_products",
)
add(
    "prj_10_iso_dates",
    lambda b: b.std("products").select("product_id", "dateAdded", "dateUpdated"),
    'select product_id, "dateAdded", "dateUpdated" from std_products',
)
add(
    "prj_11_categories",
    lambda b: b.std("products").select("product_id", "categories", "category"),
    "select product_id, categories, category from std_products",
)
add(
    "prj_12_null_fill",
    lambda b: b.std("transactions")
    .select("order_id", F.lit("profit").alias("field"), F.col("profit").cast("string").isNotNull().alias("filled"), F.col("profit_was_null").alias("was_null"))
    .unionByName(
        b.std("products").select(F.col("product_id").alias("order_id"), F.lit("colors").alias("field"),
            F.col("colors").isNotNull().alias("filled"), (F.col("colors") == vocab.NO_COLOR).alias("was_null"))
    ),
    "select order_id, 'profit' as field, profit is not null as filled, profit_was_null as was_null from std_transactions "
    "union all select product_id, 'colors', colors is not null, colors = 'Not Specified' from std_products",
)
add(
    "prj_12_filled_values",
    lambda b: b.std("transactions").select("order_id", "product_id", F.lit("profit").alias("field"), F.col("profit").alias("number"), F.lit(None).cast("string").alias("text"))
    .unionByName(b.std("products").select(F.lit(None).cast("string").alias("order_id"), "product_id", F.lit("colors").alias("field"), F.lit(None).cast("double").alias("number"), F.col("colors").alias("text"))),
    "select order_id, product_id, 'profit' as field, profit as number, null as text from std_transactions union all select null, product_id, 'colors', null, colors from std_products",
)
add(
    "prj_13_order_dates",
    lambda b: b.std("orders").select("order_id", "source_region", *vocab.ORDER_DATE_COLUMNS),
    f"select order_id, source_region, {', '.join(vocab.ORDER_DATE_COLUMNS)} from std_orders",
)
add(
    "prj_14_return_dates",
    lambda b: b.raw("returns").select(
        C.unify(b.raw("returns"), "return_date", "date_of_return").alias("raw_date"),
        C.return_date(C.unify(b.raw("returns"), "return_date", "date_of_return")).alias("return_date"),
    ),
    "select coalesce(r.return_date, r.date_of_return) as raw_date, "
    + O.dates("case when upper(trim(coalesce(r.return_date, r.date_of_return))) <> 'NULL' then coalesce(r.return_date, r.date_of_return) end", "%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y")
    + " as return_date from raw_returns r",
)
add(
    "prj_15_garbage_text",
    lambda b: b.raw("returns").select(
        C.unify(b.raw("returns"), "return_reason", "reason").alias("raw_reason"),
        C.garbage_to_null(C.unify(b.raw("returns"), "return_reason", "reason")).alias("reason_wide"),
        C.garbage_to_null(C.unify(b.raw("returns"), "return_reason", "reason"), vocab.GARBAGE_NARROW).alias("reason_narrow"),
    ),
    "select raw_reason, case when upper(trim(raw_reason)) not in " + O.GARBAGE + " then trim(raw_reason) end as reason_wide, "
    "case when upper(trim(raw_reason)) not in ('?', 'NULL') then trim(raw_reason) end as reason_narrow "
    "from (select coalesce(return_reason, reason) as raw_reason from raw_returns)",
)
add(
    "prj_16_rescued_number",
    lambda b: b.raw("returns").select(
        "_rescued_data", C.rescued_text("refund_amount").alias("rescued_text"), C.money(C.rescued_text("refund_amount")).alias("rescued_amount")
    ),
    "select _rescued_data, json_extract_string(_rescued_data, '$.refund_amount') as rescued_text, "
    "try_cast(regexp_replace(json_extract_string(_rescued_data, '$.refund_amount'), '[$,]', '', 'g') as double) as rescued_amount from raw_returns",
)
add(
    "prj_17_rescued_keys",
    lambda b: b.std("transactions").select("order_id", "product_id", "_source_file_name"),
    "select order_id, product_id, _source_file_name from std_transactions",
)
add(
    "prj_18_discounts",
    lambda b: b.raw("transactions").select(
        F.col("discount").alias("raw_discount"), C.percent_or_fraction("discount").alias("discount_value"), "_source_file_name"
    ),
    "select r.discount as raw_discount, case when r.discount like '%\\%' escape '\\' then try_cast(replace(r.discount, '%', '') as double) / 100 "
    "else try_cast(r.discount as double) end as discount_value, r._source_file_name from raw_transactions r",
)
add(
    "prj_19_numeric_casts",
    lambda b: b.std("transactions").select("order_id", "sales", "quantity", "payment_installments"),
    "select order_id, sales, quantity, payment_installments from std_transactions",
)
add(
    "prj_20_placeholders",
    lambda b: b.raw("transactions").select(
        F.col("Sales").alias("raw_sales"),
        F.col("Quantity").alias("raw_quantity"),
        C.garbage_to_null("Sales").alias("sales_text"),
        C.garbage_to_null("Quantity").alias("quantity_text"),
        F.trim("payment_type").alias("payment_type"),
    ),
    f"select Sales as raw_sales, Quantity as raw_quantity, case when upper(trim(Sales)) not in {O.GARBAGE} then trim(Sales) end as sales_text, "
    f"case when upper(trim(Quantity)) not in {O.GARBAGE} then trim(Quantity) end as quantity_text, trim(t.payment_type) as payment_type from raw_transactions t",
)
add(
    "prj_21_weights",
    lambda b: b.raw("products").select("product_id", F.col("weight").alias("raw_weight"), C.kilograms("weight").alias("kilograms")),
    f"select product_id, weight as raw_weight, {O.KG} as kilograms from raw_products",
)
add(
    "prj_22_vendor_names",
    lambda b: b.std("vendors").select("vendor_id", "vendor_name"),
    "select vendor_id, vendor_name from std_vendors",
)
add(
    "prj_23_product_names",
    lambda b: b.clean("products").select("product_id", "product_name"),
    "select product_id, product_name from clean_products",
)
add(
    "prj_24_drop_lineage",
    lambda b: standardise.drop_lineage(b.std("orders")),
    f"select * exclude ({O.LINEAGE}) from std_orders",
)
add(
    "prj_25_best_record_expanded",
    lambda b: b.clean("customers"),
    "select * from clean_customers",
)
add(
    "prj_26_numeric_coercion",
    lambda b: numeric_returns(
        b.star().fact_returns().withColumn("return_amount", F.coalesce(F.col("return_amount").cast("decimal(18,2)").cast("string"), F.lit("null")))
        .withColumn("days_to_return", F.coalesce(F.col("days_to_return").cast("string"), F.lit("null"))),
        ["return_amount", "days_to_return"],
    ).select("order_id", "return_amount", "days_to_return"),
    "select order_id, return_amount, cast(days_to_return as double) as days_to_return from fact_returns",
)
add(
    "prj_27_issue_fields",
    lambda b: b.quarantine("customers")
    .select(F.lit("customers").alias("entity"), F.col("customer_id").alias("key"), quality.customer_field().alias("field"), "issue_type")
    .unionByName(
        b.quarantine("orders").select(F.lit("orders").alias("entity"), F.col("order_id").alias("key"), quality.order_field().alias("field"), "issue_type")
    ),
    f"select 'customers' as entity, customer_id as key, {O.CUSTOMER_FIELD} as field, issue_type from quar_customers "
    f"union all select 'orders', order_id, {O.ORDER_FIELD}, issue_type from quar_orders",
)

# -- validation ---------------------------------------------------------------

add(
    "val_01_quarantine_predicate",
    lambda b: b.std("orders").select("order_id", "source_region", (~RULES["orders"].passes()).alias("is_quarantined")),
    "select order_id, source_region, is_quarantined from tag_orders",
)
add(
    "val_02_tag_and_route",
    lambda b: cleanse.tagged(b.raw("transactions"), "transactions").groupBy("is_quarantined", "source_region").agg(F.count(F.lit(1)).alias("row_count")),
    "select is_quarantined, source_region, count(*) as row_count from tag_transactions group by 1, 2",
)
add(
    "val_03_issue_labels",
    lambda b: b.quarantine("transactions").select("order_id", "product_id", "issue_type"),
    "select order_id, product_id, issue_type from quar_transactions",
)


def _violations(entity: str) -> str:
    parts = [
        f"select '{entity}' as entity, '{rule}' as rule, count(*) as total_rows, count(*) filter (not coalesce({valid}, false)) as violations from std_{entity}"
        for rule, (valid, _) in O.RULES[entity].items()
    ]
    return " union all ".join(parts)


def _all_violations(b):
    from ..operators.report import stack

    return stack([RULES[e].violations(b.std(e)) for e in RULES])


add("val_04_expectation_counts", _all_violations, " union all ".join(_violations(e) for e in O.RULES))
add(
    "val_05_expect_or_drop",
    lambda b: RULES["customers"].clean(b.std("customers")).select("customer_id", "customer_email", "source_region"),
    "select customer_id, customer_email, source_region from tag_customers where not is_quarantined",
)
for _n, _e, _cols in [
    ("06", "customers", ["customer_id", "customer_email", "customer_name", "segment", "region", "source_region"]),
    ("07", "orders", ["order_id", "customer_id", "order_status", "ship_mode", "source_region"]),
    ("08", "products", ["product_id", "product_name", "categories"]),
    ("09", "returns", ["order_id", "return_date", "refund_amount", "return_reason"]),
    ("10", "transactions", ["order_id", "product_id", "sales", "quantity", "discount", "payment_type"]),
    ("11", "vendors", ["vendor_id", "vendor_name"]),
]:
    add(
        f"val_{_n}_{_e}_split",
        lambda b, e=_e, cols=_cols: cleanse.tagged(b.raw(e), e).select(*cols, "is_quarantined", "issue_type"),
        f"select {', '.join(_cols)}, is_quarantined, issue_type from tag_{_e}",
    )
add(
    "val_12_customers_kept_or_quarantined",
    lambda b: b.quarantine("customers").groupBy("issue_type").agg(F.count(F.lit(1)).alias("row_count")),
    "select issue_type, count(*) as row_count from quar_customers group by 1",
)
add(
    "val_13_predicates",
    lambda b: b.std("orders").agg(
        F.count_if(F.expr("order_id is null")).alias("is_null"),
        F.count_if(F.expr("order_id is not null")).alias("is_not_null"),
        F.count_if(F.col("order_status").isin("Shipped", "Delivered")).alias("in_list"),
        F.count_if(F.col("ship_mode") == "Same Day").alias("equal"),
        F.count_if(F.col("ship_mode") != "Same Day").alias("not_equal"),
        F.count_if(F.col("order_approved_at") < F.col("order_purchase_date")).alias("less"),
        F.count_if(F.col("order_approved_at") >= F.col("order_purchase_date")).alias("at_least"),
        F.count_if((F.col("order_status") == "Shipped") & ~(F.col("ship_mode") == "Same Day") | F.col("customer_id").isNull()).alias("and_or_not"),
        F.count_if(F.col("ship_mode").like("%Class")).alias("like_suffix"),
        F.count_if(F.col("vendor_id").rlike("^VEN[0-9]$")).alias("regex"),
        F.count_if(F.col("order_status").contains("ed")).alias("contains_text"),
    ),
    "select count(*) filter (order_id is null) as is_null, count(*) filter (order_id is not null) as is_not_null, "
    "count(*) filter (order_status in ('Shipped', 'Delivered')) as in_list, count(*) filter (ship_mode = 'Same Day') as equal, "
    "count(*) filter (ship_mode <> 'Same Day') as not_equal, count(*) filter (order_approved_at < order_purchase_date) as less, "
    "count(*) filter (order_approved_at >= order_purchase_date) as at_least, "
    "count(*) filter (order_status = 'Shipped' and not ship_mode = 'Same Day' or customer_id is null) as and_or_not, "
    "count(*) filter (ship_mode like '%Class') as like_suffix, count(*) filter (regexp_matches(vendor_id, '^VEN[0-9]$')) as regex, "
    "count(*) filter (contains(order_status, 'ed')) as contains_text from std_orders",
)


def _first_issue(entity: str) -> str:
    whens = " ".join(f"when not coalesce({valid}, false) then '{label}'" for valid, label in O.RULES[entity].values())
    return f"case {whens} else 'other_failure' end"


add(
    "val_14_first_failing_rule",
    lambda b: b.quarantine("orders").groupBy(RULES["orders"].first_issue("other_failure").alias("first_issue")).agg(F.count(F.lit(1)).alias("row_count")),
    f"select {_first_issue('orders')} as first_issue, count(*) as row_count from quar_orders group by 1",
)
add(
    "val_15_date_sequence",
    lambda b: profiling.date_sequence(b.raw("orders"), today=F.lit("2000-01-01").cast("timestamp")),
    f"""with s as (select {O.stamp('order_purchase_date')} as bought, {O.stamp('order_approved_at')} as approved, {O.stamp('order_delivered_customer_date')} as delivered from raw_orders),
    t as (select count(*) filter (approved < bought) as a, count(*) filter (delivered < approved) as d, count(*) filter (bought > timestamp '2000-01-01') as f from s where bought is not null and approved is not null)
    select 'approved_before_purchase' as check_name, a as fails from t union all select 'delivered_before_approved', d from t union all select 'purchase_in_future', f from t""",
)

# -- scalar functions ---------------------------------------------------------

add(
    "fn_s1_trim_and_case",
    lambda b: b.raw("vendors").select(
        "vendor_id", F.trim("vendor_name").alias("trimmed"), F.lower("vendor_name").alias("lowered"), F.upper("vendor_name").alias("uppered"),
        F.initcap(F.trim("vendor_name")).alias("titled"),
    ),
    f"select vendor_id, trim(vendor_name) as trimmed, lower(vendor_name) as lowered, upper(vendor_name) as uppered, {O.initcap('trim(vendor_name)')} as titled from raw_vendors",
)
add(
    "fn_s2_regex",
    lambda b: b.raw("products").select(
        "product_id",
        F.regexp_replace("sizes", r"(\d)\s+([A-Za-z])", "$1$2").alias("joined"),
        F.regexp_replace("sizes", r"(?i)\bmedium\b", "M").alias("word"),
        F.regexp_extract("weight", "([0-9.]+)", 1).alias("amount"),
        F.col("upc").rlike(r"^\d{10,13}$").alias("numeric_upc"),
    ),
    r"select product_id, regexp_replace(sizes, '(\d)\s+([A-Za-z])', '\1\2', 'g') as joined, regexp_replace(sizes, '(?i)\bmedium\b', 'M', 'g') as word, "
    r"regexp_extract(weight, '([0-9.]+)', 1) as amount, regexp_matches(upc, '^\d{10,13}$') as numeric_upc from raw_products",
)
add(
    "fn_s3_like_contains_substring",
    lambda b: b.raw("products").select(
        "product_id", F.lower("categories").like("%women%").alias("is_like"), F.col("categories").contains("Shoes").alias("has_shoes"), F.substring("product_id", 1, 3).alias("prefix")
    ),
    "select product_id, lower(categories) like '%women%' as is_like, contains(categories, 'Shoes') as has_shoes, substring(product_id, 1, 3) as prefix from raw_products",
)
add(
    "fn_s4_split_and_concat",
    lambda b: b.raw("products").select(
        "product_id", F.size(F.split("sizes", ",")).alias("parts"), F.concat_ws("|", "product_id", "colors", "weight").alias("joined"), F.concat(F.lit("<"), "product_id", F.lit(">")).alias("wrapped")
    ),
    "select product_id, cast(len(string_split(sizes, ',')) as integer) as parts, concat_ws('|', product_id, colors, weight) as joined, '<' || product_id || '>' as wrapped from raw_products",
)
add(
    "fn_s5_templates",
    lambda b: kpi.revenue_by_region(b.star()).select(
        X.fill("{region}: {revenue} from {orders} orders", region=F.col("source_region"), revenue=X.dollars("total_revenue"), orders=F.col("total_orders")).alias("line")
    ),
    f"select coalesce(source_region, 'null') || ': ' || {O.dollars('total_revenue')} || ' from ' || cast(total_orders as varchar) || ' orders' as line from revenue_by_region",
)
add(
    "fn_s6_valid_text",
    lambda b: b.source("documents").select("doc_id", X.valid_text("text").alias("clean_text")),
    "select doc_id, nullif(text, '') as clean_text from documents",
)
add(
    "fn_d1_date_parsing",
    lambda b: b.raw("orders").select(
        "order_id", "source_region", F.try_to_date("order_purchase_date", "yyyy-MM-dd HH:mm").alias("one_format"),
        C.parse_date("order_purchase_date", vocab.ORDER_DATE_FORMATS).alias("any_format"),
        F.to_date(C.parse_timestamp("order_purchase_date", vocab.SEQUENCE_FORMATS)).alias("stamp_day"),
    ),
    f"select order_id, source_region, {O.dates('order_purchase_date', '%Y-%m-%d %H:%M')} as one_format, {O.order_date('order_purchase_date')} as any_format, "
    f"cast({O.stamp('order_purchase_date')} as date) as stamp_day from raw_orders",
)
add(
    "fn_d2_date_parts",
    lambda b: b.star().dim_date,
    "select * from dim_date",
)
add(
    "fn_d3_date_difference",
    lambda b: b.clean("orders").select("order_id", F.datediff("order_delivered_customer_date", "order_purchase_date").alias("days")),
    "select order_id, cast(date_diff('day', order_purchase_date, order_delivered_customer_date) as integer) as days from clean_orders",
)
add(
    "fn_d4_current_timestamp",
    lambda b: b.clean("vendors").select("vendor_id", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("generated_later")),
    "select vendor_id, current_timestamp > timestamp '2020-01-01' as generated_later from clean_vendors",
)
add(
    "fn_d5_date_shapes",
    lambda b: b.raw("orders").groupBy("source_region", C.date_shape_name("order_purchase_date").alias("date_format")).agg(F.count(F.lit(1)).alias("row_count")),
    f"select source_region, {O.DATE_KIND.format(c='order_purchase_date')} as date_format, count(*) as row_count from raw_orders group by 1, 2",
)
add(
    "fn_m1_arithmetic",
    lambda b: b.clean("transactions").select(
        "order_id", "product_id", F.try_divide(F.col("profit"), F.nullif("sales", F.lit(0.0))).alias("margin"),
        (F.col("sales") * F.col("discount") - F.col("profit")).alias("mixed"), (F.col("quantity") + F.col("payment_installments")).alias("added"),
        C.two_digits("sales").alias("rounded"),
    ),
    "select order_id, product_id, profit / nullif(sales, 0) as margin, sales * discount - profit as mixed, quantity + payment_installments as added, "
    "floor(sales * 100 + 0.5::double) / 100::double as rounded from clean_transactions",
)
add(
    "fn_m2_tolerant_cast",
    lambda b: b.raw("transactions").select(F.col("Sales").alias("raw_sales"), C.number("Sales").alias("sales"), C.number("Quantity", "int").alias("quantity"), C.number("payment_installments", "bigint").alias("installments")),
    "select r.Sales as raw_sales, try_cast(r.Sales as double) as sales, try_cast(r.Quantity as integer) as quantity, try_cast(r.payment_installments as bigint) as installments from raw_transactions r",
)
add(
    "fn_m3_nan",
    lambda b: b.raw("returns").select(C.unify(b.raw("returns"), "order_id", "OrderId").alias("order_id"), F.isnan("refund_amount").alias("is_nan"), C.nan_to_null("refund_amount").alias("refund")),
    "select coalesce(order_id, OrderId) as order_id, coalesce(isnan(refund_amount), false) as is_nan, case when not isnan(refund_amount) then refund_amount end as refund from raw_returns",
)
add(
    "fn_c1_conditionals",
    lambda b: b.raw("customers").select(
        "source_region", F.coalesce("customer_id", "CustomerID", F.lit("none")).alias("first_id"), F.col("region").isin("N", "North").alias("is_north"),
        F.when(F.col("segment").isNull(), "other column").otherwise("own column").alias("segment_place"), F.expr("city is not null").alias("has_city"),
    ),
    "select source_region, coalesce(customer_id, \"CustomerID\", 'none') as first_id, region in ('N', 'North') as is_north, "
    "case when segment is null then 'other column' else 'own column' end as segment_place, city is not null as has_city from raw_customers",
)


def _arrays(b):
    tokens = F.transform(F.split("sizes", ","), lambda t: F.trim(t))
    short = F.filter(tokens, lambda t: F.length(t) <= 3)
    return b.raw("products").select(
        "product_id", F.array_join(F.array_sort(F.array_distinct(short)), ",").alias("short_sizes"), F.size(tokens).alias("tokens"), F.array_join(F.slice(tokens, 1, 2), ",").alias("first_two")
    )


add(
    "fn_a1_arrays",
    _arrays,
    "select product_id, array_to_string(list_sort(list_distinct(list_filter(tokens, lambda t: length(t) <= 3))), ',') as short_sizes, "
    "cast(len(tokens) as integer) as tokens, array_to_string(tokens[1:2], ',') as first_two from "
    "(select product_id, list_transform(string_split(sizes, ','), lambda t: trim(t)) as tokens from raw_products)",
)
add(
    "fn_p1_map_access",
    lambda b: b.raw("transactions").select("_rescued_data", F.try_element_at(F.from_json("_rescued_data", "map<string,string>"), F.lit("Order_ID")).alias("order_key")),
    "select _rescued_data, json_extract_string(_rescued_data, '$.Order_ID') as order_key from raw_transactions",
)
add(
    "fn_j1_json",
    lambda b: b.source("events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"), F.from_json("props", "k int")["k"].alias("k_number"), F.size(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key_count")
    ),
    "select event_id, json_extract_string(props, '$.k') as k_text, cast(json_extract_string(props, '$.k') as integer) as k_number, cast(len(json_keys(props)) as integer) as key_count from events",
)


def _answers(b):
    items = F.array(
        F.struct(F.lit("reasoning").alias("type"), F.col("role").alias("text")),
        F.struct(F.when(F.col("turn") % 3 != 2, "text").otherwise("image").alias("type"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text")),
    )
    return b.source("conversations").select("conv_id", "turn", X.first_text_item(F.to_json(items)).alias("answer"))


add("fn_j2_first_text_item", _answers, "select conv_id, turn, case when turn % 3 <> 2 then trim(text) end as answer from conversations")
add(
    "fn_x1_stable_row_numbers",
    lambda b: b.star().dim_product.select("product_id", "product_key"),
    "select product_id, product_key from dim_product",
)
add(
    "fn_x2_file_metadata",
    lambda b: b.source("orders").groupBy(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("stem")).agg(F.count(F.lit(1)).alias("row_count"), F.count("_metadata.file_modification_time").alias("with_time")),
    "select 'orders' as stem, count(*) as row_count, count(*) as with_time from orders",
)
