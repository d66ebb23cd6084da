"""Joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab
from ..operators.dedup import keep_first, repeated
from ..operators.lookup import count_orphans, look_up, orphans
from ..operators.numbering import number_rows
from ..operators.ranking import few_values, flagged_or_top, top_per_group
from ..operators.report import counts_by, metrics, stack, with_share
from ..plans import fraud, kpi, profiling, quality
from ..plans.standardise import CUSTOMER_ID
from . import oracle as O
from .catalog import add


def rows_n():
    return F.count(F.lit(1))

# -- joins ----------------------------------------------------------------------

add(
    "jon_01_left_join_same_name",
    lambda b: b.clean("transactions").select("order_id", "product_id", "sales")
    .join(b.clean("orders").select("order_id", "customer_id", "order_purchase_date"), "order_id", "left"),
    "select t.order_id, t.product_id, t.sales, o.customer_id, o.order_purchase_date from clean_transactions t left join clean_orders o on t.order_id = o.order_id",
)
add(
    "jon_02_left_join_other_name",
    lambda b: b.clean("customers").select("customer_id", F.col("region").alias("customer_region"))
    .join(b.star().dim_region, F.col("customer_region") == F.col("source_region"), "left").select("customer_id", "customer_region", "region_key"),
    "select c.customer_id, c.region as customer_region, g.region_key from clean_customers c left join dim_region g on c.region = g.source_region",
)
add(
    "jon_03_inner_join",
    lambda b: b.star().fact_returns().select("order_id", "customer_key", "return_amount")
    .join(b.star().dim_customer.select("customer_key", "customer_name", "region"), "customer_key"),
    "select f.order_id, f.customer_key, f.return_amount, c.customer_name, c.region from fact_returns f join dim_customer c using (customer_key)",
)
add(
    "jon_04_orphan_counts",
    lambda b: stack([
        count_orphans(b.clean(f), k, b.clean(p), k).select(F.lit(f).alias("facts"), "orphaned_count")
        for f, k, p in [("orders", "customer_id", "customers"), ("returns", "order_id", "orders"), ("transactions", "order_id", "orders")]
    ]),
    "select 'orders' as facts, count(*) as orphaned_count from clean_orders where customer_id is not null and customer_id not in (select customer_id from clean_customers) "
    "union all select 'returns', count(*) from clean_returns where order_id is not null and order_id not in (select order_id from clean_orders) "
    "union all select 'transactions', count(*) from clean_transactions where order_id is not null and order_id not in (select order_id from clean_orders)",
)
add(
    "jon_05_orphan_rows",
    lambda b: orphans(
        b.raw("orders").select("order_id", "customer_id", "_source_file_name"), "customer_id",
        b.raw("customers").select(C.unify(b.raw("customers"), *CUSTOMER_ID).alias("cid")), "cid", null_is_orphan=True,
    ),
    f"select order_id, customer_id, _source_file_name from raw_orders o where not exists (select 1 from (select {O.CID} as cid from raw_customers) c where c.cid = o.customer_id)",
)
add(
    "jon_06_join_with_inequality",
    lambda b: b.clean("returns").select("order_id", "return_date", "refund_amount")
    .join(b.star().order_sales.select("order_id", "sales"), "order_id").filter("refund_amount > sales"),
    "select r.order_id, r.return_date, r.refund_amount, s.sales from clean_returns r join order_sales s on r.order_id = s.order_id and r.refund_amount > s.sales",
)
add(
    "jon_07_join_single_row_total",
    lambda b: with_share(counts_by(b.clean("transactions"), "payment_type"), "row_count"),
    f"select payment_type, count(*) as row_count, {O.pct('count(*)', '(select count(*) from clean_transactions)')} as pct from clean_transactions group by 1",
)
add(
    "jon_09_scalar_subqueries",
    lambda b: quality.counted_by_subqueries(b.all_clean, b.all_quarantine, ["orders", "vendors"]),
    f"select *, {O.pct('quarantine_count', 'clean_count + quarantine_count')} as quarantine_rate_pct from ({O.split_count('orders')} union all {O.split_count('vendors')})",
)
add(
    "jon_09_rates_of_all_entities",
    lambda b: quality.counted_by_subqueries(b.all_clean, b.all_quarantine),
    "select * from split_counts",
)
add(
    "jon_10_dimension_lookup_and_group",
    lambda b: b.star().fact_transactions.groupBy("vendor_key").agg(rows_n().alias("row_count"))
    .join(b.star().dim_vendor.select("vendor_key", "vendor_name"), "vendor_key", "left").select("vendor_name", "row_count"),
    "select v.vendor_name, n as row_count from (select vendor_key, count(*) as n from fact_transactions group by 1) f left join dim_vendor v on f.vendor_key = v.vendor_key",
)
add(
    "jon_11_unknown_member",
    lambda b: look_up(
        b.clean("orders").select("order_id", "customer_id"),
        b.star().dim_customer.filter(F.col("customer_key") != vocab.UNKNOWN_KEY), "customer_id", ["customer_key"], {"customer_key": vocab.UNKNOWN_KEY},
    ),
    "select o.order_id, o.customer_id, coalesce(c.customer_key, -1) as customer_key from clean_orders o left join (select * from dim_customer where customer_key <> -1) c on o.customer_id = c.customer_id",
)

# -- aggregates -------------------------------------------------------------------

add(
    "agg_01_counts",
    lambda b: counts_by(b.raw("transactions"), "_source_file_name", "source_region"),
    "select _source_file_name, source_region, count(*) as row_count from raw_transactions group by 1, 2",
)
add(
    "agg_02_non_null_counts",
    lambda b: profiling.variant_matrix(b.raw("returns"), ["order_id", "OrderId", "refund_amount", "amount"], ["source_region"]),
    'select source_region, count(*) as total_rows, count(order_id) as has_order_id, count("OrderId") as "has_OrderId", count(refund_amount) as has_refund_amount, count(amount) as has_amount from raw_returns group by 1',
)
add(
    "agg_03_conditional_counts",
    lambda b: b.clean("customers").groupBy("segment").agg(
        F.count_if(F.col("customer_email").contains("@")).alias("with_email"), F.sum(F.when(F.col("region") == "West", 1).otherwise(0)).alias("in_west")
    ),
    "select segment, count(*) filter (customer_email like '%@%') as with_email, cast(sum(case when region = 'West' then 1 else 0 end) as bigint) as in_west from clean_customers group by 1",
)
add(
    "agg_04_distinct_counts",
    lambda b: b.clean("transactions").groupBy("source_region").agg(F.count_distinct("order_id").alias("orders"), F.count_distinct("product_id").alias("products")),
    "select source_region, count(distinct order_id) as orders, count(distinct product_id) as products from clean_transactions group by 1",
)
add(
    "agg_05_decimal_sums",
    lambda b: b.clean("transactions").groupBy("payment_type").agg(C.decimal_sum("sales").alias("total_sales"), C.decimal_sum("discount").alias("total_discount")),
    "select payment_type, sum(cast(sales as decimal(26,10))) as total_sales, sum(cast(discount as decimal(26,10))) as total_discount from clean_transactions group by 1",
)
add(
    "agg_05_sum_avg_min_max",
    lambda b: b.clean("transactions").groupBy("payment_type").agg(
        C.exact_sum("sales").alias("total_sales"), C.exact_avg("sales").alias("avg_sales"), C.two_digits(F.min("profit")).alias("min_profit"),
        C.two_digits(F.max("profit")).alias("max_profit"), F.min("quantity").alias("min_quantity"), F.max("quantity").alias("max_quantity"),
    ),
    f"select payment_type, {O.xsum('sales')} as total_sales, {O.xavg('sales')} as avg_sales, floor(min(profit) * 100 + 0.5::double) / 100::double as min_profit, "
    "floor(max(profit) * 100 + 0.5::double) / 100::double as max_profit, min(quantity) as min_quantity, max(quantity) as max_quantity from clean_transactions group by 1",
)
add("agg_06_best_record", lambda b: b.clean("customers").select("customer_id", "customer_email", "source_region"), "select customer_id, customer_email, source_region from clean_customers")
add(
    "agg_07_value_sets_and_samples",
    lambda b: few_values(b.raw("returns").select("source_region", F.coalesce("date_of_return", "return_date").alias("text"), C.date_shape_name(F.coalesce("date_of_return", "return_date")).alias("date_format")), ["source_region", "date_format"], "text"),
    "select source_region, date_format, array_to_string(list_sort(list(text)), ',') as samples from (select *, row_number() over (partition by source_region, date_format order by text) as rn from ("
    "select distinct source_region, text, case when upper(trim(text)) = 'NULL' then 'STRING_NULL' when regexp_matches(text, '^\\d{2}/\\d{2}/\\d{4}') then 'MM/DD/YYYY' "
    "when regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2}') then 'YYYY-MM-DD' when regexp_matches(text, '^\\d{2}-\\d{2}-\\d{4}') then 'DD-MM-YYYY' else 'UNKNOWN' end as date_format "
    "from (select source_region, coalesce(date_of_return, return_date) as text from raw_returns) where text is not null)) where rn <= 3 group by 1, 2",
)
add(
    "agg_08_first_value",
    lambda b: keep_first(b.raw("products").select("product_id", "product_name").filter("product_id is not null"), ["product_id"]),
    "select product_id, min(product_name) filter (true) as product_name from (select * from raw_products where product_id is not null) p group by 1 "
    "having count(*) filter (product_name is null) = 0 union all select product_id, null from (select * from raw_products where product_id is not null) q group by 1 having count(*) filter (product_name is null) > 0",
)
add(
    "agg_09_histogram_of_group_sizes",
    lambda b: counts_by(b.clean("transactions").groupBy("order_id").agg(rows_n().alias("lines_per_order")), "lines_per_order", name="num_orders"),
    "select lines_per_order, count(*) as num_orders from (select order_id, count(*) as lines_per_order from clean_transactions group by 1) group by 1",
)
add(
    "agg_10_having",
    lambda b: repeated(b.clean("transactions"), F.col("order_id"), "order_id"),
    "select order_id, count(*) as row_count from clean_transactions group by 1 having count(*) > 1",
)
add(
    "agg_11_percent_of_total",
    lambda b: with_share(counts_by(b.raw("orders"), "source_region", "order_status"), "row_count", by=["source_region"]),
    f"select source_region, order_status, n as row_count, {O.pct('n', 'sum(n) over (partition by source_region)')} as pct from (select source_region, order_status, count(*) as n from raw_orders group by 1, 2)",
)


def _deviation_sql(c):
    n, total = (f"{f}(round(cast({c} as double) * 100)::decimal(20,0))" for f in ("count", "sum"))
    squares = f"sum(round(cast({c} as double) * 100)::hugeint * round(cast({c} as double) * 100)::hugeint)"
    return f"case when {n} > 1 then floor(sqrt(greatest({squares}::double - {total}::double * {total}::double / {n}, 0) / ({n} - 1)) * 100 + 0.5) / 10000.0::double end"


def _deviation(c):
    """Sample standard deviation to four digits, from exact sums of hundredths and their squares."""
    cents = F.round(F.col(c).cast("double") * 100).cast("decimal(20,0)")
    n, total, squares = F.count(cents), F.sum(cents).cast("double"), F.sum(cents * cents).cast("double")
    spread = F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1)
    return F.when(n > 1, F.floor(F.sqrt(spread) * 100 + 0.5) / 10000.0)


def _describe(b):
    facts = b.star().fact_returns()
    columns = ["return_amount", "transaction_amount", "days_to_return"]
    return stack(
        [
            facts.agg(
                F.count(c).alias("value_count"), C.exact_avg(c).alias("mean"), _deviation(c).alias("deviation"), F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value")
            ).select(F.lit(c).alias("column_name"), "*")
            for c in columns
        ]
    )


add(
    "agg_12_summary_statistics",
    _describe,
    " union all ".join(
        f"select '{c}' as column_name, count({c}) as value_count, {O.xavg(c)} as mean, {_deviation_sql(c)} as deviation, cast(min({c}) as double) as min_value, cast(max({c}) as double) as max_value from fact_returns"
        for c in ["return_amount", "transaction_amount", "days_to_return"]
    ),
)
add(
    "agg_13_distinct_keys",
    lambda b: b.raw("customers").select(C.unify(b.raw("customers"), *CUSTOMER_ID).alias("customer_id")).distinct(),
    f"select distinct {O.CID} as customer_id from raw_customers",
)
add("agg_14_dedup_orders", lambda b: b.clean("orders"), "select * from clean_orders")
add(
    "agg_15_any_flag",
    lambda b: b.star().fact_returns().groupBy("customer_key").agg(F.max(F.col("suspicious_ratio_flag").cast("int")).alias("any_suspicious"), F.bool_or("quick_return_flag").alias("any_quick")),
    "select customer_key, max(cast(suspicious_ratio_flag as integer)) as any_suspicious, bool_or(quick_return_flag) as any_quick from fact_returns group by 1",
)
add(
    "agg_16_null_safe_ratios",
    lambda b: b.clean("transactions").groupBy("payment_installments").agg(C.percent(F.count_if("profit_was_null"), rows_n()).alias("null_profit_pct"), C.percent(F.count_if(F.expr("profit < 0")), F.count_if(F.expr("profit <> 0"))).alias("loss_pct")),
    f"select payment_installments, {O.pct('count(*) filter (profit_was_null)', 'count(*)')} as null_profit_pct, {O.pct('count(*) filter (profit < 0)', 'count(*) filter (profit <> 0)')} as loss_pct from clean_transactions group by 1",
)

# -- windows, sorting -----------------------------------------------------------------

add("win_01_customer_numbers", lambda b: b.star().dim_customer.select("customer_key", "customer_id"), "select customer_key, customer_id from dim_customer")
add("win_02_vendor_ranks", lambda b: kpi.ranked_vendors(b.star()), "select * from ranked_vendors")
add("win_03_product_ranks", lambda b: kpi.ranked_return_products(b.star()), "select * from ranked_return_products")
add(
    "win_04_top_k_per_group",
    lambda b: top_per_group(b.clean("returns").select("return_reason", "order_id", "return_date", "refund_amount"), ["return_reason"],
        [F.desc("refund_amount"), F.asc("order_id"), F.asc("return_date")], 15),
    "select return_reason, order_id, return_date, refund_amount, cast(rank as integer) as rank from (select *, row_number() over (partition by return_reason order by refund_amount desc, order_id, return_date) as rank from clean_returns) where rank <= 15",
)
add(
    "srt_01_multi_key_sort",
    lambda b: counts_by(b.raw("orders"), "_source_file_name", "ship_mode").orderBy(F.asc("_source_file_name"), F.desc("row_count"), F.asc_nulls_first("ship_mode")),
    "select _source_file_name, ship_mode, count(*) as row_count from raw_orders group by 1, 2",
)
add(
    "srt_02_top_scores",
    lambda b: fraud.top_suspects(b.star()),
    "select * from scored_customers order by anomaly_score desc, customer_id limit 3",
)
add(
    "srt_03_sample_rows",
    lambda b: quality.quarantine_sample(b.quarantine("returns"), "returns", 20).select(F.col("c0").alias("order_id"), F.col("c1").alias("return_reason"), F.col("c2").alias("return_status"), "first_issue"),
    "select order_id, return_reason, return_status, case when order_id is null then 'missing_order_id' when return_date is null then 'missing_return_date' "
    "when not coalesce(refund_amount > 0, false) then 'missing_refund_amount' else 'missing_return_reason' end as first_issue from quar_returns "
    "order by order_id nulls first, return_reason nulls first, return_status nulls first, first_issue limit 20",
)
add(
    "srt_04_flagged_or_top",
    lambda b: flagged_or_top(
        fraud.scored_customers(b.star()).withColumn("extreme", F.col("anomaly_score") > 1000), "extreme", [F.desc("anomaly_score"), F.asc("customer_id")]
    ).select("customer_id", "anomaly_score", "extreme"),
    "select customer_id, anomaly_score, false as extreme from scored_customers order by anomaly_score desc, customer_id limit 3",
)

# -- set operations -----------------------------------------------------------------------

add(
    "set_01_union_of_metrics",
    lambda b: stack([metrics(b.raw(e), e, {"rows": rows_n(), "rescued": F.count("_rescued_data")}) for e in b.all_raw]),
    " union all ".join(
        f"select '{e}' as entity, 'rows' as metric, cast(count(*) as double) as value from raw_{e} union all select '{e}', 'rescued', cast(count(_rescued_data) as double) from raw_{e}"
        for e in O.ENTITIES
    ),
)
add("set_02_union_with_unknown_member", lambda b: b.star().dim_customer, "select * from dim_customer")
add("set_03_distinct_rows", lambda b: b.clean("customers").select("region", "segment").distinct(), "select distinct region, segment from clean_customers")


def _blocks() -> str:
    n = "cast(count(*) as double)"

    def rows(entity: str, table: str, values: dict[str, str]) -> str:
        return " union all ".join(f"select '{entity}' as entity, '{m}' as metric, {v} as value from {table}" for m, v in values.items())

    def cnt(condition: str) -> str:
        return f"cast(count(*) filter ({condition}) as double)"

    valued = "(select o.order_id, o.customer_id, s.sales from clean_orders o left join order_sales s on o.order_id = s.order_id)"
    return " union all ".join([
        rows("customers", "clean_customers", {"total_records": n, "valid_emails": cnt("customer_email like '%@%'"), "missing_name": cnt("customer_name is null"), "duplicate_ids": "cast(count(*) - count(distinct customer_id) as double)"}),
        rows("orders", valued, {"total_records": n, "total_order_value": O.xsum("sales"), "avg_order_value": O.xavg("sales"), "without_value": cnt("coalesce(sales, 0) <= 0"), "missing_customer": cnt("customer_id is null")}),
        rows("products", "clean_products", {"total_records": n, "without_category": cnt("category = 'Other'"), "without_size": cnt("sizes = 'One Size'"), "without_weight": cnt("weight is null"), "duplicate_ids": "cast(count(*) - count(distinct product_id) as double)"}),
        rows("returns", "clean_returns", {"total_records": n, "total_refund_amount": O.xsum("refund_amount"), "avg_refund_amount": O.xavg("refund_amount"), "not_positive": cnt("refund_amount <= 0"), "missing_order": cnt("order_id is null")}),
        rows("transactions", "clean_transactions", {"total_records": n, "total_sales": O.xsum("sales"), "avg_sales": O.xavg("sales"), "not_positive": cnt("sales <= 0"), "missing_order": cnt("order_id is null")}),
    ])


ENTITY_METRICS_SQL = _blocks()
add("set_04_metric_rows", lambda b: quality.entity_metrics(b.all_clean, b.star().order_sales.select("order_id", "sales")), ENTITY_METRICS_SQL)
add(
    "sch_08_range_numbers",
    lambda b: number_rows(b.raw("transactions").select(C.unify(b.raw("transactions"), "Product_id").alias("product_id")).filter("product_id is not null").distinct(), ["product_id"], "number", ranges=7),
    "select product_id, row_number() over (order by product_id) as number from (select distinct Product_id as product_id from raw_transactions where Product_id is not null)",
)
