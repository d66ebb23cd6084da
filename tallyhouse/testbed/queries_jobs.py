"""Star schema, KPIs, fraud, quality, profiling, verification, audit and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab
from ..plans import audit, enrich, fraud, kpi, profiling, quality, retrieval, verify
from ..plans.standardise import CUSTOMER_ID
from . import oracle as O
from .catalog import add
from .queries_columns import _first_issue
from .queries_relational import ENTITY_METRICS_SQL

FILE = "_source_file_name"

# -- star schema and KPIs ---------------------------------------------------------

add("sch_01_dim_date", lambda b: b.lazy_star().dim_date, "select * from dim_date")
add("sch_02_dim_region", lambda b: b.lazy_star().dim_region, "select * from dim_region")
add("sch_03_dim_product", lambda b: b.lazy_star().dim_product, "select * from dim_product")
add("sch_04_dim_vendor", lambda b: b.lazy_star().dim_vendor, "select * from dim_vendor")
add("sch_05_dim_customer", lambda b: b.lazy_star().dim_customer, "select * from dim_customer")
add("sch_06_fact_transactions", lambda b: b.lazy_star().fact_transactions, "select * from fact_transactions")
add("sch_07_fact_returns", lambda b: b.lazy_star().fact_returns(), "select * from fact_returns")
add("sch_07_fact_returns_per_line", lambda b: b.lazy_star().fact_returns("per_line"), "select * from fact_returns_line")
add("kpi_01_revenue_by_region", lambda b: kpi.revenue_by_region(b.star()), "select * from revenue_by_region")
add(
    "kpi_01_revenue_by_order_region",
    lambda b: kpi.revenue_by_region(b.star("order")),
    f"select o.source_region, {O.xsum('t.sales')} as total_revenue, count(distinct t.order_id) as total_orders, {O.xavg('t.sales')} as avg_order_value "
    "from clean_transactions t left join clean_orders o on t.order_id = o.order_id group by 1",
)
add("kpi_02_vendor_returns", lambda b: kpi.vendor_returns(b.star()), "select * from vendor_returns")
add("kpi_02_vendor_returns_per_line", lambda b: kpi.vendor_returns(b.star(), "per_line"), "select * from vendor_returns_line")
add("kpi_03_inventory_velocity", lambda b: kpi.inventory_velocity(b.star()), "select * from inventory_velocity")
_REVENUE_ROLLUP = f"select {O.xsum('total_revenue')} as total_revenue, {O.xavg('total_revenue')} as avg_revenue from revenue_by_region"
_VENDOR_ROLLUP = f"select {O.xavg('avg_return_ratio', 6)} as avg_return_rate, {O.xsum('avg_return_ratio', 6)} as total_return_rate from vendor_returns"
_INVENTORY_ROLLUP = (
    f"select {O.xsum('total_sales')} as total_slow_inventory, {O.xavg('total_sales')} as avg_inventory, cast(sum(order_count) as bigint) as total_orders, "
    f"{O.xavg('order_count')} as avg_orders from inventory_velocity"
)
add("kpi_04_revenue_rollup", lambda b: kpi.revenue_rollup(kpi.revenue_by_region(b.star())), _REVENUE_ROLLUP)
add("kpi_05_vendor_rollup", lambda b: kpi.vendor_rollup(kpi.vendor_returns(b.star())), _VENDOR_ROLLUP)
add("kpi_06_inventory_rollup", lambda b: kpi.inventory_rollup(kpi.inventory_velocity(b.star())), _INVENTORY_ROLLUP)


def _insight_sql(kind: str, rollup: str, columns: list[str]) -> str:
    values = " || ',' || ".join(f"'\"{c}\":\"' || {O.fixed2(c)} || '\"'" for c in columns)
    return f"select '{kind}' as insight_type, '{{' || {values} || '}}' as kpi_data from ({rollup})"


add(
    "kpi_07_insight_rows",
    lambda b: enrich.business_insights(b.star()).drop("generated_at"),
    "select *, 'The figures for ' || replace(insight_type, '_', ' ') || ' are ' || kpi_data || '.' as summary from ("
    + " union all ".join([
        _insight_sql("revenue_performance", _REVENUE_ROLLUP, ["total_revenue", "avg_revenue"]),
        _insight_sql("vendor_return_rate", _VENDOR_ROLLUP, ["avg_return_rate", "total_return_rate"]),
        _insight_sql("slow_moving_inventory", _INVENTORY_ROLLUP, ["total_slow_inventory", "avg_inventory", "total_orders", "avg_orders"]),
    ]) + ")",
)
add("kpi_08_slow_products_by_region", lambda b: kpi.slow_products_by_region(b.star()), "select * from slow_products")
add(
    "kpi_08_movement_by_quantile",
    lambda b: kpi.movement_by_quantile(b.star()),
    "select product_name, category, region_name, case when order_count <= slow_up_to then 'slow-moving' when order_count > fast_above then 'fast-moving' else 'steady' end as movement_status, order_count, slow_up_to, fast_above "
    "from slow_products join (select region_name, quantile_disc(order_count, 0.25) as slow_up_to, quantile_disc(order_count, 0.75) as fast_above from slow_products group by 1) using (region_name)",
)
add("kpi_09_top_categories_by_region", lambda b: kpi.top_categories_by_region(b.star()), "select * from top_categories")
add("kpi_10_high_return_products", lambda b: kpi.high_return_products(b.star()), "select * from high_return_products")
add("kpi_11_vendor_returns_summary", lambda b: kpi.ranked_vendors(b.star()).drop("vendor_rank"), "select * exclude (vendor_rank) from ranked_vendors")
add(
    "kpi_12_revenue_trend",
    lambda b: kpi.revenue_trend(b.star()),
    f"select cast(f.date_key // 100 as integer) as month_key, g.source_region, {O.xsum('sales_amount')} as total_revenue, count(distinct order_id) as total_orders "
    "from fact_transactions f left join dim_region g on f.region_key = g.region_key where order_link_flag group by 1, 2",
)
add(
    "kpi_13_customer_lifetime_value",
    lambda b: kpi.customer_lifetime_value(b.star()),
    f"""select c.customer_id, c.region, c.customer_segment, order_count, s / 10000::double as gross_value, coalesce(r, 0) / 10000::double as refund_value,
      (s - coalesce(r, 0)) / 10000::double as net_value, first_order_key, last_order_key
    from (select customer_key, count(distinct order_id) as order_count, cast(sum({O.scaled('sales_amount')}) as bigint) as s, min(date_key) as first_order_key, max(date_key) as last_order_key from fact_transactions group by 1) t
      join dim_customer c using (customer_key) left join (select customer_key, cast(sum({O.scaled('return_amount')}) as bigint) as r from fact_returns group by 1) x using (customer_key)
    where customer_key <> -1""",
)
add(
    "kpi_14_return_reasons",
    lambda b: kpi.return_reasons(b.star()),
    f"select return_reason, count(*) as return_count, {O.xsum('refund_amount')} as refund_value, {O.pct('count(*)', '(select count(*) from clean_returns)')} as share_pct from clean_returns group by 1",
)
add(
    "kpi_14_return_rate",
    lambda b: kpi.return_rate(b.star()),
    f"select region as source_region, count(*) as total_orders, count(r.order_id) as returned_orders, {O.pct('count(r.order_id)', 'count(*)')} as return_rate_pct "
    "from keyed_orders o left join (select distinct order_id from clean_returns) r on o.order_id = r.order_id group by 1",
)

# -- fraud --------------------------------------------------------------------------

add("frd_01_customer_profile", lambda b: fraud.customer_profile(b.star()), "select * from customer_profile")
add("frd_02_scores", lambda b: fraud.scored_customers(b.star()), "select * from scored_customers")
add("frd_03_suspects", lambda b: fraud.suspects(b.star()), "select * from scored_customers where flagged")
_NOTE = (
    f"'Customer ' || customer_id || ' returned ' || cast(total_returns as varchar) || ' times for ' || {O.dollars('total_return_value')} "
    "|| ' in total and reached ' || cast(anomaly_score as varchar) || ' points through ' || rules_triggered || '.'"
)
add(
    "frd_04_investigations",
    lambda b: enrich.investigations(b.star()).drop("generated_at"),
    f"select customer_id, customer_name, region, segment, cast(total_returns as integer) as total_returns, total_return_value, anomaly_score, rules_triggered, {_NOTE} as investigation from scored_customers where flagged",
)
add(
    "frd_05_repeated_returns",
    lambda b: fraud.repeated_returns(b.raw("returns")),
    f"select coalesce(order_id, OrderId) as order_id, count(*) as return_count, string_agg(distinct {O.STEM}, ',' order by {O.STEM}) as systems from raw_returns group by 1 having count(*) > 1",
)
add(
    "frd_06_returns_without_order",
    lambda b: profiling.orphaned_returns(b.raw("returns"), b.raw("orders")),
    f"select coalesce(order_id, OrderId) as order_id, {FILE} from raw_returns r where not exists (select 1 from raw_orders o where o.order_id = coalesce(r.order_id, r.OrderId))",
)

# -- data quality ---------------------------------------------------------------------

add("dq_01_issue_report", lambda b: quality.issue_report(b.quarantine("customers"), b.quarantine("orders")), O.ISSUES)
add(
    "dq_02_explained_issues",
    lambda b: enrich.explained_issues(b.quarantine("customers"), b.quarantine("orders")).drop("generated_at"),
    "select *, cast(count as varchar) || ' ' || entity || ' rows were rejected because of ' || issue_type || '; the field concerned is ' || field || '.' as explanation from (" + O.ISSUES + ")",
)
add("dq_03_quarantine_rates", lambda b: quality.counted_by_subqueries(b.all_clean, b.all_quarantine), "select * from split_counts")
add("dq_03_quarantine_rates_from_raw", lambda b: quality.split_counts(b.all_raw), "select * from split_counts")
_SCORES = {
    "customers": ("customer_id", "customer_email like '%@%'", "customer_name is not null"),
    "orders": ("order_id", "order_estimated_delivery_date is not null", "customer_id is not null"),
    "products": ("product_id", "category <> 'Other'", "sizes <> 'One Size'"),
    "returns": ("order_id", "refund_amount >= 0", "return_date is not null"),
    "transactions": ("order_id", "sales > 0", "product_id is not null"),
}
add(
    "dq_04_quality_scores",
    lambda b: quality.quality_scores(b.all_clean),
    " union all ".join(
        f"select '{e}' as entity, count(*) as total_records, count({k}) as valid_ids, {O.pct(f'count({k})', 'count(*)')} as id_completeness_pct, "
        f"{O.pct(f'count(*) filter ({m2})', 'count(*)')} as quality_metric_2_pct, {O.pct(f'count(*) filter ({m3})', 'count(*)')} as quality_metric_3_pct from clean_{e}"
        for e, (k, m2, m3) in _SCORES.items()
    ),
)
add("dq_05_entity_metrics", lambda b: quality.entity_metrics(b.all_clean, b.star().order_sales.select("order_id", "sales")), ENTITY_METRICS_SQL)


def _samples(b):
    from ..operators.report import stack

    return stack([quality.quarantine_sample(b.quarantine(e), e) for e in quality.SAMPLE_COLUMNS])


add(
    "dq_06_quarantine_samples",
    _samples,
    " union all ".join(
        f"(select '{e}' as entity, cast({c[0]} as varchar) as c0, cast({c[1]} as varchar) as c1, cast({c[2]} as varchar) as c2, {_first_issue(e)} as first_issue from quar_{e} "
        "order by c0 nulls first, c1 nulls first, c2 nulls first, first_issue limit 10)"
        for e, c in quality.SAMPLE_COLUMNS.items()
    ),
)
add(
    "dq_07_referential_integrity",
    lambda b: quality.integrity(b.all_clean, b.star().order_sales.select("order_id", "sales")),
    "select 'orders_without_customer' as integrity_check, count(*) as orphaned_count from clean_orders o left join clean_customers c on o.customer_id = c.customer_id where c.customer_id is null and o.customer_id is not null "
    "union all select 'returns_without_order', count(*) from clean_returns r left join clean_orders o on r.order_id = o.order_id where o.order_id is null and r.order_id is not null "
    "union all select 'transactions_without_order', count(*) from clean_transactions t left join clean_orders o on t.order_id = o.order_id where o.order_id is null and t.order_id is not null "
    "union all select 'orders_with_multiple_transactions', count(*) from (select order_id from clean_transactions group by 1 having count(*) > 1) "
    "union all select 'returns_above_order_value', count(*) from clean_returns r join order_sales s on r.order_id = s.order_id where r.refund_amount > s.sales",
)
add(
    "dq_08_business_metrics",
    lambda b: quality.business_metrics(b.all_clean),
    f"""with m as (select (select count(*) from clean_customers) as c, (select count(*) from clean_orders) as o, (select count(*) from clean_products) as p,
      (select count(*) from clean_transactions) as t, (select cast(sum({O.scaled('sales')}) as bigint) from clean_transactions) as s,
      (select count(*) from clean_returns) as r, (select cast(sum({O.scaled('refund_amount')}) as bigint) from clean_returns) as f)
    select 'Total Customers' as metric, cast(c as varchar) as value from m union all select 'Total Orders', cast(o as varchar) from m union all select 'Total Products', cast(p as varchar) from m
    union all select 'Total Transactions', cast(t as varchar) from m union all select 'Total Sales', {O.dollars('s / 10000::double')} from m union all select 'Total Refunds', {O.dollars('f / 10000::double')} from m
    union all select 'Total Returns', cast(r as varchar) from m union all select 'Net Revenue', {O.dollars('(s - f) / 10000::double')} from m
    union all select 'Return Rate', {O.fixed2('r * 100.0::double / nullif(o, 0)')} || '%' from m union all select 'Avg Order Value', {O.dollars('s / 10000::double / nullif(o, 0)')} from m""",
)
_SPANS = [
    ("orders", "clean_orders", "order_purchase_date"),
    ("products", "clean_products", '"dateUpdated"'),
    ("returns", "clean_returns", "return_date"),
    ("transactions", "(select o.* from clean_orders o where order_id in (select order_id from clean_transactions))", "order_purchase_date"),
]
add(
    "dq_09_temporal_coverage",
    lambda b: quality.temporal_coverage(b.all_clean),
    " union all ".join(
        f"select '{n}' as table_name, max({c}) as latest, min({c}) as earliest, cast(date_diff('day', min({c}), max({c})) as integer) as date_range_days from {t}" for n, t, c in _SPANS
    ),
)
add(
    "dq_10_alerts",
    lambda b: quality.alerts(quality.split_counts(b.all_raw)),
    f"select *, case when quarantine_rate_pct > 5 then 'ALERT' else 'OK' end as status, case when quarantine_rate_pct > 5 then entity || ': ' || {O.fixed2('quarantine_rate_pct')} || '% of rows quarantined, review ' || entity || '_quarantine' end as alert from split_counts",
)
add(
    "dq_11_quality_trend",
    lambda b: quality.quality_trend(b.all_raw),
    f"select entity, load_day, count(*) as total_rows, count(*) filter (q) as quarantined_rows, {O.pct('count(*) filter (q)', 'count(*)')} as quarantine_rate_pct from ("
    + " union all ".join(f"select '{e}' as entity, cast(_ingested_at as date) as load_day, is_quarantined as q from tag_{e}" for e in O.REPORTED)
    + ") group by 1, 2",
)



def _days(b):
    """The trend by day of the order, which the derived tables have many of, as that of loads."""
    rows = quality.tagged(b.raw("orders"), "orders").select(
        F.lit("orders").alias("entity"), F.to_date("order_purchase_date").alias("load_day"), "is_quarantined"
    )
    counted = rows.filter("load_day is not null").groupBy("entity", "load_day").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_quarantined").alias("quarantined_rows")
    )
    return counted.withColumn("quarantine_rate_pct", C.percent(F.col("quarantined_rows"), F.col("total_rows")))


def _anomalies_sql(trend: str) -> str:
    return f"""select entity, load_day, total_rows, quarantined_rows, quarantine_rate_pct, earlier_loads,
      floor(m * 100 + 0.5) / 10000.0::double as earlier_mean,
      case when sd > 0 then floor((c - m) / sd * 100 + 0.5) / 100.0::double end as z_score,
      coalesce(earlier_loads >= 3 and case when sd > 0 then abs(c - m) > 3 * sd else c <> m end, false) as is_anomaly
    from (select *, case when earlier_loads > 1 then sqrt(greatest(sq - su * m, 0) / (earlier_loads - 1)) end as sd
      from (select *, su / nullif(earlier_loads, 0) as m
        from (select *, count(*) over w as earlier_loads, cast(sum(c) over w as double) as su, cast(sum(c * c) over w as double) as sq
          from (select *, cast(round(quarantine_rate_pct * 100) as bigint) as c
            from {trend})
          window w as (partition by entity order by load_day rows between unbounded preceding and 1 preceding))))"""


add(
    "dq_12_trend_anomalies",
    lambda b: quality.trend_anomalies(_days(b)),
    _anomalies_sql(
        f"""(select 'orders' as entity, cast(order_purchase_date as date) as load_day, count(*) as total_rows, count(*) filter (is_quarantined) as quarantined_rows,
              {O.pct('count(*) filter (is_quarantined)', 'count(*)')} as quarantine_rate_pct
              from tag_orders where order_purchase_date is not null group by 1, 2)"""
    ),
)
add(
    "dq_12_anomalies_of_all_loads",
    lambda b: quality.trend_anomalies(quality.quality_trend(b.all_raw)),
    _anomalies_sql("(" + " union all ".join(
        f"select '{e}' as entity, cast(_ingested_at as date) as load_day, count(*) as total_rows, count(*) filter (is_quarantined) as quarantined_rows, "
        f"{O.pct('count(*) filter (is_quarantined)', 'count(*)')} as quarantine_rate_pct from tag_{e} group by 1, 2"
        for e in O.REPORTED) + ")"),
)

# -- profiling ------------------------------------------------------------------------


def _profile_sql(table: str, types: dict[str, str]) -> str:
    parts = [
        f"select '{c}' as column_name, '{t}' as column_type, count(*) as total_rows, count(*) - count(\"{c}\") as nulls, count(distinct \"{c}\") + (count(*) > count(\"{c}\"))::int as distinct_values from {table}"
        for c, t in types.items()
    ]
    return (
        "select column_name, column_type, total_rows, nulls, null_pct, distinct_values, case when nulls = total_rows then 'all_null' when null_pct > 80 then 'mostly_null' "
        "when distinct_values = total_rows and nulls = 0 then 'candidate_key' when distinct_values = 1 then 'constant' when column_name = '_rescued_data' and nulls < total_rows then 'rescued' else '' end as flag "
        "from (select *, floor(nulls * 100.0::double / total_rows * 10 + 0.5) / 10.0::double as null_pct from (" + " union all ".join(parts) + "))"
    )


add(
    "prf_01_profile_lineitem",
    lambda b: profiling.profile(b.source("lineitem")),
    _profile_sql("lineitem", {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}),
)
_CUSTOMER_TYPES = {
    c: "string"
    for c in [*CUSTOMER_ID, "customer_email", "email_address", "customer_name", "full_name", "segment", "customer_segment", "country", "city", "state", "postal_code", "region", "source_region", FILE, "_source_file_path", "_rescued_data"]
} | {"_source_modified_time": "timestamp", "_ingested_at": "timestamp"}
add(
    "prf_01_profile_raw_customers",
    lambda b: profiling.profile(b.raw("customers").select(*_CUSTOMER_TYPES)),
    _profile_sql("raw_customers", _CUSTOMER_TYPES),
)
add(
    "prf_02_source_files",
    lambda b: profiling.by_source_file(b.raw("transactions")),
    f"select {FILE}, source_region, count(*) as row_count, cast(min(_ingested_at) as date) as first_ingested, cast(max(_ingested_at) as date) as last_ingested from raw_transactions group by 1, 2",
)
add("prf_03_rescued_by_file", lambda b: profiling.rescued_by_file(b.raw("transactions")), f"select {FILE}, count(*) as rescued_rows from raw_transactions where _rescued_data is not null group by 1")
add(
    "prf_03_rescued_sample",
    lambda b: profiling.rescued_sample(b.raw("customers")),
    f"select {FILE}, source_region, _rescued_data from raw_customers where _rescued_data is not null order by 1, 2, 3 limit 20",
)
add(
    "prf_04_rescued_keys",
    lambda b: profiling.rescued_keys(b.raw("transactions")),
    f"select {FILE}, rescued_key, count(*) as row_count from (select {FILE}, unnest(json_keys(_rescued_data)) as rescued_key from raw_transactions where _rescued_data is not null) group by 1, 2",
)
add(
    "prf_05_recovery_rate",
    lambda b: profiling.recovery_rate(b.raw("transactions"), {"order_id": F.get_json_object("_rescued_data", "$.Order_ID"), "product_id": F.get_json_object("_rescued_data", "$.Product_ID")}),
    "select count(*) as total_rescued, count(o) as order_id_recovered, count(*) - count(o) as order_id_lost, count(p) as product_id_recovered, count(*) - count(p) as product_id_lost from "
    "(select json_extract_string(_rescued_data, '$.Order_ID') as o, json_extract_string(_rescued_data, '$.Product_ID') as p from raw_transactions where _rescued_data is not null)",
)
add(
    "prf_05_refund_recovery",
    lambda b: profiling.recovery_rate(b.raw("returns"), {"refund": profiling.refund_recovery()}),
    "select count(*) as total_rescued, count(v) as refund_recovered, count(*) - count(v) as refund_lost from (select try_cast(regexp_replace(json_extract_string(_rescued_data, '$.refund_amount'), '[$,]', '', 'g') as double) as v from raw_returns where _rescued_data is not null)",
)


def _matrix(table: str, variants: list[str], by: str, extra: str = "") -> str:
    counts = ", ".join(f'count("{v}") as "has_{v}"' for v in variants)
    return f"select {by}, count(*) as total_rows, {counts}{extra} from {table} group by {by}"


_CV = [*CUSTOMER_ID, "customer_email", "email_address", "customer_name", "full_name", "segment", "customer_segment"]
_RV = ["order_id", "OrderId", "amount", "refund_amount", "date_of_return", "return_date", "reason", "return_reason", "status", "return_status"]
add(
    "prf_06_customer_variants",
    lambda b: profiling.variant_matrix(b.raw("customers"), _CV, [FILE], {"no_email": C.unify(b.raw("customers"), "customer_email", "email_address").isNull()}),
    _matrix("raw_customers", _CV, FILE, f", count(*) filter ({O.MAIL} is null) as no_email"),
)
add("prf_06_return_variants", lambda b: profiling.variant_matrix(b.raw("returns"), _RV, [FILE, "source_region"]), _matrix("raw_returns", _RV, f"{FILE}, source_region"))
add(
    "prf_06_transaction_variants",
    lambda b: profiling.variant_matrix(b.raw("transactions"), ["Order_id", "Product_id", "_rescued_data"], [FILE]),
    _matrix("raw_transactions", ["Order_id", "Product_id", "_rescued_data"], FILE),
)
add(
    "prf_07_segment_distribution",
    lambda b: profiling.value_distribution(b.raw("customers"), F.coalesce("segment", "customer_segment"), "raw_segment"),
    f"select raw_segment, count(*) as row_count, string_agg(distinct {O.STEM}, ',' order by {O.STEM}) as systems, {O.pct('count(*)', 'any_value(total)')} as pct from "
    f"(select coalesce(segment, customer_segment) as raw_segment, {FILE}, count(*) over () as total from raw_customers where coalesce(segment, customer_segment) is not null) group by 1",
)
add(
    "prf_08_swapped_cities",
    lambda b: profiling.swapped_cities(b.raw("customers")),
    f"select {FILE}, count(*) as swapped_rows, string_agg(distinct city, ',' order by city) as states from raw_customers where city in {O.STATES} group by 1",
)
_FORMATS = " union all ".join(f"select {FILE}, '{c}' as column_name, {c} as text from raw_orders" for c in vocab.ORDER_DATE_COLUMNS)
add(
    "prf_09_date_formats",
    lambda b: profiling.date_format_census(b.raw("orders"), vocab.ORDER_DATE_COLUMNS),
    f"""with t as (select *, {O.DATE_KIND.format(c='text')} as date_format from ({_FORMATS})),
    s as (select {FILE}, column_name, date_format, array_to_string(list_sort(list(text)), ',') as samples from (
      select *, row_number() over (partition by {FILE}, column_name, date_format order by text) as rn from (select distinct * from t where text is not null)) where rn <= 3 group by all)
    select g.*, s.samples from (select {FILE}, column_name, date_format, count(*) as row_count from t group by all) g left join s using ({FILE}, column_name, date_format)""",
)


def _cast_sql(c: str, kind: str) -> str:
    v = f'try_cast("{c}" as {kind})'
    return (
        f"select '{c}' as column_name, count(*) as total_rows, count(*) filter ({v} is null) as non_numeric, cast(min({v}) as double) as min_value, "
        f"cast(max({v}) as double) as max_value, count(*) filter ({v} <= 0) as zero_or_negative from raw_transactions"
    )


def _castability(b):
    from ..operators.report import stack

    return stack([profiling.castability(b.raw("transactions"), c, k) for c, k in [("Sales", "double"), ("Quantity", "int")]])


add("prf_10_castability", _castability, _cast_sql("Sales", "double") + " union all " + _cast_sql("Quantity", "integer"))
add(
    "prf_11_discount_formats",
    lambda b: profiling.discount_format_census(b.raw("transactions")),
    f"select {FILE}, case when r.discount is null then 'NULL' when r.discount like '%\\%' escape '\\' then 'PERCENT' when try_cast(r.discount as double) is not null then 'DECIMAL' else 'OTHER' end as discount_format, count(*) as row_count from raw_transactions r group by 1, 2",
)
add(
    "prf_11_discount_range",
    lambda b: profiling.discount_range(b.raw("transactions")),
    "select count(*) filter (d > 1) as above_one, count(*) filter (d < 0) as negative, min(d) as min_discount, max(d) as max_discount from (select try_cast(r.discount as double) as d from raw_transactions r where r.discount not like '%\\%' escape '\\')",
)
add(
    "prf_12_profit_distribution",
    lambda b: profiling.profit_distribution(b.raw("transactions")),
    f"select {FILE}, count(*) as total_rows, count(*) filter (profit is null) as null_profit, count(*) filter (profit < 0) as negative_profit, count(*) filter (profit = 0) as zero_profit, "
    f"count(*) filter (profit > 0) as positive_profit, min(profit) as min_profit, max(profit) as max_profit from raw_transactions group by 1",
)
add(
    "prf_12_loss_legitimacy",
    lambda b: profiling.loss_legitimacy(b.raw("transactions")),
    "select count(*) as negative_profit_rows, count(*) filter (d > 0) as with_discount, count(*) filter (d = 0) as without_discount from (select try_cast(replace(r.discount, '%', '') as double) as d from raw_transactions r where profit < 0)",
)
add(
    "prf_13_nan_census",
    lambda b: profiling.nan_census(b.raw("returns"), ["refund_amount", "amount"]),
    " union all ".join(
        f"select '{c}' as column_name, count(*) as total_rows, count(*) filter ({c} is null) as null_rows, count(*) filter (isnan({c})) as nan_rows, count(*) filter (not isnan({c})) as number_rows from raw_returns"
        for c in ["refund_amount", "amount"]
    ),
)
add(
    "prf_14_return_domains",
    lambda b: profiling.domain_listing(b.raw("returns"), ["reason", "return_reason", "status", "return_status"]),
    "select column_name, value, count(*) as row_count from (" + " union all ".join(f"select '{c}' as column_name, {c} as value from raw_returns" for c in ["reason", "return_reason", "status", "return_status"]) + ") where value is not null group by 1, 2",
)
add(
    "prf_14_order_domains",
    lambda b: profiling.domain_listing(b.raw("orders"), ["ship_mode", "order_status"], [FILE]),
    f"select {FILE}, column_name, value, count(*) as row_count from (" + " union all ".join(f"select {FILE}, '{c}' as column_name, {c} as value from raw_orders" for c in ["ship_mode", "order_status"]) + ") where value is not null group by 1, 2, 3",
)
add(
    "prf_15_upc_formats",
    lambda b: profiling.upc_formats(b.raw("products")),
    r"select case when upc is null then 'NULL' when regexp_matches(upc, '^\d+\.\d+E[+\-]\d+$') then 'SCIENTIFIC_NOTATION' when regexp_matches(upc, '^\d{10,13}$') then 'PROPER_NUMERIC' else 'OTHER' end as upc_format, count(*) as row_count from raw_products group by 1",
)
add(
    "prf_15_prefix_by_category",
    lambda b: profiling.prefix_by_category(b.raw("products"), C.category_of("categories")),
    "select substring(product_id, 1, 3) as prefix, category, count(*) as row_count from std_products group by 1, 2",
)


def _regions_sql(table: str, key: str, name: str, extra: str = "") -> str:
    return (
        f"select {key} as {name}, cast(count(distinct source_region) as integer) as region_count, count(*) as total_rows{extra}, string_agg(distinct source_region, ',' order by source_region) as regions "
        f"from {table} where {key} is not null group by 1 having count(distinct source_region) > 1"
    )


add("prf_16_orders_in_several_regions", lambda b: profiling.in_several_regions(b.raw("orders"), F.col("order_id"), "order_key"), _regions_sql("raw_orders", "order_id", "order_key"))
add("prf_16_transactions_in_several_regions", lambda b: profiling.in_several_regions(b.raw("transactions"), profiling.line_order_id(), "order_key"), _regions_sql("raw_transactions", O.LINE_OID, "order_key"))
add(
    "prf_16_emails_in_several_regions",
    lambda b: profiling.in_several_regions(b.raw("customers"), profiling.email_key(b.raw("customers")), "email", {"id_count": F.count_distinct(C.unify(b.raw("customers"), *CUSTOMER_ID))}),
    _regions_sql("raw_customers", f"lower(trim({O.MAIL}))", "email", f", count(distinct {O.CID}) as id_count"),
)
add("prf_17_duplicate_products", lambda b: profiling.duplicate_keys(b.raw("products"), "product_id"), "select product_id, count(*) as row_count from raw_products where product_id is not null group by 1 having count(*) > 1")


def _readiness_sql() -> str:
    def check(group: str, label: str, fails: str, table: str, then: str) -> str:
        return f"select '{group}' as check_group, '{label}' as label, ({fails}) as fails, (select count(*) from {table}) as total, '{then}' as consequence"

    def when(condition: str, table: str) -> str:
        return f"select count(*) from {table} where {condition}"

    bought, approved = O.stamp("order_purchase_date"), O.stamp("order_approved_at")
    d = "case when r.discount like '%\\%' escape '\\' then try_cast(replace(r.discount, '%', '') as double) / 100 else try_cast(r.discount as double) end"
    c, o, t, r, p, v = "raw_customers", "raw_orders", "raw_transactions", "raw_returns", "raw_products", "raw_vendors"
    rows = [
        check("customers", "canonical id resolvable", when(f"{O.CID} is null", c), c, "quarantine"),
        check("customers", "email present", when(f"{O.MAIL} is null", c), c, "warn"),
        check("customers", "city is not a state", when(f"city in {O.STATES}", c), c, "swap"),
        check("orders", "order_id not null", when("order_id is null", o), o, "quarantine"),
        check("orders", "customer_id not null", when("customer_id is null", o), o, "quarantine"),
        check("orders", "purchase date readable", when(f"{bought} is null", o), o, "quarantine"),
        check("orders", "approved not before purchase", when(f"{approved} < {bought}", o), o, "quarantine"),
        check("transactions", "order_id resolvable", when(f"{O.LINE_OID} is null", t), t, "quarantine"),
        check("transactions", "sales castable", when("try_cast(r.Sales as double) is null", t + " r"), t, "quarantine"),
        check("transactions", "discount in range", when(f"{d} > 1 or {d} < 0", t + " r"), t, "quarantine"),
        check("transactions", "negative profit", when("profit < 0", t), t, "warn"),
        check("returns", "order_id resolvable", when("coalesce(order_id, OrderId) is null", r), r, "quarantine"),
        check("returns", "return date not the text NULL", when("upper(trim(date_of_return)) = 'NULL'", r), r, "convert"),
        check("returns", "reason not garbage", when(f"upper(trim(reason)) in {O.GARBAGE}", r), r, "convert"),
        check("returns", "refund amount not NaN", when("isnan(refund_amount)", r), r, "convert"),
        check("products", "product_id not null", when("product_id is null", p), p, "quarantine"),
        check("products", "product_id unique", f"select count(*) - (select count(*) from (select distinct product_id from {p})) from {p}", p, "deduplicate"),
        check("vendors", "vendor_id not null", when("vendor_id is null", v), v, "quarantine"),
        check("references", "orders to customers", when(f"not exists (select 1 from (select {O.CID} as cid from {c}) x where x.cid = o.customer_id)", o + " o"), o, "quarantine"),
        check("references", "orders to vendors", when(f"not exists (select 1 from {v} x where trim(x.vendor_id) = o.vendor_id)", o + " o"), o, "warn"),
        check("references", "transactions to orders", when(f"oid is null or oid not in (select order_id from {o} where order_id is not null)", f"(select {O.LINE_OID} as oid from {t})"), t, "quarantine"),
        check("references", "returns to orders", when(f"oid is null or oid not in (select order_id from {o} where order_id is not null)", f"(select coalesce(order_id, OrderId) as oid from {r})"), r, "quarantine"),
    ]
    return f"select *, coalesce({O.pct('fails', 'total')}, 0) as fail_pct, case when fails = 0 then 'PASS' else 'FIX' end as status from (" + " union all ".join(rows) + ")"


add("prf_18_readiness", lambda b: profiling.readiness(b.all_raw), _readiness_sql())

# -- verification, audit --------------------------------------------------------------

add("ver_01_row_counts", lambda b: verify.row_counts(b.all_raw), " union all ".join(f"select '{e}' as entity, count(*) as row_count from raw_{e}" for e in O.ENTITIES))
add(
    "ver_02_region_coverage",
    lambda b: verify.region_coverage(b.all_raw),
    " union all ".join(f"select '{e}' as entity, source_region, count(*) as row_count from raw_{e} group by source_region" for e in O.ENTITIES),
)
add(
    "ver_03_audit_columns",
    lambda b: verify.audit_completeness(b.all_raw),
    " union all ".join(
        f"select '{e}' as entity, count(*) as total_rows, count(_source_file_path) as has_file_path, count(_source_file_name) as has_file_name, count(_source_modified_time) as has_modified_time, count(_ingested_at) as has_ingested_at from raw_{e}"
        for e in O.ENTITIES
    ),
)
add(
    "aud_01_order_copies",
    lambda b: audit.order_copies(b.raw("orders")),
    "select copies, count(*) as num_orders, string_agg(distinct regions, ' | ' order by regions) as region_combinations from (select order_id, count(*) as copies, string_agg(distinct source_region, ',' order by source_region) as regions from raw_orders group by 1) group by 1",
)
add(
    "aud_02_customer_copies",
    lambda b: audit.customer_copies(b.raw("customers")),
    f"select copies, count(*) as num_customers from (select {O.CID} as id, count(*) as copies from raw_customers group by 1) group by 1",
)
add(
    "aud_03_shared_customers",
    lambda b: audit.shared_customers(b.raw("customers")),
    f"select regions, count(*) as num_customers from (select {O.CID} as id, string_agg(distinct source_region, ',' order by source_region) as regions from raw_customers group by 1) group by 1",
)
add(
    "aud_04_email_agreement",
    lambda b: audit.email_agreement(b.raw("customers")),
    f"select copies, copies_with_email, count(*) as num_customers from (select {O.CID} as id, count(*) as copies, count({O.MAIL}) as copies_with_email from raw_customers group by 1) group by 1, 2",
)
add(
    "aud_05_overstatement",
    lambda b: audit.overstatement(b.raw("customers"), b.clean("orders"), b.clean("transactions")),
    f"""with s as (select o.customer_id, cast(sum({O.scaled('t.sales')}) as bigint) as v from clean_orders o join clean_transactions t on o.order_id = t.order_id group by 1),
    k as (select {O.CID} as cid, count(*) as n from raw_customers group by 1)
    select cast(sum(v * n) as bigint) / 10000::double as naive_revenue, cast(sum(v) as bigint) / 10000::double as matched_revenue,
      {O.pct('cast(sum(v * n) - sum(v) as bigint)', 'cast(sum(v) as bigint)')} as overstatement_pct from s join k on s.customer_id = k.cid""",
)
add(
    "aud_06_lineage_trace",
    lambda b: audit.lineage_trace(b.raw("customers"), b.raw("orders"), b.clean("orders"), b.clean("transactions")),
    f"""with s as (select order_id, cast(sum({O.scaled('sales')}) as bigint) as v from clean_transactions group by 1),
    f as (select order_id, min({FILE}) as order_file from raw_orders group by 1), k as (select {O.CID} as cid, min({FILE}) as customer_file from raw_customers group by 1)
    select order_file, customer_file, cast(sum(v) as bigint) / 10000::double as revenue, count(*) as order_count
    from clean_orders o join s on o.order_id = s.order_id join f on o.order_id = f.order_id left join k on o.customer_id = k.cid group by 1, 2""",
)

# -- retrieval --------------------------------------------------------------------------



def _documents_sql() -> str:
    def text(kind: str, **values: str) -> str:
        out = "'" + retrieval.TEMPLATES[kind] + "'"
        for name, sql in values.items():
            out = out.replace("{" + name + "}", f"' || coalesce(cast({sql} as varchar), 'null') || '")
        return out

    parts = [
        ("slow_product", "slow_products", text("slow_product", product="product_name", category="category", region="region_name", status="movement_status", orders="order_count", sales=O.dollars("total_sales"))),
        ("vendor", "ranked_vendors", text("vendor", vendor="vendor_name", returns="total_returns", value=O.dollars("total_return_value"), ratio=O.fixed2("avg_return_ratio"), rank="vendor_rank")),
        ("category", "top_categories", text("category", region="region_name", category="category", orders="total_orders", revenue=O.dollars("total_revenue"), average=O.dollars("avg_order_value"))),
        ("high_return_product", "ranked_return_products", text("high_return_product", product="product_name", category="category", returns="return_count", value=O.dollars("total_return_value"), ratio=O.fixed2("avg_return_ratio"), rank="product_rank")),
    ]
    return "select md5(text) as doc_id, kind, text from (" + " union all ".join(f"select '{k}' as kind, {t} as text from {c}" for k, c, t in parts) + ")"


add("rag_01_documents", lambda b: retrieval.documents(b.star()), _documents_sql())


def _question_rows() -> str:
    return ", ".join(f"({i}, '{q}')" for i, q in enumerate(retrieval.QUESTIONS, 1))


def retrieval_sql(last: str) -> str:
    """Sparse tf-idf vectors, cosine candidates and the BM25 rerank in SQL."""
    word_list = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
    slot = f"('0x' || md5(w)[1:8])::bigint % {retrieval.WIDTH}"
    subject = "not regexp_matches(w, '^[0-9]+$')"
    return f"""with docs as ({_documents_sql()}),
    texts as (select distinct doc_id, text from docs),
    asked as (select * from (values {_question_rows()}) as q(question_id, question)),
    doc_words as (select doc_id, unnest({word_list.format('text')}) as w from texts),
    asked_words as (select question_id, unnest({word_list.format('question')}) as w from asked),
    tf as (select doc_id, {slot} as slot, count(*) as tf from doc_words where {subject} group by all),
    idf as (select slot, count(*) as df, ln(((select count(*) from texts) + 1)::double / (count(*) + 1)) as idf from tf group by slot),
    weighted as (select doc_id, slot, tf * idf as w from tf join idf using (slot) where idf > 0),
    vectors as (select doc_id, slot, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from weighted),
    asked_weighted as (select question_id, slot, count(*) * any_value(idf) as w from (select question_id, {slot} as slot from asked_words where {subject}) join idf using (slot) where idf > 0 group by question_id, slot),
    asked_vectors as (select question_id, slot, w / sqrt(sum(w * w) over (partition by question_id)) as weight from asked_weighted),
    near as (select question_id, doc_id, round(2 - 2 * sum(floor(a.weight * v.weight * 1e12)::hugeint)::double / 1e12, 6) as distance from asked_vectors a join vectors v using (slot) group by all),
    candidates as (select question_id, doc_id from near qualify row_number() over (partition by question_id order by distance, doc_id) <= {retrieval.CANDIDATES}),
    lengths as (select doc_id, len({word_list.format('text')}) as size from texts),
    usual as (select avg(size) as usual from lengths),
    asked_terms as (select distinct question_id, w from asked_words),
    df as (select w, count(distinct doc_id) as df from doc_words where w in (select w from asked_terms) group by w),
    counts as (select doc_id, w, count(*) as tf from doc_words group by all),
    scored as (
        select question_id, doc_id, round(sum(coalesce(ln(1 + ((select count(*) from texts) - df.df + 0.5::double) / (df.df + 0.5::double)) * n.tf * 2.2::double
            / (n.tf + 1.2::double * (0.25::double + 0.75::double * size / usual)), 0)), 6) as score
        from candidates join asked_terms using (question_id) join df using (w) join lengths using (doc_id) cross join usual left join counts n using (doc_id, w) group by all),
    reranked as (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from scored qualify rank <= {retrieval.KEPT}),
    answers as (
        select question_id, question, 'Best match: ' || arg_min(text, rank) as answer, string_agg(text, chr(10) order by rank) as retrieved_docs
        from reranked join asked using (question_id) join texts using (doc_id) group by question_id, question)
    {last}"""


add(
    "rag_02_vectors",
    lambda b: retrieval.vectors(b.documents),
    retrieval_sql(
        f"select doc_id, kind, {retrieval.WIDTH} as dimensions, coalesce(nonzero, 0) as nonzero, coalesce(norm, 0) as norm "
        "from docs left join (select doc_id, count(*) as nonzero, round(sqrt(sum(weight * weight)), 4) as norm from vectors group by doc_id) using (doc_id)"
    ),
)
add(
    "rag_03_nearest_vectors",
    lambda b: retrieval.nearest(
        b.source("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")),
        retrieval.label_queries(b.source("embeddings")),
    ),
    """with q as (select label as query_id, embedding as qv from (select *, row_number() over (partition by label order by vec_id) as rn from embeddings) where rn = 1),
    d as (select query_id, vec_id as doc_id, list_sum(list_transform(list_zip(qv, embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as dist from q, embeddings)
    select query_id, doc_id, round(dist, 6) as distance, cast(rn as integer) as rank from (select *, row_number() over (partition by query_id order by round(dist, 6), doc_id) as rn from d) where rn <= 15""",
)
add("rag_04_reranked", lambda b: retrieval.retrieve(b.documents, retrieval.questions(b.spark)).select("question_id", "doc_id", "score", "rank"), retrieval_sql("select question_id, doc_id, score, rank from reranked"))
add("rag_05_question_batch", lambda b: retrieval.answers(b.documents, retrieval.questions(b.spark)), retrieval_sql("select * from answers"))
