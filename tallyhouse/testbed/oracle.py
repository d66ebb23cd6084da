"""The same layers as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

import re

from ..functions import vocab
from .raw import ENTITIES, raw_sql


def scaled(e: str, digits: int = 4) -> str:
    return f"cast(floor(({e}) * {10**digits}::double + 0.5) as bigint)"


def xsum(e: str, digits: int = 4) -> str:
    return f"(cast(sum({scaled(e, digits)}) as bigint) / {10**digits}::double)"


def xavg(e: str, digits: int = 4) -> str:
    return f"({xsum(e, digits)} / nullif(count({e}), 0))"


def pct(part: str, whole: str) -> str:
    return f"(floor((({part}) * 100.0::double / nullif({whole}, 0)) * 100 + 0.5) / 100.0::double)"


def fixed2(e: str) -> str:
    h = f"cast(floor(({e}) * 100::double + 0.5) as bigint)"
    return (
        f"(case when {h} < 0 then '-' else '' end || cast(abs({h}) // 100 as varchar) || '.' "
        f"|| lpad(cast(abs({h}) % 100 as varchar), 2, '0'))"
    )


def dollars(e: str) -> str:
    return f"('$' || {fixed2(e)})"


def spelled(c: str, spellings: dict[str, list[str]], default: str | None = None) -> str:
    whens = " ".join(f"when {c} in ({', '.join(repr(v) for v in vs)}) then '{k}'" for k, vs in spellings.items())
    return f"case {whens} else {default or c} end"


def initcap(c: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def dates(c: str, *formats: str) -> str:
    listed = ", ".join(f"'{f}'" for f in formats)
    return f"cast(try_strptime({c}, [{listed}]) as date)"


def order_date(c: str) -> str:
    return dates(c, "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y")


def stamp(c: str) -> str:
    return f"try_strptime({c}, ['%m/%d/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])"


def date_key(c: str) -> str:
    return f"cast(strftime({c}, '%Y%m%d') as integer)"


STATES = "(" + ", ".join(f"'{s}'" for s in vocab.US_STATES) + ")"
GARBAGE = "('?', 'NULL', 'N/A', '-', 'NA', 'NONE')"
CID = 'coalesce(customer_id, "CustomerID", cust_id, customer_identifier)'
MAIL = "coalesce(customer_email, email_address)"
LINE_OID = "coalesce(Order_id, json_extract_string(_rescued_data, '$.Order_ID'), json_extract_string(_rescued_data, '$.Order_id'))"
STEM = "regexp_extract(_source_file_name, '^([^.-]+)', 1)"
LINEAGE = "_rescued_data, _source_file_path, _source_file_name, _source_modified_time, _ingested_at"


def _sizes() -> str:
    text = "sizes"
    for word, code in vocab.SIZE_WORDS:
        text = f"regexp_replace({text}, '(?i)\\b{word}\\b', '{code}', 'g')"
    tokens = f"list_transform(string_split({text}, ','), lambda t: regexp_replace(trim(t), '(\\d)\\s+([A-Za-z])', '\\1\\2', 'g'))"
    valid = f"list_filter({tokens}, lambda t: regexp_matches(t, '{vocab.SIZE_TOKEN}'))"
    once = f"list_filter({valid}, lambda x, i: list_position({valid}, x) = i)"
    return f"case when len({valid}) > 0 then array_to_string({once}, ',') else 'One Size' end"


KG = (
    "case lower(regexp_extract(weight, '([a-zA-Z]+)', 1)) when 'kg' then {w} when 'g' then {w} / 1000 "
    "when 'lb' then {w} * 0.453592::double when 'lbs' then {w} * 0.453592::double when 'pound' then {w} * 0.453592::double "
    "when 'pounds' then {w} * 0.453592::double end"
).format(w="try_cast(regexp_extract(weight, '([0-9.]+)', 1) as double)")

ORDER_FIELD = (
    "case when order_id is null then 'order_id' when customer_id is null then 'customer_id' when vendor_id is null then 'vendor_id' "
    "when order_purchase_date is null then 'order_purchase_date' when order_delivered_customer_date < order_purchase_date then 'order_delivered_customer_date' "
    "when order_estimated_delivery_date is null then 'order_estimated_delivery_date' when order_delivered_carrier_date is null then 'order_delivered_carrier_date' "
    "when order_delivered_customer_date is null then 'order_delivered_customer_date' when order_approved_at is null then 'order_approved_at' else 'unknown' end"
)
ORDER_ISSUE = (
    "case when order_id is null then 'missing_order_id' when customer_id is null then 'missing_customer_id' when vendor_id is null then 'missing_vendor_id' "
    "when order_purchase_date is null then 'missing_purchase_date' when order_delivered_customer_date < order_purchase_date then 'invalid_delivery_date' "
    "when order_status is null then 'missing_order_status' else 'other_issue' end"
)
CUSTOMER_FIELD = (
    "case when issue_type like '%email%' then 'customer_email' when issue_type like '%segment%' then 'segment' "
    "when issue_type like '%postal%' then 'postal_code' else 'unknown' end"
)
DATE_KIND = (
    "case when {c} is null then 'NULL' when upper(trim({c})) = 'NULL' then 'STRING_NULL' when regexp_matches({c}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') then 'MM/DD/YYYY' "
    "when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'YYYY-MM-DD' when regexp_matches({c}, '^\\d{{2}}-\\d{{2}}-\\d{{4}}') then 'DD-MM-YYYY' else 'UNKNOWN' end"
)
ISSUES = (
    f"select entity, field, issue, issue_type, count(*) as count from (select 'customers' as entity, {CUSTOMER_FIELD} as field, split_part(issue_type, ', ', 1) as issue, issue_type from quar_customers "
    f"union all select 'orders', {ORDER_FIELD}, {ORDER_ISSUE}, issue_type from quar_orders) group by all"
)

RULES = {
    "customers": {
        "valid_customer_id": ("customer_id is not null", "missing_customer_id"),
        "valid_customer_email": ("customer_email is not null", "missing_customer_email"),
        "valid_customer_name": ("customer_name is not null and trim(customer_name) <> ''", "missing_customer_name"),
        "valid_segment": ("segment in ('Home Office', 'Corporate', 'Consumer')", "invalid_segment"),
        "valid_region": ("region in ('North', 'South', 'East', 'West', 'Central')", "invalid_region"),
    },
    "orders": {
        "valid_order_id": ("order_id is not null", "missing_order_id"),
        "valid_customer_id": ("customer_id is not null", "missing_customer_id"),
        "valid_purchase_date": ("order_purchase_date is not null", "missing_purchase_date"),
        "valid_approved_date": ("order_approved_at is not null", "missing_approved_date"),
        "valid_carrier_date": ("order_delivered_carrier_date is not null", "missing_carrier_date"),
        "valid_customer_delivery_date": ("order_delivered_customer_date is not null", "missing_delivery_date"),
        "valid_order_status": (
            "order_status in ('Processing', 'Shipped', 'Cancelled', 'Delivered', 'Created', 'Invoiced', 'Unavailable')",
            "invalid_order_status",
        ),
        "valid_ship_mode": ("ship_mode in ('Standard Class', 'Second Class', 'First Class', 'Same Day')", "invalid_ship_mode"),
    },
    "products": {
        "valid_product_id": ("product_id is not null", "missing_product_id"),
        "valid_product_name": ("product_name is not null and trim(product_name) <> ''", "missing_product_name"),
        "valid_category": ("categories is not null and trim(categories) <> ''", "missing_category"),
    },
    "returns": {
        "valid_order_id": ("order_id is not null", "missing_order_id"),
        "valid_return_date": ("return_date is not null", "missing_return_date"),
        "valid_refund_amount": ("refund_amount is not null and refund_amount > 0", "missing_refund_amount"),
        "valid_return_reason": ("return_reason is not null", "missing_return_reason"),
    },
    "transactions": {
        "valid_order_id": ("order_id is not null", "missing_order_id"),
        "valid_product_id": ("product_id is not null", "missing_product_id"),
        "valid_sales": ("sales is not null and sales > 0", "invalid_sales"),
        "valid_quantity": ("quantity is not null and quantity > 0", "invalid_quantity"),
        "valid_discount": ("discount is not null and discount >= 0 and discount <= 1", "invalid_discount"),
        "valid_payment_type": ("payment_type is not null", "missing_payment_type"),
        "valid_installments": ("payment_installments is not null and payment_installments > 0", "invalid_installments"),
    },
    "vendors": {
        "valid_vendor_id": ("vendor_id is not null and trim(vendor_id) <> ''", "missing_vendor_id"),
        "valid_vendor_name": ("vendor_name is not null and trim(vendor_name) <> ''", "missing_vendor_name"),
        "valid_vendor_id_fmt": ("vendor_id is null or regexp_matches(vendor_id, '^VEN[0-9]+$')", "invalid_vendor_id_format"),
    },
}


def _tag(entity: str) -> str:
    rules = RULES[entity].values()
    bad = " or ".join(f"not coalesce({valid}, false)" for valid, _ in rules)
    labels = ", ".join(f"case when not coalesce({valid}, false) then '{label}' end" for valid, label in rules)
    return f"select *, ({bad}) as is_quarantined, concat_ws(', ', {labels}) as issue_type from std_{entity}"


def _first(entity: str, keys: str, order: str, columns: str = f"* exclude ({LINEAGE}, is_quarantined, issue_type)") -> str:
    ranked = f"select *, row_number() over (partition by {keys} order by {order}) as rn from tag_{entity} where not is_quarantined"
    return f"select {columns.replace('issue_type)', 'issue_type, rn)')} from ({ranked}) where rn = 1"


SCORE = "(case when customer_email is not null then 2 else 0 end + case when customer_name is not null then 1 else 0 end + case when segment is not null then 1 else 0 end + case when region is not null then 1 else 0 end)"

CTES = {f"raw_{e}": raw_sql(e) for e in ENTITIES} | {
    "std_customers": f"""
        select {CID} as customer_id, {MAIL} as customer_email, coalesce(customer_name, full_name) as customer_name,
          {spelled('coalesce(segment, customer_segment)', vocab.SEGMENTS)} as segment, country,
          case when city in {STATES} then state else city end as city,
          case when city in {STATES} then city else state end as state, postal_code,
          {spelled('region', vocab.REGIONS)} as region, source_region, {LINEAGE}
        from raw_customers""",
    "std_orders": f"""
        select * replace ({', '.join(f'{order_date(c)} as {c}' for c in vocab.ORDER_DATE_COLUMNS)},
          {spelled('order_status', vocab.ORDER_STATUSES)} as order_status,
          {spelled('ship_mode', vocab.SHIP_MODES, initcap('trim(ship_mode)'))} as ship_mode)
        from raw_orders""",
    "std_transactions": f"""
        select coalesce(json_extract_string(_rescued_data, '$.Order_ID'), json_extract_string(_rescued_data, '$.Order_id'), r.Order_id) as order_id,
          coalesce(json_extract_string(_rescued_data, '$.Product_ID'), json_extract_string(_rescued_data, '$.Product_id'), r.Product_id) as product_id,
          try_cast(r.Sales as double) as sales, try_cast(r.Quantity as integer) as quantity,
          case when r.discount like '%\\%' escape '\\' then try_cast(replace(r.discount, '%', '') as double) / 100 else try_cast(r.discount as double) end as discount,
          coalesce(r.profit, 0::double) as profit, r.profit is null as profit_was_null, trim(r.payment_type) as payment_type,
          try_cast(r.payment_installments as integer) as payment_installments, source_region, {LINEAGE}
        from raw_transactions r""",
    "std_returns": f"""
        select coalesce(r.order_id, r.OrderId) as order_id,
          case when upper(trim(coalesce(r.return_reason, r.reason))) not in {GARBAGE} then trim(coalesce(r.return_reason, r.reason)) end as return_reason,
          {dates("case when upper(trim(coalesce(r.return_date, r.date_of_return))) <> 'NULL' then coalesce(r.return_date, r.date_of_return) end", '%Y-%m-%d', '%d-%m-%Y', '%m/%d/%Y')} as return_date,
          coalesce(try_cast(regexp_replace(json_extract_string(_rescued_data, '$.refund_amount'), '[$,]', '', 'g') as double),
            case when not isnan(r.refund_amount) then r.refund_amount end, case when not isnan(r.amount) then r.amount end) as refund_amount,
          coalesce(r.return_status, r.status) as return_status, {LINEAGE}
        from raw_returns r""",
    "std_products": f"""
        select * replace ({_sizes()} as sizes,
          {dates('dateAdded', '%Y-%m-%dT%H:%M:%SZ')} as "dateAdded", {dates('dateUpdated', '%Y-%m-%dT%H:%M:%SZ')} as "dateUpdated",
          coalesce(colors, 'Not Specified') as colors),
          case when lower(categories) like '%women%' then 'Women' when lower(categories) like '%men%' then 'Men'
            when lower(categories) like '%shoe%' then 'Shoes' when lower(categories) like '%clothing%' then 'Clothing' else 'Other' end as category
        from raw_products""",
    "std_vendors": f"select * replace (trim(vendor_id) as vendor_id, {initcap('trim(vendor_name)')} as vendor_name) from raw_vendors",
} | {f"tag_{e}": _tag(e) for e in ENTITIES} | {
    f"quar_{e}": f"select * exclude (is_quarantined) from tag_{e} where is_quarantined" for e in ENTITIES
} | {
    "clean_customers": _first("customers", "customer_id", f"{SCORE} desc, source_region, customer_email nulls first, customer_name"),
    "clean_orders": _first("orders", "order_id", "source_region, customer_id, vendor_id nulls first"),
    "clean_products": _first(
        "products", "product_id", "trim(product_name)",
        f"* exclude ({LINEAGE}, is_quarantined, issue_type) replace (trim(product_name) as product_name, {KG} as weight)",
    ),
    "clean_returns": f"select * exclude ({LINEAGE}, is_quarantined, issue_type) from tag_returns where not is_quarantined",
    "clean_transactions": f"select * exclude ({LINEAGE}, is_quarantined, issue_type) from tag_transactions where not is_quarantined",
    "clean_vendors": _first("vendors", "vendor_id", "vendor_name"),
    "dim_date": f"""
        select date, {date_key('date')} as date_key, cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(day(date) as integer) as day
        from (select distinct order_purchase_date as date from clean_orders)""",
    "dim_region": "select source_region, row_number() over (order by source_region) as region_key from (select distinct region as source_region from clean_customers)",
    "dim_product": "select *, row_number() over (order by product_id) as product_key from clean_products",
    "dim_vendor": "select *, row_number() over (order by vendor_id) as vendor_key from clean_vendors",
    "dim_customer": """
        select row_number() over (order by customer_id) as customer_key, customer_id, customer_name, customer_email,
          segment as customer_segment, region, country, city, state, source_region from clean_customers
        union all select -1, 'UNKNOWN', 'UNKNOWN', null, 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', null, null, 'UNKNOWN'""",
    "keyed_orders": """
        select o.order_id, o.customer_id, o.vendor_id, o.order_purchase_date, o.source_region as order_region,
          c.customer_key, c.region, v.vendor_key, g.region_key
        from clean_orders o left join (select * from dim_customer where customer_key <> -1) c on o.customer_id = c.customer_id
          left join dim_vendor v on o.vendor_id = v.vendor_id left join dim_region g on c.region = g.source_region""",
    "fact_transactions": f"""
        select t.order_id, coalesce(o.customer_key, -1) as customer_key, p.product_key, o.vendor_key, {date_key('o.order_purchase_date')} as date_key,
          o.region_key, t.sales as sales_amount, o.order_purchase_date is not null as order_link_flag
        from clean_transactions t left join keyed_orders o on t.order_id = o.order_id left join dim_product p on t.product_id = p.product_id
        where t.sales > 0""",
    "order_sales": f"""
        select order_id, {xsum('sales')} as sales, case when min(product_id) = max(product_id) then min(product_id) end as product_id
        from clean_transactions group by order_id""",
}


def _fact_returns(sold: str) -> str:
    key = "coalesce(o.customer_key, -1)"
    ratio = "r.refund_amount / s.sales"
    days = "cast(date_diff('day', o.order_purchase_date, r.return_date) as integer)"
    return f"""
        select r.order_id, o.customer_id, {key} as customer_key, p.product_key, o.vendor_key, {date_key('r.return_date')} as date_key, o.region_key,
          r.refund_amount as return_amount, s.sales as transaction_amount, o.order_purchase_date, r.return_date, r.return_reason,
          o.order_id is not null as has_order_flag, s.sales is not null as has_transaction_flag, s.sales is null as missing_txn_flag,
          r.refund_amount > 1000 as high_return_flag, r.refund_amount > 0 as is_valid_return,
          case when r.refund_amount is null then 'MISSING_AMOUNT' when r.refund_amount <= 0 then 'INVALID_AMOUNT'
            when {key} = -1 then 'MISSING_CUSTOMER' when {days} < 0 then 'NEGATIVE_DAYS' else 'VALID' end as data_quality_flag,
          {ratio} as return_to_purchase_ratio, {ratio} > 1.2::double as suspicious_ratio_flag, o.order_id is null as return_without_order_flag,
          {days} as days_to_return, {days} <= 2 as quick_return_flag
        from clean_returns r left join keyed_orders o on r.order_id = o.order_id left join {sold} s on r.order_id = s.order_id
          left join dim_product p on s.product_id = p.product_id"""


CTES |= {
    "fact_returns": _fact_returns("order_sales"),
    "fact_returns_line": _fact_returns("clean_transactions"),
    "revenue_by_region": f"""
        select g.source_region, {xsum('sales_amount')} as total_revenue, count(distinct order_id) as total_orders, {xavg('sales_amount')} as avg_order_value
        from fact_transactions f left join dim_region g on f.region_key = g.region_key group by 1""",
    "vendor_returns": f"""
        select v.vendor_name, count(*) as total_returns, {xsum('return_amount')} as total_return_value, {xavg('return_to_purchase_ratio', 6)} as avg_return_ratio
        from fact_returns f left join dim_vendor v on f.vendor_key = v.vendor_key group by 1""",
    "vendor_returns_line": f"""
        select v.vendor_name, count(*) as total_returns, {xsum('return_amount')} as total_return_value, {xavg('return_to_purchase_ratio', 6)} as avg_return_ratio
        from fact_returns_line f left join dim_vendor v on f.vendor_key = v.vendor_key group by 1""",
    "inventory_velocity": f"""
        select p.product_name, {xsum('sales_amount')} as total_sales, count(order_id) as order_count
        from fact_transactions f left join dim_product p on f.product_key = p.product_key group by 1""",
    "slow_products": f"""
        select product_name, category, region_name, case when order_count < usual * 0.5::double then 'slow-moving' when order_count > usual * 1.5::double then 'fast-moving' else 'steady' end as movement_status,
          order_count, total_sales
        from (select *, avg(order_count) over (partition by region_name) as usual from (
          select p.product_key, any_value(p.product_name) as product_name, any_value(p.category) as category, g.source_region as region_name, count(*) as order_count, {xsum('sales_amount')} as total_sales
          from fact_transactions f join dim_product p on f.product_key = p.product_key join dim_region g on f.region_key = g.region_key group by p.product_key, g.source_region))""",
    "top_categories": f"""
        select g.source_region as region_name, p.category, count(distinct order_id) as total_orders, {xsum('sales_amount')} as total_revenue,
          {xsum('sales_amount')} / count(distinct order_id) as avg_order_value
        from fact_transactions f join dim_product p on f.product_key = p.product_key join dim_region g on f.region_key = g.region_key group by 1, 2""",
    "high_return_products": f"""
        select p.product_name, p.category, return_count, total_return_value, avg_return_ratio from (
          select l.product_id, cast(sum(b.n) as bigint) as return_count,
            cast(sum(cast(floor(b.refund * (l.part / w.whole) + 0.5) as bigint)) as bigint) / 10000::double as total_return_value,
            {xavg('b.refund / w.whole', 6)} as avg_return_ratio
          from (select order_id, cast(sum({scaled('refund_amount')}) as bigint) as refund, count(*) as n from clean_returns group by 1) b
            join (select order_id, cast(sum({scaled('sales')}) as bigint) as whole from clean_transactions group by 1) w using (order_id)
            join (select order_id, product_id, cast(sum({scaled('sales')}) as bigint) as part from clean_transactions group by 1, 2) l using (order_id)
          group by 1) x join dim_product p using (product_id)""",
    "ranked_vendors": """
        select coalesce(vendor_name, 'Unknown Vendor') as vendor_name, total_returns, total_return_value, avg_return_ratio,
          row_number() over (order by coalesce(-avg_return_ratio, 0), coalesce(vendor_name, 'Unknown Vendor')) as vendor_rank from vendor_returns""",
    "ranked_return_products": "select *, row_number() over (order by total_return_value desc, product_name) as product_rank from high_return_products",
    "customer_profile": f"""
        select f.customer_key, c.customer_id, c.customer_name, c.region, c.customer_segment as segment, x.* exclude (customer_key) from (
          select customer_key, count(*) as total_returns, {xsum('return_amount')} as total_return_value, {xavg('return_to_purchase_ratio', 6)} as avg_return_ratio,
            coalesce(max(cast(suspicious_ratio_flag as integer)), 0) as has_suspicious, coalesce(max(cast(quick_return_flag as integer)), 0) as has_quick_return
          from fact_returns group by 1) x join (select distinct customer_key from fact_returns) f using (customer_key) join dim_customer c using (customer_key)""",
    "scored_customers": """
        select *, anomaly_score >= 30 as flagged from (select *,
          case when total_returns > 5 then 20 else 0 end + case when total_return_value > 1000 then 25 else 0 end + case when avg_return_ratio > 0.5 then 25 else 0 end
            + case when has_suspicious > 0 then 25 else 0 end + case when has_quick_return > 0 then 15 else 0 end as anomaly_score,
          concat_ws(',', case when total_returns > 5 then 'high_return_frequency' end, case when total_return_value > 1000 then 'high_return_value' end,
            case when avg_return_ratio > 0.5 then 'high_return_ratio' end, case when has_suspicious > 0 then 'suspicious_pattern' end,
            case when has_quick_return > 0 then 'quick_return_behavior' end) as rules_triggered
        from customer_profile where customer_key <> -1)""",
}


def split_count(entity: str) -> str:
    key = {"customers": "customer_id", "orders": "order_id", "products": "product_id", "vendors": "vendor_id"}.get(entity)
    good = f"count(distinct case when not is_quarantined then {key} end)" if key else "count(*) filter (not is_quarantined)"
    return f"select '{entity}' as entity, {good} as clean_count, count(*) filter (is_quarantined) as quarantine_count from tag_{entity}"


REPORTED = ["customers", "orders", "products", "returns", "transactions"]
CTES["split_counts"] = (
    f"select *, {pct('quarantine_count', 'clean_count + quarantine_count')} as quarantine_rate_pct from ("
    + " union all ".join(split_count(e) for e in REPORTED)
    + ")"
)


def with_ctes(sql: str) -> str:
    """``sql`` with the CTEs it needs, directly or through others, in order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    if not needed:
        return sql
    head = "with " + ",\n".join(f"{n} as ({CTES[n].strip()})" for n in CTES if n in needed)
    own = re.match(r"\s*with\s+", sql)
    return f"{head},\n{sql[own.end():]}" if own else f"{head}\n{sql}"
