"""Raw retail tables derived from the benchmark tables.

Each entity is two lists of SQL expressions (first the helpers, then the raw
columns) that read the same in Spark SQL and DuckDB; the few spellings that
differ come from a dialect object. The raw frames have the shape that file
ingestion leaves behind: text columns in all regional variants, typed hints,
lineage columns and rescued JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import spread


class SparkDialect:
    @staticmethod
    def each(case: str) -> str:
        return f"explode({case})"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def mdy(day: str, seconds: bool = False) -> str:
        return f"date_format({day}, 'MM/dd/yyyy HH:mm{':ss' if seconds else ''}')"

    @staticmethod
    def ymd(day: str, seconds: bool = False) -> str:
        return f"date_format({day}, 'yyyy-MM-dd HH:mm{':ss' if seconds else ''}')"

    @staticmethod
    def day(day: str, style: str = "ymd") -> str:
        return f"date_format({day}, '{dict(ymd='yyyy-MM-dd', dmy='dd-MM-yyyy', mdy='MM/dd/yyyy')[style]}')"

    @staticmethod
    def iso(day: str) -> str:
        return f"date_format({day}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


class DuckDialect:
    @staticmethod
    def each(case: str) -> str:
        return f"unnest({case})"

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def mdy(day: str, seconds: bool = False) -> str:
        return f"strftime({day}, '%m/%d/%Y %H:%M{':%S' if seconds else ''}')"

    @staticmethod
    def ymd(day: str, seconds: bool = False) -> str:
        return f"strftime({day}, '%Y-%m-%d %H:%M{':%S' if seconds else ''}')"

    @staticmethod
    def day(day: str, style: str = "ymd") -> str:
        return f"strftime({day}, '{dict(ymd='%Y-%m-%d', dmy='%d-%m-%Y', mdy='%m/%d/%Y')[style]}')"

    @staticmethod
    def iso(day: str) -> str:
        return f"strftime({day}, '%Y-%m-%dT%H:%M:%SZ')"


def _text(number: str) -> str:
    return f"cast({number} as string)"


def _cents(c: str) -> str:
    """Money text of a non-negative number of cents."""
    return f"cast(cast(floor({c} / 100) as bigint) as string) || '.' || lpad(cast({c} % 100 as string), 2, '0')"


def _lineage(stem: str, path: str, key: str, region: str) -> dict[str, str]:
    return {
        "source_region": region,
        "_source_file_name": stem,
        "_source_file_path": f"{path} || {stem}",
        "_source_modified_time": f"cast(date '2023-12-31' + cast({key} % 7 as int) as timestamp)",
        "_ingested_at": f"cast(date '2024-01-01' + cast({key} % 7 as int) as timestamp)",
    }


def customers(d) -> tuple[str, list[dict[str, str]]]:
    k = "c_custkey"
    region_names = ["North", "South", "East", "West", "Central"]
    region = " ".join(
        f"when {i} then case when {k} % 2 = 0 then '{n[0]}' else '{n}' end" for i, n in enumerate(region_names)
    )
    cities = [("Houston", "Texas"), ("Seattle", "Washington"), ("Chicago", "Illinois"), ("Miami", "Florida"), ("Columbus", "Ohio")]
    city = f"case {k} % 5 " + " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(cities)) + " end"
    state = f"case {k} % 5 " + " ".join(f"when {i} then '{s}'" for i, (_, s) in enumerate(cities)) + " end"
    email = f"case when {k} % 41 = 5 then 'user' || {_text(k)} || '.example.com' else 'user' || {_text(k)} || '@example.com' end"
    segment = (
        f"case when {k} % 83 = 2 then 'VIP' when {k} % 71 = 0 and copy = 6 then null "
        "when c_mktsegment = 'AUTOMOBILE' then 'CONS' when c_mktsegment = 'BUILDING' then 'Consumer' "
        "when c_mktsegment = 'FURNITURE' then case when copy = 6 then 'Corporate' else 'CORP' end "
        "when c_mktsegment = 'HOUSEHOLD' then 'HO' else 'Cosumer' end"
    )
    has_mail = f"not (copy = 5 or (copy = 6 and ({k} % 5 = 4 or {k} % 34 = 7)))"
    stages = [
        {"copy": d.each(d.array(f"cast({k} % 5 + 1 as int)", "6"))},
        {
            "id": f"case when {k} % 97 = 13 and copy <> 6 then null else 'CU-' || {_text(k)} end",
            "mail": f"case when {has_mail} then {email} end",
            "nam": f"case when {k} % 89 = 3 then '  ' else c_name end",
            "seg": segment,
            "town": city,
            "land": state,
        },
        {
            "customer_id": "case when copy in (1, 4, 5) then id end",
            "CustomerID": "case when copy = 2 then id end",
            "cust_id": "case when copy = 3 then id end",
            "customer_identifier": "case when copy = 6 then id end",
            "customer_email": "case when copy <> 2 then mail end",
            "email_address": "case when copy = 2 then mail end",
            "customer_name": "case when copy not in (3, 5) then nam end",
            "full_name": "case when copy in (3, 5) then nam end",
            "segment": "case when copy not in (3, 4) then seg end",
            "customer_segment": "case when copy in (3, 4) then seg end",
            "country": "'United States'",
            "city": "case when copy = 4 then land else town end",
            "state": "case when copy = 4 then town else land end",
            "postal_code": f"lpad(cast({k} % 100000 as string), 5, '0')",
            "region": f"case when {k} % 101 = 50 then null else case c_nationkey % 5 {region} end end",
            **_lineage(
                "'customers_' || cast(copy as string) || '.csv'", "'/landing/Region%20' || cast(copy as string) || '/'", k,
                "'Region ' || cast(copy as string)",
            ),
            "_rescued_data": f"case when {k} % 103 = 9 then '{{\"loyalty\":\"L' || {_text(k)} || '\"}}' end",
        },
    ]
    return "customer", stages


def orders(d) -> tuple[str, list[dict[str, str]]]:
    k = "o_orderkey"

    def stamp(shift: int) -> str:
        day = f"(cast(o_orderdate as date) + {shift})" if shift >= 0 else f"(cast(o_orderdate as date) - {-shift})"
        return (
            f"case when {k} % 31 = 5 then case when copy = 1 then {d.day(day, 'mdy')} else {d.day(day)} end "
            f"when {k} % 29 = 4 then case when copy = 1 then {d.mdy(day, True)} else {d.ymd(day, True)} end "
            f"else case when copy = 1 then {d.mdy(day)} else {d.ymd(day)} end end"
        )

    home = f"case {k} % 3 when 0 then 1 when 1 then 3 else 5 end"
    other = f"case {k} % 3 when 0 then 3 when 1 then 5 else 1 end"
    stages = [
        {"copy": d.each(f"case when {k} % 61 = 0 then {d.array(home, other)} else {d.array(home)} end")},
        {
            "order_id": f"case when {k} % 991 = 7 then null else 'OR-' || {_text(k)} end",
            "customer_id": f"case when {k} % 499 = 3 then null when {k} % 157 = 0 then 'CU-X' || {_text(k)} else 'CU-' || {_text('o_custkey')} end",
            "vendor_id": f"case when {k} % 211 = 8 then null else 'VEN' || {_text('o_custkey % 100')} end",
            "order_purchase_date": f"case when {k} % 211 = 9 then 'not a date' when {k} % 307 = 1 then null else {stamp(0)} end",
            "order_approved_at": f"case when o_orderstatus = 'P' and {k} % 4 = 0 then null when {k} % 113 = 0 then {stamp(-1)} else {stamp(1)} end",
            "order_delivered_carrier_date": f"case when {k} % 53 = 1 then null else {stamp(3)} end",
            "order_delivered_customer_date": f"case when {k} % 47 = 2 then null when {k} % 127 = 0 then {stamp(-10)} else {stamp(7)} end",
            "order_estimated_delivery_date": f"case when copy = 5 then null else {stamp(10)} end",
            "order_status": (
                f"case when {k} % 401 = 5 then 'bogus' when {k} % 409 = 6 then null "
                f"when o_orderstatus = 'F' then case when {k} % 2 = 0 then 'delivered' else 'Delivered' end "
                f"when o_orderstatus = 'O' then case {k} % 4 when 0 then 'shipped' when 1 then 'Shipped' when 2 then 'processing' else 'Created' end "
                f"else case {k} % 4 when 0 then 'canceled' when 1 then 'Cancelled' when 2 then 'unavailable' else 'invoiced' end end"
            ),
            "ship_mode": (
                f"case when {k} % 419 = 8 then 'Drone' when {k} % 421 = 3 then null "
                "when o_orderpriority = '1-URGENT' then 'same day' when o_orderpriority = '2-HIGH' then '1st Class' "
                "when o_orderpriority = '3-MEDIUM' then '2nd Class' when o_orderpriority = '4-NOT SPECIFIED' then 'Std Class' "
                "else ' standard class ' end"
            ),
            **_lineage(
                "'orders_' || cast(copy as string) || '.csv'", "'/landing/Region%20' || cast(copy as string) || '/'", k,
                "'Region ' || cast(copy as string)",
            ),
            "_rescued_data": "cast(null as string)",
        },
    ]
    return "orders", stages


_PRODUCT_ID = "case {k} % 3 when 0 then 'FUR-' when 1 then 'OFF-' else 'TEC-' end || cast({k} as string)"

_LINE = {
    "ext_c": "cast(floor(l_extendedprice * 100 + 0.5) as bigint)",
    "pct": "cast(floor(l_discount * 100 + 0.5) as bigint)",
}


def transactions(d) -> tuple[str, list[dict[str, str]]]:
    stages = [
        {**_LINE, "reg": "case (l_orderkey + case when l_partkey % 251 = 3 then 1 else 0 end) % 3 when 0 then 3 when 1 then 2 else 4 end"},
        {
            "sales_c": "cast(floor((ext_c * (100 - pct) + 50) / 100) as bigint)",
            "oid": f"case when l_orderkey % 887 = 5 then null else 'OR-' || {_text('l_orderkey')} end",
            "pid": f"case when l_partkey % 883 = 6 then null else {_PRODUCT_ID.format(k='l_partkey')} end",
        },
        {
            "Order_id": "case when reg <> 3 then oid end",
            "Product_id": "case when reg <> 3 then pid end",
            "Sales": f"case when l_partkey % 173 = 5 then '?' when l_partkey % 179 = 2 then '-' || {_cents('sales_c')} when l_partkey % 181 = 1 then '0.00' else {_cents('sales_c')} end",
            "Quantity": f"case when l_orderkey % 191 = 4 then '?' else {_text('cast(l_quantity as int)')} end",
            "discount": f"case when l_partkey % 197 = 1 then '1.5' when l_partkey % 199 = 2 then null when reg = 4 then {_text('pct')} || '%' else '0.' || lpad({_text('pct')}, 2, '0') end",
            "profit": "case when reg = 4 then null else cast(cast(floor(sales_c * (14 - 2 * pct) / 100) as bigint) as double) / 100 end",
            "payment_type": (
                "case when l_linenumber = 7 and l_partkey % 3 = 0 then null "
                "else case l_linenumber % 4 when 0 then 'credit_card' when 1 then ' boleto ' when 2 then 'voucher' else 'debit_card' end end"
            ),
            "payment_installments": f"case when l_orderkey % 193 = 2 then '?' when l_orderkey % 227 = 3 then '0' else {_text('l_linenumber')} end",
            **_lineage(
                "'transactions_' || cast(reg as string) || '.csv'",
                "case when reg = 3 then '/landing/' else '/landing/Region%20' || cast(reg as string) || '/' end", "l_orderkey",
                "'Region ' || cast(reg as string)",
            ),
            "_rescued_data": (
                "case when reg = 3 then '{' "
                "|| case when oid is null then '' when l_linenumber = 5 then '\"Order_id\":\"' || oid || '\",' else '\"Order_ID\":\"' || oid || '\",' end "
                "|| case when pid is null then '' when l_linenumber = 6 then '\"Product_id\":\"' || pid || '\",' else '\"Product_ID\":\"' || pid || '\",' end "
                "|| '\"_file_path\":\"/landing/transactions_3.csv\"}' end"
            ),
        },
    ]
    return "lineitem", stages


def returns(d) -> tuple[str, list[dict[str, str]]]:
    day = "(cast(l_shipdate as date) + cast(l_linenumber as int))"
    stages = [
        {**_LINE, "mas": "l_orderkey % 2 = 0"},
        {"sales_c": "cast(floor((ext_c * (100 - pct) + 50) / 100) as bigint)"},
        {
            "back_c": (
                "case when l_partkey % 11 = 0 then cast(floor(sales_c * 3 / 2) as bigint) when l_partkey % 149 = 0 then 0 "
                "when l_partkey % 5 = 0 then sales_c % 100000 else cast(floor(sales_c / 10) as bigint) end"
            ),
            "oid": f"case when l_orderkey % 787 = 4 then null when l_orderkey % 67 = 0 then 'OR-X' || {_text('l_orderkey')} else 'OR-' || {_text('l_orderkey')} end",
            "why": (
                "case l_linenumber when 1 then 'Damaged' when 2 then 'Wrong Item' when 3 then ' Changed Mind ' when 4 then 'Late Delivery' "
                "when 5 then case when l_partkey % 4 = 0 then '?' else 'Defective' end "
                "when 6 then case when l_partkey % 4 = 0 then 'N/A' else 'Damaged' end "
                "else case when l_partkey % 4 = 0 then 'NULL' else 'Wrong Item' end end"
            ),
            "whn": (
                "case when l_orderkey % 109 = 6 then 'NULL' when l_orderkey % 223 = 7 then null "
                f"when l_linenumber % 3 = 0 then {d.day(day)} when l_linenumber % 3 = 1 then {d.day(day, 'dmy')} else {d.day(day, 'mdy')} end"
            ),
            "stat": "case l_partkey % 3 when 0 then 'Approved' when 1 then 'Pending' else 'Rejected' end",
        },
        {
            "dol": (
                "'$' || case when back_c >= 100000 then cast(cast(floor(back_c / 100000) as bigint) as string) || ',' "
                "|| lpad(cast(cast(floor(back_c / 100) as bigint) % 1000 as string), 3, '0') "
                "else cast(cast(floor(back_c / 100) as bigint) as string) end || '.' || lpad(cast(back_c % 100 as string), 2, '0')"
            ),
        },
        {
            "order_id": "case when mas then oid end",
            "OrderId": "case when not mas then oid end",
            "return_reason": "case when mas then why end",
            "reason": "case when not mas then why end",
            "return_date": "case when mas then whn end",
            "date_of_return": "case when not mas then whn end",
            "refund_amount": (
                "case when not mas or l_partkey % 4 = 1 then null when l_partkey % 28 = 2 then cast('NaN' as double) "
                "else cast(back_c as double) / 100 end"
            ),
            "amount": "case when mas then null else cast(back_c as double) / 100 end",
            "return_status": "case when mas then stat end",
            "status": "case when not mas then stat end",
            **_lineage(
                "case when mas then 'returns_1.json' else 'returns_2.json' end",
                "case when mas then '/landing/Region%206/' else '/landing/' end", "l_orderkey",
                "case when mas then 'Region 6' else 'root' end",
            ),
            "_rescued_data": "case when mas and l_partkey % 4 = 1 then '{\"refund_amount\":\"' || dol || '\"}' end",
        },
    ]
    return "lineitem where l_returnflag = 'R'", stages


def products(d) -> tuple[str, list[dict[str, str]]]:
    k = "p_partkey"
    added = f"(date '2016-01-01' + cast({k} % 700 as int))"
    updated = f"(date '2018-01-01' + cast({k} % 500 as int))"
    stages = [
        {"copy": d.each(f"case when {k} % 59 = 0 then {d.array('1', '2')} else {d.array('1')} end")},
        {
            "product_id": f"case when {k} % 509 = 4 then null else {_PRODUCT_ID.format(k=k)} end",
            "product_name": f"case when {k} % 503 = 5 then null when {k} % 307 = 2 then '   ' else ' ' || p_name || ' ' || {_text(k)} || case when copy = 2 then ' (old) ' else ' ' end end",
            "categories": (
                f"case when {k} % 301 = 3 then null when {k} % 311 = 4 then ' ' when p_type = 'ECONOMY' then 'Clothing,Women' "
                "when p_type = 'SMALL' then 'Men Shoes' when p_type = 'MEDIUM' then 'Shoe Care' when p_type = 'PROMO' then 'Sport clothing' "
                "when p_type = 'STANDARD' then 'Furniture' else 'WOMENS Shoes' end"
            ),
            "sizes": (
                "case p_size % 10 when 0 then null when 1 then 'Extra Large, X-Small, 10 M, http://x, 9.5, 9.5' when 2 then 'small,medium,Large' "
                "when 3 then '8, 8.5W, 9N, 156E' when 4 then 'S,M,L,XL,XXL' when 5 then 'n/a' when 6 then '2X, 3X,4X' when 7 then 'X-Large,Extra Small,S' "
                "when 8 then ' 40 , 44.5 ,, 40' else 'One size fits all' end"
            ),
            "colors": f"case when {k} % 3 = 0 then null else 'Red,Blue' end",
            "weight": f"case {k} % 6 when 0 then '1.5 kg' when 1 then '500 g' when 2 then '2 lbs' when 3 then '3 oz' when 4 then '1.2.3 KG' else null end",
            "upc": f"case {k} % 4 when 0 then null when 1 then '6.4E+11' when 2 then '64' || lpad(cast({k} % 100000000 as string), 8, '0') else 'UPC-' || {_text(k)} end",
            "manufacturer": f"case when {k} % 2 = 0 then p_brand end",
            "dimension": "cast(null as string)",
            "dateAdded": f"case when {k} % 131 = 7 then 'yesterday' else {d.iso(f'cast({added} as timestamp)')} end",
            "dateUpdated": f"case when {k} % 137 = 8 then null else {d.iso(f'cast({updated} as timestamp)')} end",
            **_lineage("'products.json'", "'/landing/'", k, "'global'"),
            "_rescued_data": "cast(null as string)",
        },
    ]
    return "part", stages


def vendors(d) -> tuple[str, list[dict[str, str]]]:
    k = "s_suppkey"
    stages = [
        {"copy": d.each(f"case when {k} % 37 = 0 then {d.array('1', '2')} else {d.array('1')} end")},
        {
            "vendor_id": f"case when {k} % 43 = 6 then null when {k} % 17 = 3 then 'VND-' || {_text(k)} else ' VEN' || {_text(k)} || ' ' end",
            "vendor_name": f"case when {k} % 23 = 4 then ' ' else '  ' || lower(s_name) || case when copy = 2 then ' branch' else ' LTD' end end",
            **_lineage("'vendors.csv'", "'/landing/'", k, "'global'"),
            "_rescued_data": "cast(null as string)",
        },
    ]
    return "supplier", stages


ENTITIES = {
    "customers": customers,
    "orders": orders,
    "transactions": transactions,
    "returns": returns,
    "products": products,
    "vendors": vendors,
}


def raw_frame(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """The raw table of an entity, as a lazy projection of the benchmark table."""
    source, stages = ENTITIES[entity](SparkDialect)
    table, _, predicate = source.partition(" where ")
    df = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if predicate:
        df = df.filter(predicate)
    for i, stage in enumerate(stages):
        keep = [] if i == len(stages) - 1 else ["*"]
        df = df.selectExpr(*keep, *[f"{sql} as `{name}`" for name, sql in stage.items()])
    return df


def raw_sql(entity: str) -> str:
    """The same table as a DuckDB query."""
    source, stages = ENTITIES[entity](DuckDialect)
    sql = source
    for i, stage in enumerate(stages):
        columns = ", ".join(f'{e} as "{n}"' for n, e in stage.items())
        keep = "" if i == len(stages) - 1 else "*, "
        sql = f"select {keep}{columns} from " + (sql if i == 0 else f"({sql})")
    return sql
