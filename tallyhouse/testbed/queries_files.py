"""Files and streams: sources, sinks, Structured Streaming and text generation.

These write the whole derived tables as files below the shared folder and read
them back, so their work grows with the tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators.report import stack
from ..plans import cleanse, enrich, kpi, retrieval, standardise, verify
from ..plans.star import Star
from ..sources import inventory, landing, store
from ..sources.entities import ENTITIES
from ..streaming import ingest, progress, tables as streams
from . import oracle as O
from .catalog import add
from .queries_jobs import retrieval_sql


def rows_n():
    return F.count(F.lit(1))

def stem():
    return F.regexp_extract("_source_file_name", r"^([^.-]+)", 1)

# -- sources ------------------------------------------------------------------


def _two_runs(b, entity: str):
    table, checkpoint = b.folder(f"ingested_{entity}"), b.folder("checkpoint")
    counts = []
    for _ in range(2):
        ingest.ingest(b.spark, ENTITIES[entity], b.landed(entity), table, checkpoint)
        counts.append(verify.row_counts({entity: ingest.raw_table(b.spark, table)}))
    return counts


add(
    "src_01_incremental_files",
    lambda b: verify.stable_counts(*_two_runs(b, "orders")),
    "select 'orders' as entity, count(*) as rows_before, count(*) as rows_after, true as stable from raw_orders",
)


def _landed(b, entity: str):
    return landing.read_entity(b.spark, ENTITIES[entity], b.landed(entity))


def _columns(entity: str) -> str:
    return ", ".join(f'"{c}"' for c in ENTITIES[entity].columns)


add(
    "src_02_csv_by_name",
    lambda b: _landed(b, "customers").select(*ENTITIES["customers"].columns, "source_region"),
    f"select {_columns('customers')}, source_region from raw_customers",
)
add(
    "src_03_multiline_json",
    lambda b: _landed(b, "returns").withColumns(
        {"is_nan": F.coalesce(F.isnan("refund_amount"), F.lit(False)), "refund_amount": F.nanvl("refund_amount", F.lit(None).cast("double"))}
    ).select(*ENTITIES["returns"].columns, "is_nan", "source_region"),
    "select * replace (case when not isnan(refund_amount) then refund_amount end as refund_amount), coalesce(isnan(refund_amount), false) as is_nan "
    f"from (select {_columns('returns')}, source_region from raw_returns)",
)
add(
    "src_03_multiline_json_products",
    lambda b: _landed(b, "products").select(*ENTITIES["products"].columns, "_rescued_data", "source_region"),
    f"select {_columns('products')}, _rescued_data, source_region from raw_products",
)
add(
    "src_04_file_selection",
    lambda b: stack([landing.list_files(b.spark, b.landing, e.glob).select(F.lit(e.name).alias("entity"), F.regexp_extract("path", r"([^/.-]+)[^/]*$", 1).alias("system")) for e in ENTITIES.values()]).distinct(),
    " union all ".join(f"select distinct '{e}' as entity, {O.STEM} as system from raw_{e}" for e in O.ENTITIES),
)
add(
    "src_05_types_and_hints",
    lambda b: landing.infer_types(b.raw("transactions").withColumn("profit", F.col("profit").cast("string")), list(ENTITIES["transactions"].columns), ENTITIES["transactions"].hints),
    " union all ".join(
        f"select '{c}' as column_name, "
        + ("any_value('double')" if c == "profit" else f"case when count(try_cast(\"{c}\" as bigint)) = count(\"{c}\") then 'bigint' when count(try_cast(\"{c}\" as double)) = count(\"{c}\") then 'double' when count(try_cast(\"{c}\" as timestamp)) = count(\"{c}\") then 'timestamp' else 'string' end")
        + " as inferred_type from raw_transactions"
        for c in ENTITIES["transactions"].columns
    ),
)
add(
    "src_06_rescue_column",
    lambda b: stack([_landed(b, e).select(F.lit(e).alias("entity"), stem().alias("system"), "_rescued_data") for e in ["customers", "returns"]]),
    f"select 'customers' as entity, {O.STEM} as system, _rescued_data from raw_customers union all "
    f"select 'returns', {O.STEM}, case when isnan(refund_amount) then null else _rescued_data end from raw_returns",
)
add(
    "src_06_rescue_column_transactions",
    lambda b: _landed(b, "transactions").select(stem().alias("system"), "Sales", "profit", F.from_json("_rescued_data", "map<string,string>").alias("r"))
    .select("system", "Sales", "profit", F.col("r")["Order_ID"].alias("order_id"), F.col("r")["Product_ID"].alias("product_id")),
    f"select {O.STEM} as system, Sales, profit, coalesce(json_extract_string(_rescued_data, '$.Order_ID'), json_extract_string(_rescued_data, '$.Order_id')) as order_id, "
    "coalesce(json_extract_string(_rescued_data, '$.Product_ID'), json_extract_string(_rescued_data, '$.Product_id')) as product_id from raw_transactions",
)
add(
    "src_07_lineage_columns",
    lambda b: verify.audit_completeness({e: _landed(b, e) for e in ENTITIES}),
    " union all ".join(
        f"select '{e}' as entity, count(*) as total_rows, count(*) as has_file_path, count(*) as has_file_name, count(*) as has_modified_time, count(*) as has_ingested_at from raw_{e}" for e in O.ENTITIES
    ),
)
add(
    "src_08_source_region",
    lambda b: stack([b.raw(e).select("_source_file_name", landing.region_of(F.col("_source_file_path"), F.col("_source_file_name")).alias("region")) for e in ENTITIES]),
    " union all ".join(f"select _source_file_name, source_region as region from raw_{e}" for e in O.ENTITIES),
)


def _raw_load(b):
    return verify.region_coverage({e: _landed(b, e) for e in ENTITIES})


add("src_09_raw_tables", _raw_load, " union all ".join(f"select '{e}' as entity, source_region, count(*) as row_count from raw_{e} group by source_region" for e in O.ENTITIES))
add(
    "src_10_file_inventory",
    lambda b: inventory.entity_status(inventory.source_files(b.spark, b.landing)),
    " union all ".join(f"select '{e}' as entity, count(distinct _source_file_name) as systems, 'OK' as status from raw_{e}" for e in O.ENTITIES),
)

for _entity in ENTITIES:
    # files to the clean table, without the stored raw one
    add(f"src_09_files_to_clean_{_entity}", lambda b, e=_entity: cleanse.clean(_landed(b, e), e), f"select * from clean_{_entity}")


def _reads(b):
    path = b.folder("orders_table")
    store.write_files(b.clean("orders"), path)
    view = store.create_view(b.spark.read.parquet(path), "tallyhouse_clean_orders")
    copy, checkpoint = b.folder("orders_streamed"), b.folder("checkpoint")
    streams.append_table(streams.table_stream(b.spark, path), copy, checkpoint)
    return stack([df.agg(rows_n().alias("row_count")).select(F.lit(k).alias("read_as"), "row_count") for k, df in [("batch", b.spark.read.parquet(path)), ("stream", b.spark.read.parquet(copy)), ("view", view)]])


add("src_11_table_reads", _reads, " union all ".join(f"select '{k}' as read_as, count(*) as row_count from clean_orders" for k in ["batch", "stream", "view"]))
add(
    "src_12_literal_member_row",
    lambda b: b.star().dim_customer.groupBy((F.col("customer_key") == -1).alias("is_unknown")).agg(rows_n().alias("row_count")),
    "select customer_key = -1 as is_unknown, count(*) as row_count from dim_customer group by 1",
)

# -- sinks --------------------------------------------------------------------------


def _stream_append(b):
    out = b.folder("transactions_appended")
    raw = b.folder("transactions_raw")
    store.write_files(b.raw("transactions"), raw)
    streams.append_table(standardise.transactions(streams.table_stream(b.spark, raw)), out, b.folder("checkpoint"))
    return b.spark.read.parquet(out).select("order_id", "product_id", "sales", "discount")


add("snk_01_stream_append", _stream_append, "select order_id, product_id, sales, discount from std_transactions")


def _dim_table(b):
    path = b.folder("dim_product")
    store.write_files(b.lazy_star().dim_product, path)
    return store.write_files(b.lazy_star().dim_product, path)


add("snk_02_recomputed_table", _dim_table, "select * from dim_product")


def _report(b):
    name, path = "tallyhouse_vendor_returns", b.folder("report")
    for _ in range(2):
        b.spark.sql(f"drop table if exists {name}")
        out = store.save_table(kpi.vendor_returns(b.star()), name, "overwrite", path)
    return out


add("snk_03_overwrite_report", _report, "select * from vendor_returns")


def _history(b):
    name, path = "tallyhouse_issue_history", b.folder("history")
    b.spark.sql(f"drop table if exists {name}")
    report = enrich.explained_issues(b.quarantine("customers"), b.quarantine("orders"))
    for _ in range(2):
        out = store.save_table(report, name, "append", path)
    return out.groupBy("entity").agg(rows_n().alias("row_count"), F.sum("count").alias("rows_reported"))


add(
    "snk_04_append_history",
    _history,
    "select 'customers' as entity, 2 * count(distinct issue_type) as row_count, cast(2 * count(*) as bigint) as rows_reported from quar_customers union all "
    "select 'orders', 2 * count(*), cast(2 * sum(n) as bigint) from (select count(*) as n from quar_orders group by issue_type, "
    + O.ORDER_FIELD + ", " + O.ORDER_ISSUE + ")",
)
add(
    "snk_05_replace_view",
    lambda b: store.create_view(kpi.inventory_velocity(b.star()), "tallyhouse_inventory_velocity"),
    "select * from inventory_velocity",
)


def _split(b):
    raw, good, bad = b.folder("orders_raw"), b.folder("orders_clean"), b.folder("orders_quarantine")
    store.write_files(b.raw("orders"), raw)
    streams.split_stream(streams.table_stream(b.spark, raw), "orders", good, bad, b.folder("checkpoint"))
    parts = [("clean", good), ("quarantine", bad)]
    return stack([b.spark.read.parquet(p).select("order_id", "source_region", F.lit(n).alias("side")) for n, p in parts])


_SPLIT_SQL = "select order_id, source_region, case when is_quarantined then 'quarantine' else 'clean' end as side from tag_orders"
add("snk_06_one_pass_two_tables", _split, _SPLIT_SQL)

# -- streaming ---------------------------------------------------------------------------


def _triggered(b):
    table = b.folder("ingested_vendors")
    query = ingest.ingest(b.spark, ENTITIES["vendors"], b.landed("vendors"), table, b.folder("checkpoint"))
    return ingest.raw_table(b.spark, table).agg(rows_n().alias("row_count")).withColumn("finished", F.lit(not query.isActive))


add("str_01_triggered_run", _triggered, "select count(*) as row_count, true as finished from raw_vendors")
add(
    "str_02_idempotent_rerun",
    lambda b: verify.stable_counts(*_two_runs(b, "customers")),
    "select 'customers' as entity, count(*) as rows_before, count(*) as rows_after, true as stable from raw_customers",
)


def _stateless(b):
    raw, out = b.folder("orders_raw"), b.folder("orders_valid")
    store.write_files(b.raw("orders"), raw)
    rows = cleanse.RULES["orders"].clean(standardise.orders(streams.table_stream(b.spark, raw)))
    streams.append_table(rows, out, b.folder("checkpoint"))
    return standardise.drop_lineage(b.spark.read.parquet(out))


add("str_03_stateless_chain", _stateless, f"select * exclude ({O.LINEAGE}, is_quarantined, issue_type) from tag_orders where not is_quarantined")


def _raw_batches(b, entity: str, parts: int, deal_by: list[str]):
    """The raw table as a stream of at least ``parts`` batches; rows that are equal in ``deal_by`` come close together.

    Every part is written by as many tasks as the raw table has splits, so neither a task nor a file holds a part.
    """
    raw = b.folder(f"{entity}_raw")
    part = F.pmod(F.xxhash64(*deal_by), F.lit(parts))
    for i in range(parts):
        b.raw(entity).filter(part == i).write.mode("append").parquet(raw)
    files = landing.list_files(b.spark, raw, "*.parquet").count()
    return streams.table_stream(b.spark, raw, files_per_batch=max(1, files // parts))


def _stream_clean(b, entity: str, deal_by: str):
    """Folders of the clean and the quarantine table after several batches; copies of a key come in different batches."""
    good, bad = (b.folder(f"{entity}_{n}") for n in ["clean", "quarantine"])
    streams.clean_stream(_raw_batches(b, entity, 4, [deal_by]), entity, good, bad, b.folder("checkpoint"))
    return good, bad


def _stream_dedup(b, entity: str, deal_by: str = "source_region"):
    return streams.clean_table(b.spark, _stream_clean(b, entity, deal_by)[0], entity)


add("str_04_stream_dedup", lambda b: _stream_dedup(b, "orders"), "select * from clean_orders")
add("str_04_stream_dedup_products", lambda b: _stream_dedup(b, "products", "product_name"), "select * from clean_products")
add("str_04_stream_dedup_customers", lambda b: _stream_dedup(b, "customers"), "select * from clean_customers")


def _clean_and_quarantine(b):
    good, bad = _stream_clean(b, "orders", "source_region")
    sides = [("clean", streams.clean_table(b.spark, good, "orders")), ("quarantine", b.spark.read.parquet(bad))]
    return stack([df.select("order_id", "source_region", F.lit(n).alias("side")) for n, df in sides])


add(
    "snk_06_streamed_clean_table",
    _clean_and_quarantine,
    "select order_id, source_region, 'clean' as side from clean_orders union all select order_id, source_region, 'quarantine' from tag_orders where is_quarantined",
)


def _best(b):
    out = b.folder("customers_best")
    streams.best_record_stream(_raw_batches(b, "customers", 4, ["source_region"]), out, b.folder("checkpoint"))
    return streams.best_records(b.spark, out)


add("str_05_best_record_batches", _best, "select * from clean_customers")


def _stream_static(b):
    path, out = b.folder("returns_table"), b.folder("fact_returns")
    store.write_files(b.clean("returns"), path)
    star: Star = b.star()
    facts = star.enrich_returns(streams.table_stream(b.spark, path), star.order_sales)
    streams.append_table(facts, out, b.folder("checkpoint"))
    return b.spark.read.parquet(out)


add("jon_08_stream_static_join", _stream_static, "select * from fact_returns")
add(
    "str_06_stream_static_enrichment",
    lambda b: _stream_static(b).groupBy("data_quality_flag").agg(rows_n().alias("row_count")),
    "select data_quality_flag, count(*) as row_count from fact_returns group by 1",
)


def _late(b):
    """The product files arrive after the first run and are read by the second."""
    from .landing import write_landing

    root, table, checkpoint = b.folder("late"), b.folder("ingested_late"), b.folder("checkpoint")
    write_landing(b.spark, b.sf_dir, root, ["vendors"])
    ingest.ingest(b.spark, ENTITIES["products"], root, table, checkpoint)
    write_landing(b.spark, b.sf_dir, root, ["products"])
    ingest.ingest(b.spark, ENTITIES["products"], root, table, checkpoint)
    return ingest.raw_table(b.spark, table).select("product_id", "product_name", "source_region")


add("str_07_late_files", _late, "select product_id, product_name, source_region from raw_products")


def _metrics(b):
    table = b.folder("ingested_transactions")
    ingest.ingest(b.spark, ENTITIES["transactions"], b.landed("transactions"), table, b.folder("checkpoint"))
    return ingest.load_metrics(ingest.raw_table(b.spark, table)).select("row_count", "systems", "rescued_rows", (F.col("max_lag_sec") >= 0).alias("has_lag"))


add(
    "str_08_load_metrics",
    _metrics,
    "select count(*) as row_count, count(distinct _source_file_name) as systems, count(*) filter (_rescued_data is not null and _rescued_data not like '{\"_file_path\"%') as rescued_rows, true as has_lag from raw_transactions",
)


def _progress(b):
    """The order stream in batches, with what Spark reports of each beside what the tables hold."""
    good, bad, log = b.folder("orders_good"), b.folder("orders_bad"), b.folder("progress")
    raw = _raw_batches(b, "orders", 3, ["order_id", "source_region"])
    with progress.recorded(b.spark, log):
        streams.split_stream(raw, "orders", good, bad, b.folder("checkpoint"))
    rows = b.spark.read.parquet(log)
    held = stack([b.spark.read.option("basePath", p).parquet(p).select("batch_id") for p in (good, bad)])
    report = progress.run_report(rows)
    gaps = progress.batch_gaps(rows, held).agg(rows_n().alias("gaps"))
    return report.join(F.broadcast(gaps), F.lit(True)).select("input_rows", (F.col("batches") >= 3).alias("in_batches"), (F.col("duration_ms") > 0).alias("timed"), "state_rows", "gaps")


add(
    "str_08_run_progress",
    _progress,
    "select count(*) as input_rows, true as in_batches, true as timed, 0 as state_rows, 0 as gaps from raw_orders",
)
add(
    "ver_04_idempotency_of_all_entities",
    lambda b: stack([verify.stable_counts(*_two_runs(b, e)) for e in ENTITIES]),
    " union all ".join(f"select '{e}' as entity, count(*) as rows_before, count(*) as rows_after, true as stable from raw_{e}" for e in O.ENTITIES),
)
add(
    "ver_04_idempotency",
    lambda b: verify.stable_counts(*_two_runs(b, "vendors")),
    "select 'vendors' as entity, count(*) as rows_before, count(*) as rows_after, true as stable from raw_vendors",
)
add(
    "ver_05_file_completeness",
    lambda b: inventory.completeness(inventory.source_files(b.spark, b.landing)),
    "select cast(sum(n) as bigint) as found, 16 as expected, sum(n) = 16 as complete from (" + " union all ".join(f"select count(distinct _source_file_name) as n from raw_{e}" for e in O.ENTITIES) + ")",
)

# -- text generation ---------------------------------------------------------------------


add(
    "udf_01_clean_text",
    lambda b: b.source("conversations").select("conv_id", "turn", enrich.valid_text("text").alias("clean_text")),
    "select conv_id, turn, nullif(text, '') as clean_text from conversations",
)


def _generated(b):
    def upper_case(prompts: pd.Series) -> pd.Series:
        return prompts.str.upper()

    return enrich.explained_issues(b.quarantine("customers"), b.quarantine("orders"), upper_case).select("entity", "issue_type", "count", "field", "explanation")


def _prompt_sql(kind: str, **values: str) -> str:
    out = "'" + enrich.PROMPTS[kind] + "'"
    for name, sql in values.items():
        out = out.replace("{" + name + "}", f"' || coalesce(cast({sql} as varchar), 'null') || '")
    return out


_ISSUE_PROMPT = _prompt_sql("issue", entity="entity", field="field", issue="issue_type", count="count")
add("udf_02_generated_text", _generated, f"select entity, issue_type, count, field, upper({_ISSUE_PROMPT}) as explanation from ({O.ISSUES})")


def _prompts(b):
    report = b.star()
    from ..plans import fraud

    rows = fraud.scored_customers(report)
    text = enrich.prompt("customer", customer=F.col("customer_id"), returns=F.col("total_returns"), value=enrich.dollars("total_return_value"), rules=F.col("rules_triggered"))
    return rows.select("customer_id", text.alias("prompt"))


add(
    "udf_03_prompts",
    _prompts,
    f"select customer_id, {_prompt_sql('customer', customer='customer_id', returns='total_returns', value=O.dollars('total_return_value'), rules='rules_triggered')} as prompt from scored_customers",
)


def _question_history(b):
    name, path = "tallyhouse_question_history", b.folder("questions")
    b.spark.sql(f"drop table if exists {name}")
    rows = retrieval.answers(b.documents, retrieval.questions(b.spark)).drop("question_id").withColumn("asked_at", F.current_timestamp())
    return store.save_table(rows, name, "append", path).drop("asked_at")


add("rag_06_question_history", _question_history, retrieval_sql("select question, answer, retrieved_docs from answers"))
