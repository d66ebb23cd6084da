"""Texts on top of grouped rows: prompts as columns, and a pluggable text generator.

No text service is called here. Without a generator the text is a template
column; a generator is any function from a series of prompts to texts and runs
on the executors, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dollars, fill, valid_text
from . import fraud, kpi, quality
from .star import Star

Generator = Callable[[pd.Series], pd.Series]

PROMPTS = {
    "issue": (
        "Explain a data quality finding to a finance reader in one paragraph of four to six sentences. "
        "Entity: {entity}. Field: {field}. Issue: {issue}. Rejected rows: {count}. Say what was wrong, why such rows "
        "must stay out of joins and aggregates, and which report or decision is at risk. Invent no figures."
    ),
    "customer": (
        "Explain in three to five sentences why this customer was flagged for returns. Customer: {customer}. "
        "Returns: {returns}. Value: {value}. Rules: {rules}. Name the triggers and the risk; assume no causes and "
        "propose no next steps."
    ),
    "answer": (
        "Answer only from the documents, with exact values and in rank order; if they do not hold the answer, say that "
        "the data is not available. Documents: {docs} Question: {question}"
    ),
    "insight": (
        "Write four to five plain sentences for an executive dashboard. Domain: {domain}. Figures: {figures}. Cover "
        "what they show, which part of the business they concern and what risk follows. Use only these figures."
    ),
}


def prompt(kind: str, **values: Column) -> Column:
    return fill(PROMPTS[kind], **values)


def with_text(df: DataFrame, name: str, prompt_column: Column, template: Column, generate: Generator | None = None) -> DataFrame:
    """Adds a text column, from ``generate(prompts)`` or else from ``template``."""
    if generate is None:
        return df.withColumn(name, template)
    asked = df.withColumn("_prompt", prompt_column)
    schema = df.schema.add(name, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = generate(pdf["_prompt"])
            yield pdf.drop(columns="_prompt").assign(**{name: text})

    return asked.mapInPandas(run, schema).withColumn(name, valid_text(name))


def explained_issues(bad_customers: DataFrame, bad_orders: DataFrame, generate: Generator | None = None) -> DataFrame:
    report = quality.issue_report(bad_customers, bad_orders)
    asked = prompt("issue", entity=F.col("entity"), field=F.col("field"), issue=F.col("issue_type"), count=F.col("count"))
    told = fill(
        "{count} {entity} rows were rejected because of {issue}; the field concerned is {field}.",
        count=F.col("count"), entity=F.col("entity"), issue=F.col("issue_type"), field=F.col("field"),
    )
    return with_text(report, "explanation", asked, told, generate).withColumn("generated_at", F.current_timestamp())


def investigations(star: Star, generate: Generator | None = None) -> DataFrame:
    rows = fraud.suspects(star).select(
        "customer_id", "customer_name", "region", "segment", F.col("total_returns").cast("int").alias("total_returns"),
        "total_return_value", "anomaly_score", "rules_triggered",
    )
    values = {
        "customer": F.col("customer_id"),
        "returns": F.col("total_returns"),
        "value": dollars("total_return_value"),
        "rules": F.col("rules_triggered"),
    }
    told = fill(
        "Customer {customer} returned {returns} times for {value} in total and reached {points} points through {rules}.",
        points=F.col("anomaly_score"), **values,
    )
    return with_text(rows, "investigation", prompt("customer", **values), told, generate).withColumn(
        "generated_at", F.current_timestamp()
    )


def business_insights(star: Star, generate: Generator | None = None) -> DataFrame:
    """(insight_type, kpi_data, summary, generated_at)."""
    rows = kpi.insight_rows(star)
    values = {"domain": F.replace("insight_type", F.lit("_"), F.lit(" ")), "figures": F.col("kpi_data")}
    told = fill("The figures for {domain} are {figures}.", **values)
    return with_text(rows, "summary", prompt("insight", **values), told, generate).withColumn(
        "generated_at", F.current_timestamp()
    )
