"""Return-fraud scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import exact_avg, exact_sum, number
from ..operators.dedup import group_sizes
from ..operators.ranking import flagged_or_top
from .star import Star

NUMERIC = ["return_amount", "transaction_amount", "return_to_purchase_ratio", "days_to_return"]


def numeric_returns(facts: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """The listed columns as doubles; text such as 'null' becomes NULL."""
    return facts.withColumns({c: number(c) for c in columns})


def customer_profile(star: Star, grain: str = "per_return") -> DataFrame:
    """Return behaviour per customer, the unknown member included."""
    facts = numeric_returns(star.fact_returns(grain))
    by_key = facts.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("total_returns"),
        exact_sum("return_amount").alias("total_return_value"),
        exact_avg("return_to_purchase_ratio", 6).alias("avg_return_ratio"),
        F.coalesce(F.max(F.col("suspicious_ratio_flag").cast("int")), F.lit(0)).alias("has_suspicious"),
        F.coalesce(F.max(F.col("quick_return_flag").cast("int")), F.lit(0)).alias("has_quick_return"),
    )
    who = star.dim_customer.select(
        "customer_key", "customer_id", "customer_name", "region", F.col("customer_segment").alias("segment")
    )
    return by_key.join(who, "customer_key")


def score(profile: DataFrame) -> DataFrame:
    """Adds anomaly_score, rules_triggered and flagged."""
    fires = [
        F.col("total_returns") > vocab.FRAUD_RETURNS_OVER,
        F.col("total_return_value") > vocab.FRAUD_VALUE_OVER,
        F.col("avg_return_ratio") > vocab.FRAUD_RATIO_OVER,
        F.col("has_suspicious") > 0,
        F.col("has_quick_return") > 0,
    ]
    rules = list(zip(vocab.FRAUD_RULES, fires))
    points = reduce(lambda a, b: a + b, [F.when(hit, p).otherwise(0) for (_, p), hit in rules])
    names = F.concat_ws(",", *[F.when(hit, n) for (n, _), hit in rules])
    scored = profile.withColumns({"anomaly_score": points, "rules_triggered": names})
    return scored.withColumn("flagged", F.col("anomaly_score") >= vocab.FRAUD_FLAG_AT)


def scored_customers(star: Star) -> DataFrame:
    return score(customer_profile(star)).filter(F.col("customer_key") != vocab.UNKNOWN_KEY)



def suspects(star: Star, k: int = 3) -> DataFrame:
    """Flagged customers; the ``k`` best scores only if nobody is flagged."""
    return flagged_or_top(scored_customers(star), "flagged", [F.desc("anomaly_score"), F.asc("customer_id")], k)


def top_suspects(star: Star, k: int = 3) -> DataFrame:
    return scored_customers(star).orderBy(F.desc("anomaly_score"), F.asc("customer_id")).limit(k)


def repeated_returns(raw_returns: DataFrame) -> DataFrame:
    """Orders returned more than once, with the regional systems that reported them."""
    system = F.regexp_extract("_source_file_name", r"^([^.-]+)", 1)
    sizes = group_sizes(
        raw_returns,
        F.coalesce("order_id", "OrderId"),
        {"systems": F.array_join(F.array_sort(F.collect_set(system)), ",")},
    )
    return sizes.filter("copies > 1").select(F.col("key").alias("order_id"), F.col("copies").alias("return_count"), "systems")
