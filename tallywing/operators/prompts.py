"""Prompt analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import ratio, rounded
from tallywing.model import Warehouse
from tallywing.operators.common import with_employee
from tallywing.operators.ranking import quantiles


def prompt_length_distribution(wh: Warehouse) -> DataFrame:
    return wh.user_prompts.where(F.col("prompt_length") > 0).select(
        "prompt_length", "user_email", "timestamp")


def prompt_lengths_by_practice(wh: Warehouse, low: int = 1, high: int = 10000) -> DataFrame:
    rows = wh.user_prompts.where(F.col("prompt_length").between(low, high)).select(
        "user_email", "prompt_length")
    return with_employee(rows, wh, "practice").select("practice", "prompt_length")


def prompt_stats_by_practice(wh: Warehouse) -> DataFrame:
    """Count, mean, range and true median of prompt lengths per practice."""
    per_user = wh.user_prompts.groupBy("user_email", "prompt_length").agg(
        F.count(F.lit(1)).alias("prompts"))
    lengths = with_employee(per_user, wh, "practice").groupBy("practice", "prompt_length").agg(
        F.sum("prompts").alias("prompts"))
    weighted = F.col("prompt_length") * F.col("prompts")
    known = F.when(F.col("prompt_length").isNotNull(), F.col("prompts"))
    stats = lengths.groupBy("practice").agg(
        F.sum("prompts").alias("prompts"),
        rounded(ratio(F.sum(weighted), F.sum(known)), 0).alias("avg_length"),
        F.min("prompt_length").alias("min_length"),
        F.max("prompt_length").alias("max_length"))
    median = quantiles(lengths, "prompt_length", {"median_length": 0.5}, ["practice"],
                       weight="prompts")
    return stats.join(median, "practice", "left").orderBy(F.desc("avg_length"), "practice")
