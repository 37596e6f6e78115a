"""API error analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import pct
from tallywing.model import Warehouse
from tallywing.operators.common import scalar
from tallywing.session import materialize


def error_summary(wh: Warehouse) -> DataFrame:
    """Errors per message and status with their share of all errors.

    Messages are free text, so the grouped result may be large and is not sent through an
    unpartitioned window: it is stored, and the total is a scalar subquery over it.
    """
    grouped = materialize(wh.api_errors.groupBy("error_msg", "status_code").agg(
        F.count(F.lit(1)).alias("count")), "errors")
    all_errors = scalar(grouped, F.sum("count"))
    return (grouped.withColumn("pct", pct(F.col("count"), all_errors))
            .orderBy(F.desc("count"), "error_msg", "status_code"))


def error_trend(wh: Warehouse) -> DataFrame:
    return (wh.api_errors.groupBy(F.to_date("timestamp").alias("date"), "status_code")
            .agg(F.count(F.lit(1)).alias("errors"))
            .select("date", "errors", "status_code").orderBy("date", "status_code"))


def error_by_model(wh: Warehouse) -> DataFrame:
    """Errors per named model with its distinct status codes, sorted and comma-separated."""
    per_code = wh.api_errors.where(F.col("model") != "").groupBy("model", "status_code").agg(
        F.count(F.lit(1)).alias("n"))
    codes = F.array_join(F.array_sort(F.collect_set("status_code")), ",")
    return (per_code.groupBy("model").agg(F.sum("n").alias("errors"), codes.alias("codes"))
            .orderBy(F.desc("errors"), "model"))
