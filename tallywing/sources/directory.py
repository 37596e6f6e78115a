"""The employee directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.model import EMPLOYEE_FIELDS, LEVEL_NUMBERS


def read_employees(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Employees from CSV files with a header row; the last row of an email wins.

    Lines are cut at every comma: rows of fewer than five fields are dropped, surplus
    fields belong to the location. ``quoted=True`` reads proper quoted CSV instead.
    Line order is (file, split offset, position in the split), so files stay splittable.
    """
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                     F.monotonically_increasing_id())
    if quoted:
        schema = ", ".join(f"{c} string" for c in EMPLOYEE_FIELDS)
        rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True).select(
            *EMPLOYEE_FIELDS, order.alias("_order"))
        rows = rows.where(F.col("location").isNotNull())
    else:
        # A separator that text does not contain: one column per line, header skipped.
        lines = spark.read.csv(path, schema="line string", sep="\x01", quote="", header=True,
                               enforceSchema=True)
        parts = F.split(F.trim(F.col("line"), F.lit(" \t\r\n")), ",")
        rows = lines.select(parts.alias("_parts"), order.alias("_order")).where(
            F.size("_parts") >= len(EMPLOYEE_FIELDS))
        last = len(EMPLOYEE_FIELDS) - 1
        rows = rows.select(
            *[F.col("_parts")[i].alias(c) for i, c in enumerate(EMPLOYEE_FIELDS[:-1])],
            F.array_join(F.slice("_parts", last + 1, F.size("_parts")), ",").alias("location"),
            "_order")
    latest = rows.groupBy("email").agg(
        F.max_by(F.struct(*EMPLOYEE_FIELDS[1:]), "_order").alias("_row")).select("email", "_row.*")
    numbers = F.create_map(*[F.lit(x) for pair in LEVEL_NUMBERS.items() for x in pair])
    return latest.withColumn(
        "level_num", F.coalesce(F.try_element_at(numbers, F.col("level")), F.lit(0)))
