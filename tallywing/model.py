"""Schemas of the raw and warehouse layers, and the table bundle operators take."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: must equal what log files and employee directories contain ---
EVENT_KINDS = {
    "claude_code.api_request": "api_request",
    "claude_code.tool_decision": "tool_decision",
    "claude_code.tool_result": "tool_result",
    "claude_code.user_prompt": "user_prompt",
    "claude_code.api_error": "api_error",
}
LEVEL_NUMBERS = {f"L{n}": n for n in range(1, 11)}
EMPLOYEE_FIELDS = ["email", "full_name", "practice", "level", "location"]
SEGMENT_LABELS = ["Power Users", "Active Users", "Moderate Users", "Light Users"]
# --- end of fixed values ---

UNKNOWN_KIND = "unknown"

CORRUPT = "_corrupt_record"

ENVELOPE = T.StructType([
    T.StructField("messageType", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("logGroup", T.StringType()),
    T.StructField("logStream", T.StringType()),
    T.StructField("subscriptionFilters", T.ArrayType(T.StringType())),
    T.StructField("logEvents", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("message", T.StringType()),
    ]))),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

# Attribute names contain dots, so both bags are maps and not structs.
MESSAGE = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("scope", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
    ])),
    T.StructField("resource", T.MapType(T.StringType(), T.StringType())),
])


@dataclass(frozen=True)
class Warehouse:
    """The six tables every operator reads."""

    employees: DataFrame
    sessions: DataFrame
    api_requests: DataFrame
    tool_events: DataFrame
    user_prompts: DataFrame
    api_errors: DataFrame

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((f.name, getattr(self, f.name)) for f in fields(self))


TABLES = [f.name for f in fields(Warehouse)]
