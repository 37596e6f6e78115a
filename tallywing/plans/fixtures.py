"""The six tables derived from the given parquet files, as SQL both engines run.

Every row of ``events`` and ``customer`` takes part. The text is a chain of CTEs: Spark
builds the Warehouse from it, and each oracle query starts with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tallywing.model import TABLES
from tallywing.operators.sessions import build_sessions

# Weeks are stretched per user (each week, every second, every third) and shifted by up
# to three weeks, which gives staggered cohorts, inactive weeks and a season of days.
_CTES = {
    "ev": """
        SELECT event_id, user_id, event_type, value,
               CAST(date_trunc('millisecond', ts) AS {ntz})
                 + (user_id % 4 + CAST(floor((extract(day FROM ts) - 1) / 7) AS int)
                    * (user_id % 3)) * INTERVAL '7' DAY AS ts
        FROM {events}""",
    "base": """
        SELECT event_id, event_type, value, ts,
               concat('s', CAST(user_id AS string), '-',
                      CAST(CAST(ts AS date) AS string)) AS session_id,
               concat('user', CAST(user_id AS string), '@example.com') AS user_email
        FROM {ev}""",
    # Customers in arrears are missing from the directory, so their users are orphans.
    "employees": """
        SELECT concat('user', CAST(c.c_custkey AS string), '@example.com') AS email,
               c.c_name AS full_name, c.c_mktsegment AS practice,
               concat('L', CAST(1 + c.c_custkey % 10 AS string)) AS level,
               r.r_name AS location, CAST(1 + c.c_custkey % 10 AS int) AS level_num
        FROM {customer} c
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        JOIN {region} r ON r.r_regionkey = n.n_regionkey
        WHERE c.c_acctbal >= 0""",
    # Some prompts come from a shared address: two emails in one session.
    "user_prompts": """
        SELECT event_id AS id, session_id,
               CASE WHEN event_id % 997 = 0 THEN 'zz-shared@example.com'
                    ELSE user_email END AS user_email,
               ts AS "timestamp", CAST(1 + event_id * 131 % 4000 AS bigint) AS prompt_length
        FROM {base} WHERE event_type <> 'error'""",
    "request_rows": """
        SELECT event_id AS id, session_id, user_email, ts + INTERVAL '2' SECOND AS "timestamp",
               concat('model-', CAST(event_id % 5 AS string)) AS model,
               event_id * 37 % 900 AS input_tokens,
               event_id * 53 % 500 AS output_tokens,
               event_id * 7919 % 70000 AS cache_read_tokens,
               event_id * 31 % 5000 AS cache_creation_tokens,
               CAST(value AS decimal(18,6)) AS cost_usd,
               100 + event_id * 97 % 12000 AS duration_ms
        FROM {base} WHERE event_type <> 'signup'""",
    # Expensive requests are logged twice.
    "request_log": """
        SELECT * FROM {request_rows}
        UNION ALL
        SELECT id + 1000000000, session_id, user_email, "timestamp", model, input_tokens,
               output_tokens, cache_read_tokens, cache_creation_tokens, cost_usd, duration_ms
        FROM {request_rows} WHERE cost_usd > 200""",
    "api_requests": """
        SELECT id, session_id, user_email, "timestamp", model, input_tokens, output_tokens,
               cache_read_tokens, cache_creation_tokens,
               input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens
                 AS total_tokens,
               cost_usd, duration_ms
        FROM {request_log}""",
    "tool_decisions": """
        SELECT 2 * event_id AS id, session_id, user_email,
               ts + INTERVAL '9' SECOND AS "timestamp", 'decision' AS event_type,
               concat('tool-', CAST(event_id % 17 AS string)) AS tool_name,
               CASE WHEN event_id % 10 = 0 THEN 'reject' ELSE 'accept' END AS decision,
               CASE WHEN event_id % 10 = 0 THEN 'user_reject'
                    WHEN event_id % 7 = 0 THEN 'user_temporary' ELSE 'config' END AS source,
               CAST(NULL AS int) AS success, CAST(0 AS bigint) AS duration_ms,
               CAST(NULL AS bigint) AS result_size_bytes
        FROM {base} WHERE event_type IN ('click', 'purchase', 'view')""",
    "tool_events": """
        SELECT * FROM {tool_decisions}
        UNION ALL
        SELECT id + 1, session_id, user_email, "timestamp" + INTERVAL '2' SECOND, 'result',
               tool_name, decision, source,
               CAST(CASE WHEN (id // 2) % 13 = 0 THEN 0 ELSE 1 END AS int),
               (id // 2) * 61 % 9000,
               CASE WHEN (id // 2) % 3 = 0 THEN (id // 2) * 17 % 50000 END
        FROM {tool_decisions} WHERE decision = 'accept'""",
    "api_errors": """
        SELECT event_id AS id, session_id, user_email, ts + INTERVAL '5' SECOND AS "timestamp",
               concat('error ', CAST(event_id % 8 AS string)) AS error_msg,
               CASE event_id % 4 WHEN 0 THEN '429' WHEN 1 THEN '500' WHEN 2 THEN '400'
                    ELSE 'undefined' END AS status_code,
               CASE WHEN event_id % 19 = 0 THEN ''
                    ELSE concat('model-', CAST(event_id % 5 AS string)) END AS model,
               1 + event_id % 3 AS attempt, 50 + event_id * 13 % 2000 AS duration_ms
        FROM {base} WHERE event_type = 'error'""",
}

# For the oracle only: Spark builds sessions with the operator under test.
# One row per fact with what it adds to a session, folded per user of the session first.
_SESSIONS = """
        SELECT session_id, max(user_email) AS user_email,
               arg_max(opened, user_email) AS start_time, arg_max(closed, user_email) AS end_time,
               ((epoch_ms(arg_max(closed, user_email)) - epoch_ms(arg_max(opened, user_email))) * 100
                 + 30000) // 60000 / 100.0::double AS duration_min,
               CAST(sum(turns) AS bigint) AS num_turns, CAST(sum(calls) AS bigint) AS num_api_calls,
               CAST(sum(tools) AS bigint) AS num_tool_calls, sum(spent) AS total_cost_usd,
               CAST(sum(used) AS bigint) AS total_tokens
        FROM (SELECT session_id, user_email, min(seen) AS opened, max(seen) AS closed,
                     sum(turn) AS turns, sum(call) AS calls, sum(tool) AS tools,
                     sum(cost) AS spent, sum(tokens) AS used
              FROM (SELECT session_id, user_email, "timestamp" AS seen, 0 AS turn, 1 AS call,
                           0 AS tool, cost_usd AS cost, total_tokens AS tokens FROM api_requests
                    UNION ALL
                    SELECT session_id, user_email, "timestamp", 1, 0, 0, 0, 0 FROM user_prompts
                    UNION ALL
                    SELECT session_id, user_email, "timestamp", 0, 0,
                           (event_type = 'decision')::int, 0, 0 FROM tool_events) facts
              GROUP BY session_id, user_email) folded
        GROUP BY session_id"""

SOURCES = ["events", "customer", "nation", "region"]
_REFERENCE = re.compile(r"\{(\w+)\}")


def oracle(body: str) -> str:
    """``body`` behind the fixture CTEs, for DuckDB."""
    places = {"ntz": "timestamp"}
    ctes = [f"{name} AS ({_REFERENCE.sub(lambda m: places.get(m[1], m[1]), text)})"
            for name, text in {**_CTES, "sessions": _SESSIONS}.items()]
    head, text = "WITH " + ",\n".join(ctes), body.strip()
    # A body may bring CTEs of its own.
    return f"{head},\n{text[5:]}" if text.upper().startswith("WITH ") else f"{head}\n{text}"


class DerivedWarehouse:
    """A Warehouse whose tables are derived from the given files when first asked for.

    ``replace`` puts other frames, such as streams, in the place of given tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, **replace: DataFrame) -> None:
        self._spark, self._dir, self._known = spark, sf_dir, dict(replace)

    def _frame(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._build(name)
        return self._known[name]

    def _build(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name == "sessions":
            return build_sessions(self.api_requests, self.user_prompts, self.tool_events)
        text = _CTES[name].replace("{ntz}", "timestamp_ntz").replace(
            '"timestamp"', "`timestamp`").replace("(id // 2)", "(id div 2)")
        return self._spark.sql(text, **{n: self._frame(n) for n in _REFERENCE.findall(text)})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self._frame(name)

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, self._frame(name)) for name in TABLES)
