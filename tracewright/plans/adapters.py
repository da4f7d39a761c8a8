"""The reporting tables as views of the given tables, for Spark and as SQL for the oracle.

Expressions are written once, in the part of SQL that both engines share; ``{sec}`` stands for adding
seconds to a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AGENT = "CASE {k} % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END"
REMOTE = "CASE o_custkey % 4 WHEN 0 THEN 'git@github.com:Org/Repo' || CAST(o_custkey % 25 AS STRING) || '.git' WHEN 1 THEN 'https://GitHub.com/org/repo' || CAST(o_custkey % 25 AS STRING) || '/' WHEN 2 THEN '' END"

TABLES: dict[str, tuple[str, list[str], str]] = {
    # an order is a session
    "sessions": (
        "orders",
        [
            AGENT.format(k="o_orderkey") + " AS agent",
            "'o' || CAST(o_orderkey AS STRING) AS session_id",
            "CASE WHEN o_custkey % 11 <> 0 THEN 'proj-' || CAST(o_custkey % 20 AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN '--claude-worktrees-w' || CAST(o_orderkey % 3 AS STRING) ELSE '' END END AS project",
            "CASE WHEN o_custkey % 7 <> 0 THEN '/work/p' || CAST(o_custkey % 20 AS STRING) END AS cwd",
            "CASE WHEN o_custkey % 5 <> 0 THEN '/home/u/p' || CAST(o_custkey % 20 AS STRING) END AS cwd_raw",
            REMOTE + " AS git_remote",
            "o_orderpriority AS model",
            "o_orderdate AS start_time",
            "CASE WHEN o_orderstatus <> 'P' THEN {sec:o_orderdate:o_orderkey % 7200} END AS end_time",
            "CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey % 9 END AS turn_count",
            "o_orderkey % 13 AS tool_call_count",
            "o_orderkey % 4 AS error_count",
            "CASE WHEN o_orderkey % 5 = 3 THEN 'o' || CAST(o_orderkey - 3 AS STRING) END AS parent_session_id",
            "o_custkey AS owner",
            "CAST(floor(o_totalprice) AS BIGINT) AS source_size",
        ],
        "",
    ),
    # every second order lands a commit
    "commits": (
        "orders",
        [
            AGENT.format(k="o_orderkey") + " AS agent",
            "'o' || CAST(o_orderkey AS STRING) AS session_id",
            "CASE WHEN o_orderkey % 14 <> 0 THEN {sec:o_orderdate:3600 + o_orderkey % 600} END AS committed_at",
            REMOTE + " AS git_remote",
            "CASE WHEN o_custkey % 5 <> 0 THEN '/home/u/p' || CAST(o_custkey % 20 AS STRING) END AS cwd",
            "substring(md5(CAST(o_orderkey AS STRING)), 1, 12) AS commit_hash",
            "CASE o_orderkey % 4 WHEN 0 THEN '[tk-' || CAST(o_orderkey % 200 AS STRING) || '] fix it' WHEN 2 THEN 'work [ns/tk-' || CAST(o_orderkey % 200 AS STRING) || ']' END AS subject",
            "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 END AS files_changed",
            "o_orderpriority AS model",
            "CASE WHEN o_orderkey % 12 <> 0 THEN '1.' || CAST(o_orderkey % 3 AS STRING) END AS cli_version",
        ],
        "o_orderkey % 2 = 0",
    ),
    # a line item is a tool call of its order's session
    "tool_calls": (
        "lineitem",
        [
            AGENT.format(k="l_orderkey") + " AS agent",
            "'o' || CAST(l_orderkey AS STRING) AS session_id",
            "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS seq",
            "CASE WHEN l_linenumber <> 7 THEN l_returnflag END AS tool_kind",
            "CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS BIGINT) END AS duration_ms",
            "l_linestatus = 'F' AS is_error",
            "l_shipdate AS started_at",
            "CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens",
            "CAST(floor(l_quantity) AS BIGINT) AS output_tokens",
            "CAST(floor(l_quantity * l_discount * 100) AS BIGINT) AS cached_tokens",
            "'/src/m' || CAST(l_partkey % 50 AS STRING) || '.py' AS key_arg",
        ],
        "",
    ),
    # a failed line item is an error of its order's session
    "errors": (
        "lineitem",
        [
            AGENT.format(k="l_orderkey") + " AS agent",
            "'o' || CAST(l_orderkey AS STRING) AS session_id",
            "l_linenumber AS turn_idx",
            "CASE l_partkey % 8 WHEN 0 THEN 'api_error' WHEN 1 THEN 'tool_error' WHEN 2 THEN 'exec_error' WHEN 3 THEN 'patch_error' WHEN 4 THEN 'turn_aborted' WHEN 5 THEN 'stop_hook' WHEN 6 THEN 'quota' ELSE 'tool_error' END AS source",
        ],
        "l_linestatus = 'F'",
    ),
    # a turn of a conversation
    "turns": (
        "conversations",
        [AGENT.format(k="conv_id") + " AS agent", "'c' || CAST(conv_id AS STRING) AS session_id", "turn AS idx", "role", "text"],
        "",
    ),
    "friction": (
        "events",
        [
            "'u' || CAST(user_id AS STRING) AS session_id",
            "CASE WHEN event_id % 17 <> 0 THEN ts END AS ts",
            "CASE event_id % 3 WHEN 0 THEN 'tool.error' WHEN 1 THEN 'hook.deny' ELSE 'user.interrupt' END AS kind",
            "'cannot open /srv/' || CAST(user_id AS STRING) || '/x: pid=' || CAST(event_id AS STRING) || ' code ' || CAST(event_id % 7 AS STRING) || ' at  ' || CAST(1000 + event_id AS STRING) AS message",
        ],
        "event_type = 'error'",
    ),
    # a line item is a record of an execution of its order's run; a line number that repeats is a later record
    "records": (
        "lineitem",
        [
            "CAST(1 + CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END AS BIGINT) AS v",
            "'r' || CAST(l_orderkey AS STRING) AS run_id",
            "'r' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS execution_id",
            "CASE WHEN l_linenumber = 7 THEN 'r' || CAST(l_orderkey AS STRING) || '-7' WHEN l_linenumber > 1 THEN 'r' || CAST(l_orderkey AS STRING) || '-' || CAST(CAST(floor(l_linenumber / 2) AS INT) AS STRING) END AS parent_execution_id",
            "CASE WHEN l_linenumber = 1 THEN 'root' WHEN l_partkey % 29 = 0 THEN 'other' WHEN l_partkey % 7 = 0 THEN 'human' ELSE 'subagent' END AS execution_kind",
            "CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' END AS outcome",
            "CASE WHEN l_discount > 0.02 THEN l_linestatus END AS stage",
            "l_shipdate AS started_at",
            "CASE WHEN l_tax > 0.01 THEN {sec:l_shipdate:CAST(l_quantity AS BIGINT) - 2} END AS ended_at",
            "l_shipdate AS recorded_at",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
        ],
        "",
    ),
    # an order is an invocation in its customer's session
    "invocations": (
        "orders",
        [
            AGENT.format(k="o_custkey") + " AS agent",
            "'k' || CAST(o_custkey AS STRING) AS session_id",
            "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx",
            "o_orderdate AS started_at",
            "CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP_NTZ '2001-09-01 00:00:00' END AS session_end",
            "TIMESTAMP_NTZ '1995-01-01 00:00:00' AS session_start",
            "'tk-' || CAST(o_orderkey % 30 AS STRING) AS ticket",
            "o_orderpriority AS model",
        ],
        "",
    ),
    "tickets": (
        "part",
        [
            "CASE WHEN p_partkey % 4 = 0 THEN 'ns/' ELSE '' END || 'tk-' || CAST(p_partkey AS STRING) AS id",
            "p_name AS title",
            "CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'ready' WHEN 2 THEN 'in_progress' ELSE 'closed' END AS status",
            "p_type AS type",
            "CASE WHEN p_partkey % 9 = 1 THEN 'tk-' || CAST(p_partkey - 1 AS STRING) END AS parent",
            "p_size % 5 AS priority",
            "{sec:TIMESTAMP_NTZ '1999-01-01 00:00:00':p_partkey * 3600}  AS created",
            "CASE WHEN p_partkey % 3 <> 0 THEN {sec:TIMESTAMP_NTZ '1999-01-01 00:00:00':p_partkey * 7200} END AS updated",
            "CASE WHEN p_size % 4 = 3 THEN {sec:TIMESTAMP_NTZ '1999-01-01 00:00:00':p_partkey * 9000} END AS closed",
        ],
        "",
    ),
}


def _seconds(expression: str, spark: bool) -> str:
    out = ""
    while "{sec:" in expression:
        head, _, rest = expression.partition("{sec:")
        inner, _, expression = rest.partition("}")
        at, n = inner.rsplit(":", 1)
        out += head + (f"timestampadd(SECOND, {n}, {at})" if spark else f"({at} + to_seconds({n}))")
    return out + expression


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES; only the columns that are used are read."""
    source, columns, where = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    df = df.where(where) if where else df
    return df.selectExpr(*(_seconds(c, True) for c in columns))


def cte(*names: str) -> str:
    """``WITH`` and the named tables, for the oracle."""
    parts = []
    for name in names:
        source, columns, where = TABLES[name]
        columns = [c.replace("TIMESTAMP_NTZ", "TIMESTAMP") for c in columns]
        parts.append(f"{name} AS (SELECT {', '.join(_seconds(c, False) for c in columns)} FROM {source}{' WHERE ' + where if where else ''})")
    return "WITH " + ",\n".join(parts)
