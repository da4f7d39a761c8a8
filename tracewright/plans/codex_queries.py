"""Queries of agent B's result events, parents and child sessions: line items are its calls and end events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.tables import dealt
from tracewright.operators import codex as c
from tracewright.plans.registry import query

FIRST = "l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax"
#: One line item for each order and number; even ones are calls, those below 6 have an end event.
BASE = f"SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS p, CASE min(l_partkey) % 3 WHEN 0 THEN 'exec' WHEN 1 THEN 'patch' ELSE 'mcp' END AS kind FROM {{t}} GROUP BY l_orderkey, l_linenumber"


def base(spark, sf):
    """Makes the view of the base; returns the number of line items, which it doesn't exceed."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.count()
    dealt(lines, rows, "l_orderkey", "l_linenumber").createOrReplaceTempView("codex_lines")
    spark.sql(BASE.format(t="codex_lines")).createOrReplaceTempView("codex_base")
    return rows


def calls(spark):
    return spark.sql("SELECT 'codex-cli' AS agent, 's' || o AS session_id, k * 10 AS line_no, k AS turn, 'c' || k AS call_id, CASE WHEN p % 2 = 0 THEN 'function' ELSE 'grep' END AS tool_kind, CASE WHEN p % 5 = 0 THEN 'shell' ELSE 'tool' END AS tool_name, 'arg ' || k AS key_arg, to_json(map('path', '/f' || p % 7)) AS arguments FROM codex_base WHERE k % 2 = 0")


def ends(spark):
    return spark.sql("""SELECT 'codex-cli' AS agent, 's' || o AS session_id, k * 10 + 5 AS line_no, k AS turn, kind, 'c' || k AS call_id, CASE WHEN kind = 'exec' THEN CAST(p % 4 AS INT) END AS exit_code, p % 5 <> 0 AS success, 'out ' || p AS stdout, CASE WHEN p % 2 = 0 THEN 'err' ELSE '' END AS stderr,
    CASE p % 4 WHEN 0 THEN '{"secs":' || k || ',"nanos":5000000}' WHEN 1 THEN '1.5' WHEN 2 THEN '"x"' END AS duration, 'result ' || p AS result, 'cmd ' || k AS command, timestampadd(SECOND, CAST(k AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts,
    to_json(map('/a' || p % 5, named_struct('type', CASE p % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'move' END))) AS changes FROM codex_base WHERE k < 6""")


B = f"b AS ({BASE.format(t='lineitem')}), e AS (SELECT *, 'out ' || CAST(p AS VARCHAR) AS stdout, CASE WHEN p % 2 = 0 THEN 'err' ELSE '' END AS stderr, p % 5 <> 0 AS success, p % 4 AS code FROM b WHERE k < 6)"
JOINED = "'exit=' || CAST(code AS VARCHAR) || chr(10) || 'stdout: ' || CASE WHEN length(stdout) > 400 THEN left(stdout, 400) || '…' ELSE stdout END || CASE WHEN stderr <> '' THEN chr(10) || 'stderr: ' || stderr ELSE '' END"


@query("b14_codex_exec_results", f"""WITH {B}, j AS (SELECT b.o, b.k, b.p, b.k % 2 = 0 AS called, e.kind AS kind, stdout, stderr, success, code FROM b LEFT JOIN e ON b.o = e.o AND b.k = e.k WHERE b.k % 2 = 0 OR b.k < 6)
SELECT 's' || CAST(o AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN called THEN k * 10 ELSE k * 10 + 5 END) - 1 AS seq, 'c' || CAST(k AS VARCHAR) AS call_id,
 CASE WHEN kind = 'exec' THEN CASE WHEN called AND p % 2 <> 0 THEN 'grep' ELSE 'bash' END WHEN kind = 'patch' THEN 'patch_apply' WHEN kind = 'mcp' THEN 'mcp' WHEN p % 2 = 0 THEN 'function' ELSE 'grep' END AS tool_kind,
 CASE WHEN called THEN CASE WHEN p % 5 = 0 THEN 'shell' ELSE 'tool' END WHEN kind = 'exec' THEN 'shell' WHEN kind = 'patch' THEN 'apply_patch' ELSE 'mcp' END AS tool_name,
 CASE WHEN called THEN 'arg ' || CAST(k AS VARCHAR) WHEN kind = 'exec' THEN 'cmd ' || CAST(k AS VARCHAR) END AS key_arg,
 CASE WHEN kind = 'exec' THEN code END::INT AS exit_code, coalesce(CASE kind WHEN 'exec' THEN code <> 0 WHEN 'patch' THEN NOT success END, false) AS is_error,
 CASE WHEN kind IN ('exec', 'mcp') THEN CASE p % 4 WHEN 0 THEN k * 1000 + 5 WHEN 1 THEN 1500 ELSE 0 END END::BIGINT AS duration_ms,
 CASE kind WHEN 'exec' THEN {JOINED} WHEN 'patch' THEN CASE WHEN success THEN stdout ELSE stderr END WHEN 'mcp' THEN 'result ' || CAST(p AS VARCHAR) END AS result_summary FROM j""")
def b14(spark, sf):
    base(spark, sf)
    return c.with_results(calls(spark).drop("arguments"), ends(spark).drop("changes")).drop("agent", "turn")


@query("b7_codex_errors", f"""WITH {B}, x AS (SELECT o, k * 10 + 5 AS line_no, kind || '_error' AS source, CASE kind WHEN 'exec' THEN {JOINED} ELSE stderr END AS message FROM e WHERE (kind = 'exec' AND code <> 0) OR (kind = 'patch' AND NOT success)
 UNION ALL SELECT o, k * 10 + 7, CASE p % 3 WHEN 0 THEN 'turn_aborted' WHEN 1 THEN 'stop_hook' ELSE 'api_error' END, 'why ' || CAST(p AS VARCHAR) FROM b WHERE k >= 6)
SELECT 's' || CAST(o AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY o ORDER BY line_no, source) - 1 AS seq, source, message FROM x""")
def b7(spark, sf):
    base(spark, sf)
    told = spark.sql("SELECT 'codex-cli' AS agent, 's' || o AS session_id, k * 10 + 7 AS line_no, k AS turn, CASE p % 3 WHEN 0 THEN 'turn_aborted' WHEN 1 THEN 'stop_hook' ELSE 'api_error' END AS source, 'why ' || p AS message FROM codex_base WHERE k >= 6")
    return c.errors(ends(spark), told.where("source = 'turn_aborted'"), told.where("source <> 'turn_aborted'")).select("session_id", "seq", "source", "message")


@query("b9_codex_files", f"""WITH {B} SELECT session_id, path, op, count(*) AS count FROM (SELECT 's' || CAST(o AS VARCHAR) AS session_id, '/a' || CAST(p % 5 AS VARCHAR) AS path, CASE p % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'edit' WHEN 2 THEN 'delete' ELSE 'patch' END AS op FROM e WHERE kind = 'patch'
 UNION ALL SELECT 's' || CAST(o AS VARCHAR), '/f' || CAST(p % 7 AS VARCHAR), CASE WHEN p % 5 = 0 THEN 'exec' ELSE 'edit' END FROM b WHERE k % 2 = 0) GROUP BY ALL""")
def b9(spark, sf):
    rows = base(spark, sf)
    return c.files_touched(calls(spark), ends(spark), rows).drop("agent")


@query("b17_fold_parent_spawn", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'p' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'g' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN 'g' || CAST(o_orderkey AS VARCHAR) END AS parent, CASE o_orderkey % 4 WHEN 0 THEN greatest(o_orderkey % 3, 1) WHEN 1 THEN 1 WHEN 2 THEN 1 END::INT AS depth FROM orders")
def b17(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", """CASE o_orderkey % 4 WHEN 0 THEN '{"subagent":{"thread_spawn":{"parent_thread_id":"p' || o_orderkey || '","depth":' || o_orderkey % 3 || '}}}' WHEN 1 THEN '"cli"' WHEN 2 THEN '{"subagent":"guardian"}' END AS source""", "CASE WHEN o_orderkey % 4 < 3 THEN 'g' || o_orderkey ELSE '' END AS thread")
    parent, depth = c.parent_spawn(F.col("source"), F.col("thread"))
    return rows.select("o_orderkey", parent.alias("parent"), depth.alias("depth"))


@query("b16_child_sessions", "SELECT 'a' || CAST(conv_id AS VARCHAR) AS session_id, 'c' || CAST(conv_id % 10 AS VARCHAR) AS parent_session_id, 't' || CAST(conv_id AS VARCHAR) AS parent_tool_call_id, TIMESTAMP '2024-01-01' + to_seconds(min(turn)) AS start_time, TIMESTAMP '2024-01-01' + to_seconds(max(turn)) AS end_time, count(*) FILTER (role = 'user') AS turn_count, sum(CASE WHEN role = 'assistant' THEN length(text) END)::BIGINT AS input_tokens, 1 AS spawn_depth FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def b16(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("'claude-code' AS agent", "'c' || conv_id % 10 AS parent_session_id", "CASE WHEN conv_id % 3 <> 0 THEN 'a' || conv_id END AS child_session_id", "'t' || conv_id AS tool_use_id", "turn AS line_no", "timestampadd(SECOND, CAST(turn AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts", "role", "CASE WHEN role = 'assistant' THEN length(text) END AS input_tokens", "0 AS output_tokens")
    return c.child_sessions(rows).drop("agent", "output_tokens")


@query("c16_search_tool_output", "WITH c AS (SELECT l_orderkey AS o, l_linenumber AS k, l_shipdate AS started_at, l_partkey AS p FROM lineitem) SELECT 's' || CAST(o AS VARCHAR) AS session_id, k AS seq, started_at, CASE WHEN o % 2 = 0 THEN 'tk-' || CAST(o % 9 AS VARCHAR) END AS ticket FROM c WHERE started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1998-01-01' AND p % 3 = 0 AND p % 7 = 1")
def c16(spark, sf):
    calls_ = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("'a' AS agent", "'s' || l_orderkey AS session_id", "l_linenumber AS seq", "l_shipdate AS started_at", "CASE WHEN l_partkey % 3 = 0 THEN 'go test ./x' ELSE 'ls' END AS key_arg", "'head' || chr(10) || 'exit ' || l_partkey % 7 || '.' AS output")
    tickets = calls_.select("agent", "session_id", F.col("started_at").alias("at")).distinct().withColumn("o", F.regexp_extract("session_id", "[0-9]+", 0).cast("long"))
    tickets = tickets.where("o % 2 = 0").selectExpr("agent", "session_id", "at", "'tk-' || o % 9 AS ticket")
    at = lambda x: F.expr(f"TIMESTAMP_NTZ '{x} 00:00:00'")
    return c.search_output(calls_, "go test", r"exit 1\.", at("1996-01-01"), at("1998-01-01"), tickets).select("session_id", "seq", "started_at", "ticket")
