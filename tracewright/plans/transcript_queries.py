"""Queries of transcript folding: conversations are written as raw transcript lines and folded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import transcripts as t
from tracewright.plans.adapters import cte, table
from tracewright.plans.registry import query

MODELS = "CASE {turn} % 4 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' WHEN 2 THEN '<synthetic>' ELSE 'm-large' END"
TOOLS = "CASE ({conv} + {turn}) % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'mcp__x' WHEN 3 THEN 'Edit' ELSE 'WebSearch' END"
RAW = f"""
WITH c AS (SELECT conv_id AS conv, turn, role, text, 'claude-code' AS agent, 'c' || conv_id AS session_id, date_format(timestampadd(SECOND, CAST(turn * 60 AS INT), TIMESTAMP '2024-01-01 00:00:00'), "yyyy-MM-dd'T'HH:mm:ss'Z'") AS ts, date_format(timestampadd(SECOND, CAST(turn * 60 + 1 + turn % 7 AS INT), TIMESTAMP '2024-01-01 00:00:00'), "yyyy-MM-dd'T'HH:mm:ss'Z'") AS ts2 FROM raw_conversations)
SELECT agent, session_id, turn * 4 AS line_no, to_json(named_struct('type', 'user', 'timestamp', ts, 'cwd', '/w/' || conv, 'version', CASE WHEN turn > 1 THEN '1.' || turn END, 'promptId', 'p' || turn, 'message', named_struct('role', 'user', 'content', text))) AS value FROM c WHERE role = 'user'
UNION ALL
SELECT agent, session_id, turn * 4, to_json(named_struct('type', 'assistant', 'timestamp', ts, 'message', named_struct('id', 'm' || conv || '-' || turn, 'model', {MODELS.format(turn='turn')}, 'usage', named_struct('input_tokens', 100 + turn, 'output_tokens', length(text), 'cache_read_input_tokens', CASE WHEN turn % 3 = 0 THEN 7 END, 'speed', 'standard'), 'content', array(named_struct('type', 'text', 'text', text))))) FROM c WHERE role = 'assistant'
UNION ALL
SELECT agent, session_id, turn * 4 + 1, to_json(named_struct('type', 'assistant', 'timestamp', ts, 'message', named_struct('id', 'm' || conv || '-' || turn, 'model', {MODELS.format(turn='turn')}, 'usage', named_struct('input_tokens', 200 + turn, 'output_tokens', 5 + length(text), 'cache_read_input_tokens', CASE WHEN turn % 3 = 0 THEN 7 END, 'speed', 'standard'), 'content', array(named_struct('type', 'tool_use', 'id', 't' || turn, 'name', {TOOLS.format(conv='conv', turn='turn')}, 'input', map('command', 'run ' || turn, 'file_path', '/src/f' || (turn % 3) || '.py', 'query', 'find ' || conv)))))) FROM c WHERE role = 'assistant'
UNION ALL
SELECT agent, session_id, turn * 4 + 2, to_json(named_struct('type', 'user', 'timestamp', ts2, 'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'tool_use_id', 't' || turn, 'content', 'out ' || turn, 'is_error', turn % 3 = 1))))) FROM c WHERE role = 'assistant' AND turn % 5 <> 4
UNION ALL
SELECT agent, session_id, turn * 4, to_json(named_struct('type', 'system', 'timestamp', ts, 'subtype', 'compact_boundary', 'uuid', 'x' || conv, 'logicalParentUuid', 'u' || conv)) FROM c WHERE role = 'system'
UNION ALL
SELECT agent, session_id, turn * 4 + 3, CASE conv % 3 WHEN 0 THEN '{{"type": "broken' WHEN 1 THEN to_json(named_struct('type', 'user', 'isSidechain', 'yes', 'timestamp', ts)) ELSE to_json(named_struct('type', 'mystery', 'subtype', 'x', 'timestamp', ts)) END FROM c WHERE turn = 0
"""


def routed(spark, sf):
    spark.read.parquet(f"{sf}/conversations.parquet").createOrReplaceTempView("raw_conversations")
    return t.route(spark.sql(RAW))


#: What the folds must give, straight from the conversations.
C = f"""WITH c AS (SELECT conv_id AS conv, turn, role, text, 'claude-code' AS agent, 'c' || CAST(conv_id AS VARCHAR) AS session_id, TIMESTAMP '2024-01-01' + to_seconds(turn * 60) AS ts, TIMESTAMP '2024-01-01' + to_seconds(turn * 60 + 1 + turn % 7) AS ts2 FROM conversations),
o AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY turn) AS users FROM c),
p AS (SELECT *, (role = 'user' OR (role = 'assistant' AND users = 0 AND row_number() OVER (PARTITION BY conv, role, users ORDER BY turn) = 1)) AS opens FROM o),
q AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY turn) - 1 AS t FROM p)"""
CALLS = f"""k AS (SELECT agent, session_id, t AS turn, row_number() OVER (PARTITION BY conv ORDER BY turn) - 1 AS seq, 't' || CAST(turn AS VARCHAR) AS call_id, {TOOLS.format(conv='conv', turn='turn')} AS tool_name, turn AS raw, conv, ts, ts2 FROM q WHERE role = 'assistant'),
calls AS (SELECT agent, session_id, turn, seq, call_id, tool_name, CASE tool_name WHEN 'Bash' THEN 'bash' WHEN 'Read' THEN 'read' WHEN 'mcp__x' THEN 'mcp' WHEN 'Edit' THEN 'edit' ELSE 'web_search' END AS tool_kind, CASE tool_name WHEN 'Bash' THEN 'run ' || CAST(raw AS VARCHAR) WHEN 'WebSearch' THEN 'find ' || CAST(conv AS VARCHAR) ELSE '/src/f' || CAST(raw % 3 AS VARCHAR) || '.py' END AS key_arg, ts AS started_at, CASE WHEN raw % 5 <> 4 THEN (1 + raw % 7) * 1000 END AS duration_ms, raw % 5 <> 4 AND raw % 3 = 1 AS is_error, CASE WHEN raw % 5 <> 4 THEN 'out ' || CAST(raw AS VARCHAR) END AS result_summary FROM k)"""
NTZ = "timestamp_ntz"


def calls(spark, sf):
    return t.tool_calls(t.with_turns(routed(spark, sf))).withColumn("started_at", F.col("started_at").cast(NTZ))


@query("b1_route_records", f"{C} SELECT session_id, route, count(*) AS lines FROM (SELECT session_id, CASE role WHEN 'system' THEN 'system' ELSE role END AS route FROM c UNION ALL SELECT session_id, 'assistant' FROM c WHERE role = 'assistant' UNION ALL SELECT session_id, 'user' FROM c WHERE role = 'assistant' AND turn % 5 <> 4 UNION ALL SELECT session_id, CASE conv % 3 WHEN 0 THEN '__malformed__' WHEN 1 THEN '__unmodeled_payload__' ELSE '__unknown__' END FROM c WHERE turn = 0) GROUP BY ALL")
def b1(spark, sf):
    return routed(spark, sf).groupBy("session_id", "route").agg(F.count("*").alias("lines"))


@query("b2_claude_turns", f"{C} SELECT session_id, t AS turn, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered FROM q WHERE role <> 'system' GROUP BY ALL")
def b2(spark, sf):
    rows = t.with_turns(routed(spark, sf)).where("not is_result and (route = 'user' or line_no % 4 = 0)")
    return rows.groupBy("session_id", "turn").agg(F.count_if(F.col("route") == "user").alias("asked"), F.count_if(F.col("route") == "assistant").alias("answered"))


@query("b3_turn_conditions", f"""{C}, m AS (SELECT session_id, t AS turn, turn AS raw, role, nullif({MODELS.format(turn='turn')}, '<synthetic>') AS model FROM q WHERE role <> 'system')
SELECT session_id, turn, arg_min(model, raw) FILTER (role = 'assistant' AND model IS NOT NULL) AS model, arg_min('1.' || CAST(raw AS VARCHAR), raw) FILTER (role = 'user' AND raw > 1) AS cli_version, max(CASE WHEN role = 'assistant' THEN 'standard' END) AS speed, count(DISTINCT model) FILTER (role = 'assistant') > 1 AS usage_mixed FROM m GROUP BY ALL""")
def b3(spark, sf):
    return t.turn_conditions(t.with_turns(routed(spark, sf))).select("session_id", "turn", "model", "cli_version", "speed", "usage_mixed")


@query("b4_message_usage", f"{C} SELECT session_id, t AS turn, count(*) AS messages, sum(200 + turn)::BIGINT AS input_tokens, sum(5 + length(text))::BIGINT AS output_tokens, sum(CASE WHEN turn % 3 = 0 THEN 7 END)::BIGINT AS cache_read_tokens FROM q WHERE role = 'assistant' GROUP BY ALL")
def b4(spark, sf):
    return t.message_usage(t.with_turns(routed(spark, sf))).select("session_id", "turn", "messages", "input_tokens", "output_tokens", "cache_read_tokens")


@query("b5_tool_calls", f"{C}, {CALLS} SELECT session_id, turn, seq, call_id, tool_name, tool_kind, key_arg, started_at FROM calls")
def b5(spark, sf):
    return calls(spark, sf).select("session_id", "turn", "seq", "call_id", "tool_name", "tool_kind", "key_arg", "started_at")


@query("b6_tool_results", f"{C}, {CALLS} SELECT session_id, seq, duration_ms, is_error, result_summary FROM calls")
def b6(spark, sf):
    return calls(spark, sf).select("session_id", "seq", "duration_ms", "is_error", "result_summary")


@query("b7_errors", f"{C}, {CALLS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY started_at, result_summary) - 1 AS seq, 'tool_error' AS source, result_summary AS message FROM calls WHERE is_error")
def b7(spark, sf):
    r = routed(spark, sf)
    turned = t.with_turns(r)
    return t.errors(turned, r, t.tool_calls(turned)).select("session_id", "seq", "source", "message")


@query("b8_compactions", f"{C} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS seq, ts, 'u' || CAST(conv AS VARCHAR) AS anchor FROM c WHERE role = 'system'")
def b8(spark, sf):
    return t.compactions(routed(spark, sf)).select("session_id", "seq", F.col("ts").cast(NTZ).alias("ts"), "anchor")


@query("b9_files_touched", f"{C}, {CALLS} SELECT session_id, key_arg AS path, tool_kind AS op, count(*) AS count FROM calls WHERE tool_kind IN ('read', 'edit', 'write') GROUP BY ALL")
def b9(spark, sf):
    return t.files_touched(calls(spark, sf)).drop("agent")


@query("b10_unknown_records", f"{C} SELECT session_id, CASE conv % 3 WHEN 0 THEN '__malformed__' WHEN 1 THEN '__unmodeled_payload__' ELSE 'mystery' END AS type, CASE conv % 3 WHEN 2 THEN 'x' ELSE '' END AS subtype, count(*) AS count FROM c WHERE turn = 0 GROUP BY ALL")
def b10(spark, sf):
    return t.unknown_records(routed(spark, sf)).select("session_id", "type", "subtype", "count")


@query("b11_session_header", f"""{C}, {CALLS}, n AS (SELECT session_id, count(*) AS tool_call_count, count(*) FILTER (is_error) AS error_count FROM calls GROUP BY 1), e AS (SELECT session_id, ts AS x FROM c UNION ALL SELECT session_id, ts2 FROM c WHERE role = 'assistant' AND turn % 5 <> 4),
h AS (SELECT session_id, max(CASE WHEN role = 'user' THEN '/w/' || CAST(conv AS VARCHAR) END) AS cwd, bool_or(role = 'system') AS compacted, coalesce(max(t) FILTER (role <> 'system') + 1, 0)::BIGINT AS turn_count FROM q GROUP BY 1)
SELECT session_id, cwd, compacted, turn_count, coalesce(tool_call_count, 0) AS tool_call_count, coalesce(error_count, 0) AS error_count, (epoch_us(max(x)) - epoch_us(min(x))) // 1000 AS duration_ms FROM h JOIN e USING (session_id) LEFT JOIN n USING (session_id) GROUP BY ALL""")
def b11(spark, sf):
    r = routed(spark, sf)
    turned = t.with_turns(r)
    return t.session_header(r, turned, t.tool_calls(turned)).select("session_id", "cwd", "compacted", "turn_count", "tool_call_count", "error_count", "duration_ms")


@query("b18_external_conversation", f"{cte('turns')} SELECT agent, session_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, min(idx) AS first_idx, max(idx) AS last_idx, sum(length(text))::BIGINT AS chars FROM turns GROUP BY ALL")
def b18(spark, sf):
    return table(spark, sf, "turns").groupBy("agent", "session_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum(F.length("text")).alias("chars"))


COUNTER = "SELECT agent, session_id, seq, sum(input_tokens) OVER w AS total_input, sum(cached_tokens) OVER w AS total_cached, sum(output_tokens) OVER w AS total_output, sum(output_tokens) OVER w AS total_reasoning, input_tokens AS last_input, cached_tokens AS last_cached, output_tokens AS last_output, output_tokens AS last_reasoning FROM {t} WINDOW w AS (PARTITION BY agent, session_id, CAST(floor(seq / 3) AS INT) ORDER BY seq)"
NAMES = ("input", "cached", "output", "reasoning")


@query("b13_token_deltas", f"""{cte('tool_calls')}, k AS ({COUNTER.format(t='tool_calls')}), l AS (SELECT *, {', '.join(f'lag(total_{n}) OVER w AS p_{n}' for n in NAMES)} FROM k WINDOW w AS (PARTITION BY agent, session_id ORDER BY seq))
SELECT agent, session_id, seq, {', '.join(f"(CASE WHEN {' AND '.join(f'total_{m} >= p_{m}' for m in NAMES)} THEN total_{n} - p_{n} ELSE last_{n} END)::BIGINT AS {n}" for n in NAMES)} FROM l""")
def b13(spark, sf):
    table(spark, sf, "tool_calls").createOrReplaceTempView("counter_calls")
    return t.token_deltas(spark.sql(COUNTER.format(t="counter_calls")))


CODEX = "SELECT CASE conv_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'c' || CAST(conv_id AS {s}) AS session_id, turn AS line_no, CASE WHEN role = 'user' THEN 'context' ELSE 'message' END AS kind, CASE WHEN role = 'user' THEN 't' || CAST(turn % 4 AS {s}) END AS turn_id FROM {t}"


@query("b12_codex_turns", f"""WITH r AS ({CODEX.format(s='VARCHAR', t='conversations')}),
f AS (SELECT *, kind = 'context' AND row_number() OVER (PARTITION BY agent, session_id, kind, turn_id ORDER BY line_no) = 1 AS fresh, max(CASE WHEN kind = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY agent, session_id ORDER BY line_no) AS seen FROM r),
g AS (SELECT *, fresh OR (kind = 'message' AND seen = 0 AND row_number() OVER (PARTITION BY agent, session_id, seen ORDER BY line_no) = 1) AS fresh2 FROM f),
h AS (SELECT *, CASE WHEN fresh2 THEN sum(CASE WHEN fresh2 THEN 1 ELSE 0 END) OVER (PARTITION BY agent, session_id ORDER BY line_no) - 1 END AS opened FROM g),
i AS (SELECT *, CASE WHEN kind = 'context' THEN first_value(opened IGNORE NULLS) OVER (PARTITION BY agent, session_id, kind, turn_id ORDER BY line_no) ELSE opened END AS cursor FROM h)
SELECT agent, session_id, line_no, kind, turn_id, last_value(cursor IGNORE NULLS) OVER (PARTITION BY agent, session_id ORDER BY line_no)::BIGINT AS turn FROM i""")
def b12(spark, sf):
    spark.read.parquet(f"{sf}/conversations.parquet").createOrReplaceTempView("codex_conversations")
    return t.codex_turns(spark.sql(CODEX.format(s="STRING", t="codex_conversations")))


OUTPUT = "'[main ' || substring(md5(CAST(o_orderkey AS {s})), 1, 9) || '] subject ' || CAST(o_orderkey AS {s}) || {nl} || ' ' || CAST(o_orderkey % 7 AS {s}) || ' files changed, 3 insertions(+)' || {nl} || CASE WHEN o_orderkey % 3 = 0 THEN '  [dev (root-commit) ' || substring(md5(CAST(o_orderkey + 1 AS {s})), 1, 7) || '] second' ELSE 'done' END"


@query("c1_extract_commits", "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS session_id, 1 AS part, 'main' AS branch, substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 9) AS commit_hash, 'subject ' || CAST(o_orderkey AS VARCHAR) AS subject, o_orderkey % 7 AS files_changed FROM orders UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 2, 'dev (root-commit)', substring(md5(CAST(o_orderkey + 1 AS VARCHAR)), 1, 7), 'second', NULL FROM orders WHERE o_orderkey % 3 = 0")
def c1(spark, sf):
    calls = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("'a' AS agent", "'o' || CAST(o_orderkey AS STRING) AS session_id", "0L AS seq", "'bash' AS tool_kind", OUTPUT.format(s="STRING", nl="'\\n'") + " AS result_summary", "o_orderdate AS started_at", "o_orderdate AS session_start")
    return t.extract_commits(calls).select("session_id", F.col("part").cast("int").alias("part"), "branch", "commit_hash", "subject", "files_changed")


@query("c2_quiet_commits", "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS session_id, substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS commit_hash, 'a subject of the order ' || CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_orderkey % 4 < 2")
def c2(spark, sf):
    subject = "'a subject of the order ' || CAST(o_orderkey AS STRING)"
    cmd = f"CASE o_orderkey % 4 WHEN 0 THEN 'git -C /x commit -m \"' || {subject} || '\"' WHEN 1 THEN 'git commit -m \"a subject of the order…' WHEN 2 THEN 'git commit-tree ' || {subject} ELSE 'git commit -m \"other\"' END"
    calls = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("'a' AS agent", "'o' || CAST(o_orderkey AS STRING) AS session_id", "0L AS seq", "'bash' AS tool_kind", f"'noise\\n' || substring(md5(CAST(o_orderkey AS STRING)), 1, 8) || ' ' || {subject} AS result_summary", f"{cmd} AS key_arg", "o_orderdate AS started_at", "o_orderdate AS session_start")
    return t.quiet_commits(calls).select("session_id", "commit_hash", "subject")


SESSION_COMMITS = "SELECT 'a' AS agent, 'k' || CAST(o_custkey AS {s}) AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq, 1 AS part, CASE o_orderkey % 3 WHEN 0 THEN '[tk-' || CAST(o_orderkey % 40 AS {s}) || '] x' WHEN 1 THEN 'x [ns/tk-' || CAST(o_orderkey % 40 AS {s}) || ']' ELSE 'plain' END AS subject FROM {t}"


@query("c17_source_tickets", f"""WITH c AS ({SESSION_COMMITS.format(s='VARCHAR', t='orders')}), m AS (SELECT *, regexp_extract(subject, '\\[([^\\]]+)\\]', 1) AS ticket FROM c WHERE subject <> 'plain'), f AS (SELECT agent, session_id, ticket, min(seq) AS seq FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, ticket) AS n FROM f)
SELECT agent, session_id, string_agg(ticket, ',' ORDER BY n) AS tickets FROM r WHERE n <= 32 GROUP BY ALL""")
def c17(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("ticket_orders")
    return t.source_tickets(spark.sql(SESSION_COMMITS.format(s="STRING", t="ticket_orders"))).withColumn("tickets", F.array_join("tickets", ","))


DISPATCHED = "SELECT 'a' AS agent, 'c' || CAST(conv_id % 10 AS {s}) AS session_id, CAST(conv_id AS BIGINT) AS seq, 't' || CAST(conv_id AS {s}) AS tool_use_id, 'explorer' AS agent_type, CAST({ts} AS {k}) AS started_at FROM {t} WHERE conv_id % 4 <> 0 GROUP BY conv_id"
CHILDREN = "SELECT 'a' AS agent, 'c' || CAST(conv_id % 10 AS {s}) AS parent_session_id, 't' || CAST(conv_id AS {s}) AS tool_use_id, turn AS line_no, {ts} AS ts, role, text, CASE WHEN role = 'assistant' THEN 'm' || CAST((conv_id + CASE WHEN conv_id % 5 = 0 THEN turn ELSE 0 END) % 7 AS {s}) END AS model, CASE WHEN role = 'assistant' THEN turn END AS input_tokens, CASE WHEN role = 'assistant' THEN turn * 2 END AS output_tokens FROM {t} WHERE conv_id % 3 <> 0"


@query("b15_subagent_rollup", f"""WITH d AS ({DISPATCHED.format(s='VARCHAR', t='conversations', ts="TIMESTAMP '2024-01-01' + to_seconds(conv_id)", k='TIMESTAMP')}), k AS ({CHILDREN.format(s='VARCHAR', t='conversations', ts="TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn)")}),
c AS (SELECT agent, parent_session_id AS session_id, tool_use_id, count(ts) AS stamps, min(ts) AS a, max(ts) AS z, arg_min(text, line_no) FILTER (role = 'user' AND text <> '') AS prompt, arg_max(text, line_no) FILTER (role = 'assistant' AND text <> '') AS result, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, arg_min(model, line_no) FILTER (input_tokens IS NOT NULL AND model IS NOT NULL) AS first_model, count(DISTINCT model) FILTER (input_tokens IS NOT NULL) AS models FROM k GROUP BY ALL)
SELECT agent, session_id, row_number() OVER (PARTITION BY agent, session_id ORDER BY coalesce(a, started_at) NULLS LAST, tool_use_id, seq NULLS LAST) - 1 AS seq, tool_use_id, agent_type, CASE WHEN stamps >= 2 THEN (epoch_us(z) - epoch_us(a)) // 1000 END AS duration_ms, prompt, result AS result_summary, CASE WHEN models > 1 THEN 'mixed' ELSE first_model END AS model, input_tokens, output_tokens FROM d FULL JOIN c USING (agent, session_id, tool_use_id)""")
def b15(spark, sf):
    spark.read.parquet(f"{sf}/conversations.parquet").createOrReplaceTempView("child_conversations")
    at = "timestampadd(SECOND, CAST({x} AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    d = spark.sql(DISPATCHED.format(s="STRING", t="child_conversations", ts=at.format(x="conv_id"), k="TIMESTAMP_NTZ"))
    c = spark.sql(CHILDREN.format(s="STRING", t="child_conversations", ts=at.format(x="conv_id * 60 + turn")))
    return t.subagent_rollup(d, c).drop("began")
