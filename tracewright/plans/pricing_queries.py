"""Queries of pricing and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import pricing as p
from tracewright.plans.adapters import cte, table
from tracewright.plans.registry import query

#: A rate table: one model is left out so that some rows stay unpriced.
RATES = """rates AS (SELECT * FROM (VALUES
 ('1-URGENT', TIMESTAMP '1995-03-01 00:00:00', 3.0, 15.0, 0.3, 3.75, 6.0), ('1-URGENT', TIMESTAMP '1997-01-01 00:00:00', 2.5, 12.0, 0.25, 3.0, 5.0), ('1-URGENT', TIMESTAMP '2000-01-01 00:00:00', 2.0, 10.0, 0.2, 2.5, 4.0),
 ('2-HIGH', TIMESTAMP '1996-01-01 00:00:00', 1.0, 5.0, 0.1, 1.25, 2.0), ('2-HIGH', TIMESTAMP '1998-06-01 00:00:00', 0.8, 4.0, 0.08, 1.0, 1.6), ('2-HIGH', TIMESTAMP '2001-01-01 00:00:00', 0.5, 2.5, 0.05, 0.6, 1.0),
 ('3-MEDIUM', TIMESTAMP '1995-01-01 00:00:00', 15.0, 75.0, 1.5, 18.75, 30.0), ('3-MEDIUM', TIMESTAMP '1999-01-01 00:00:00', 5.0, 25.0, 0.5, 6.25, 10.0), ('3-MEDIUM', TIMESTAMP '2000-06-01 00:00:00', 4.0, 20.0, 0.4, 5.0, 8.0),
 ('5-LOW', TIMESTAMP '1997-07-01 00:00:00', 0.25, 1.25, 0.03, 0.3, 0.5), ('5-LOW', TIMESTAMP '1998-07-01 00:00:00', 0.2, 1.0, 0.02, 0.25, 0.4), ('5-LOW', TIMESTAMP '1999-07-01 00:00:00', 0.1, 0.5, 0.01, 0.12, 0.2))
 AS t(model, effective, input_rate, output_rate, cache_read_rate, cache_write_5m_rate, cache_write_1h_rate))"""


def rates(spark):
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("input_rate", "output_rate", "cache_read_rate", "cache_write_5m_rate", "cache_write_1h_rate"))
    return spark.sql(f"WITH {RATES.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')} SELECT model, effective, {doubles} FROM rates")


def usage(spark, sf):
    """Tool calls with their session's model and start."""
    s = table(spark, sf, "sessions").select("agent", "session_id", "model", F.col("start_time").alias("at"))
    return table(spark, sf, "tool_calls").join(s, ["agent", "session_id"])


ASOF = f"""{RATES}, u AS (SELECT t.*, s.model, s.start_time AS at FROM tool_calls t JOIN sessions s USING (agent, session_id)),
a AS (SELECT u.*, r.effective, r.input_rate::DOUBLE AS input_rate, r.output_rate::DOUBLE AS output_rate, r.cache_read_rate::DOUBLE AS cache_read_rate FROM u ASOF LEFT JOIN rates r ON u.model = r.model AND u.at >= r.effective)"""
BILL = """b AS (SELECT *, CASE WHEN agent = 'codex-cli' AND cached_tokens > input_tokens THEN 'cached exceeds input' WHEN agent NOT IN ('claude-code', 'codex-cli') AND cached_tokens > 0 THEN 'cache semantics unknown' END AS reason FROM a),
c AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN agent = 'codex-cli' THEN input_tokens - cached_tokens ELSE input_tokens END END AS billed_input FROM b)"""


@query("e1_rate_asof", f"{cte('sessions', 'tool_calls')}, {ASOF} SELECT session_id, seq, model, effective, input_rate FROM a")
def e1(spark, sf):
    return p.rate_asof(usage(spark, sf), rates(spark)).select("session_id", "seq", "model", "effective", "input_rate")


def priced(spark, sf):
    rows = p.billable(p.rate_asof(usage(spark, sf), rates(spark)))
    zero = F.lit(0)
    cost = p.cost_of(F.col("billed_input"), F.col("output_tokens"), F.col("cached_tokens"), zero, zero)
    return rows.withColumn("cost", cost).withColumn("reason", F.coalesce("reason", F.when(F.col("input_rate").isNull(), F.concat(F.lit("no rate for "), "model"))))


@query("e2_price_usage", f"{cte('sessions', 'tool_calls')}, {ASOF}, {BILL} SELECT session_id, seq, floor((billed_input * input_rate + output_tokens * output_rate + cached_tokens * cache_read_rate) / 1e6 * 1e9 + 0.5)::BIGINT AS nano_usd FROM c")
def e2(spark, sf):
    return priced(spark, sf).select("session_id", "seq", F.floor(F.col("cost") * 1e9 + 0.5).alias("nano_usd"))


@query("e3_split_cache_ttl", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 60 <= CAST(l_quantity AS BIGINT) THEN CAST(l_quantity AS BIGINT) - l_partkey % 60 END AS five_minutes, CASE WHEN l_partkey % 60 <= CAST(l_quantity AS BIGINT) THEN l_partkey % 60 END AS one_hour FROM lineitem")
def e3(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    five, hour = p.split_cache(F.col("l_quantity").cast("long"), F.col("l_partkey") % 60)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", five.alias("five_minutes"), hour.alias("one_hour"))


@query("e4_billable_usage", f"{cte('sessions', 'tool_calls')}, {ASOF}, {BILL} SELECT session_id, seq, billed_input, reason FROM c")
def e4(spark, sf):
    return p.billable(usage(spark, sf)).select("session_id", "seq", "billed_input", "reason")


SPANS = "spans AS (SELECT *, lead(idx) OVER w - 1 AS last_idx, coalesce(lead(started_at) OVER w, session_end) AS until FROM invocations WINDOW w AS (PARTITION BY agent, session_id ORDER BY idx))"


def spans(spark, sf):
    return p.invocation_spans(table(spark, sf, "invocations"))


@query("e5_invocation_spans", f"{cte('invocations')}, {SPANS} SELECT agent, session_id, idx, last_idx, started_at, until FROM spans")
def e5(spark, sf):
    return spans(spark, sf).select("agent", "session_id", "idx", "last_idx", "started_at", "until")


CALLS = "calls AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'k' || CAST(o_custkey AS VARCHAR) AS session_id, l_shipdate AS at, coalesce(nullif(l_returnflag, 'N'), 'unknown') AS kind, CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS BIGINT) END AS ms, l_linestatus = 'F' AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def calls(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS l_orderkey", "CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS c_agent", "'k' || CAST(o_custkey AS STRING) AS c_session")
    return spark.read.parquet(f"{sf}/lineitem.parquet").join(o, "l_orderkey").selectExpr("c_agent", "c_session", "l_shipdate AS at", "coalesce(nullif(l_returnflag, 'N'), 'unknown') AS kind", "CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS BIGINT) END AS ms", "l_linestatus = 'F' AS bad")


@query(
    "e6_cost_report",
    f"""{cte('invocations')}, {SPANS}, {CALLS},
k AS (SELECT s.agent, s.session_id, s.idx, c.kind, count(*) AS n, count(*) FILTER (bad) AS errors, sum(ms) FILTER (ms >= 0)::BIGINT AS ms FROM spans s JOIN calls c ON s.agent = c.agent AND s.session_id = c.session_id AND c.at >= s.started_at AND (s.until IS NULL OR c.at < s.until) GROUP BY ALL),
g AS (SELECT agent, session_id, idx, sum(n)::BIGINT AS tool_calls, sum(errors)::BIGINT AS errors, sum(ms)::BIGINT AS active_ms, array_to_string(list_sort(list(kind || '=' || CAST(n AS VARCHAR))), ',') AS by_kind FROM k GROUP BY ALL)
SELECT s.agent, s.session_id, s.idx, s.ticket, coalesce(tool_calls, 0) AS tool_calls, coalesce(errors, 0) AS errors, active_ms, coalesce(by_kind, '') AS by_kind FROM spans s LEFT JOIN g USING (agent, session_id, idx)""",
)
def e6(spark, sf):
    from tracewright.operators.cost_report import call_measures

    got = call_measures(spans(spark, sf), calls(spark, sf))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return got.select("agent", "session_id", "idx", "ticket", "tool_calls", "errors", "active_ms", F.coalesce(text, F.lit("")).alias("by_kind"))


@query(
    "e7_cost_usd",
    f"""{cte('sessions', 'tool_calls')}, {ASOF}, {BILL},
d AS (SELECT session_id, agent, seq, input_tokens + output_tokens + cached_tokens AS tokens, (billed_input * input_rate + output_tokens * output_rate + cached_tokens * cache_read_rate) / 1e6 AS cost, coalesce(reason, CASE WHEN input_rate IS NULL THEN 'no rate for ' || model END) AS reason FROM c),
w AS (SELECT agent, session_id, reason, min(seq) AS seq FROM d WHERE tokens > 0 AND cost IS NULL GROUP BY ALL),
v AS (SELECT agent, session_id, array_to_string(list(reason ORDER BY seq), '; ') AS warnings FROM w GROUP BY ALL)
SELECT agent, session_id, count(*) AS units, count(*) FILTER (tokens > 0 AND cost IS NULL) AS unpriced, coalesce(any_value(warnings), '') AS warnings, CASE WHEN count(*) FILTER (tokens > 0 AND cost IS NULL) = 0 THEN ((coalesce(sum(floor(cost * 1e9 + 0.5)::BIGINT) FILTER (tokens > 0), 0) + 500)::BIGINT // 1000) / 1e6 END AS cost_usd FROM d LEFT JOIN v USING (agent, session_id) GROUP BY agent, session_id""",
)
def e7(spark, sf):
    rows = priced(spark, sf).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cached_tokens")).withColumn("ord", F.col("seq"))
    got = p.cost_or_null(rows, ["agent", "session_id"])
    return got.select("agent", "session_id", "units", "unpriced", F.array_join("warnings", "; ").alias("warnings"), "cost_usd")


SESSION_COMMITS = "k AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'k' || CAST(o_custkey AS {s}) AS session_id, CASE WHEN o_orderkey % 14 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS committed_at, '[' || CASE WHEN o_orderkey % 3 = 0 THEN 'ns/' ELSE '' END || 'tk-' || CAST(o_orderkey % 30 AS {s}) || '] x' AS subject FROM {t} WHERE o_orderkey % 5 = 0)"
COMMITTED = f"""{cte('invocations')}, {SPANS}, {SESSION_COMMITS.format(s='VARCHAR', t='orders')},
j AS (SELECT s.*, committed_at, coalesce(committed_at >= started_at AND (until IS NULL OR committed_at < until) AND committed_at <> session_start, false) AS inside, coalesce(regexp_extract(subject, '^\\[([^\\]]*)\\]', 1) = ticket OR ends_with(regexp_extract(subject, '^\\[([^\\]]*)\\]', 1), '/' || ticket), false) AS named FROM spans s LEFT JOIN k USING (agent, session_id)),
r AS (SELECT agent, session_id, idx, ticket, started_at, bool_or(inside OR named) AS committed, max(committed_at) FILTER (inside) AS commit_at FROM j GROUP BY ALL)"""


def committed(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("commit_orders")
    k = spark.sql(f"WITH {SESSION_COMMITS.format(s='STRING', t='commit_orders')} SELECT * FROM k")
    return p.run_commit(spans(spark, sf), k)


@query("e8_run_commit", f"{COMMITTED} SELECT * FROM r")
def e8(spark, sf):
    return committed(spark, sf)


@query("e9_wall_clock", f"{COMMITTED} SELECT agent, session_id, idx, CASE WHEN commit_at >= started_at THEN (epoch_us(commit_at) - epoch_us(started_at)) // 1000 END AS wall_ms FROM r")
def e9(spark, sf):
    return committed(spark, sf).select("agent", "session_id", "idx", p.wall_ms(F.col("started_at"), F.col("commit_at")).alias("wall_ms"))


@query("e10_range_filter", f"{cte('commits')} SELECT agent, session_id, commit_hash FROM commits WHERE committed_at >= TIMESTAMP '1998-01-01' AND committed_at < TIMESTAMP '1998-03-01'")
def e10(spark, sf):
    at = F.col("committed_at")
    return table(spark, sf, "commits").where(p.in_range(at, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1998-03-01 00:00:00'"))).select("agent", "session_id", "commit_hash")
