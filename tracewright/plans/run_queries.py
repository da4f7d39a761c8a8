"""Queries of the execution registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import registry_runs as f
from tracewright.plans.adapters import cte, table
from tracewright.plans.pricing_queries import SPANS, spans
from tracewright.plans.registry import query

KINDS, OUTCOMES = ["root", "subagent", "human"], ["success", "failed", "cancelled"]
ORDER = "(recorded_at, l_partkey, l_suppkey, l_extendedprice)"
CODE = "CASE WHEN v <> 1 THEN 'unsupported_version' WHEN execution_kind NOT IN ('root', 'subagent', 'human') THEN 'unknown_execution_kind' WHEN outcome IS NOT NULL AND outcome NOT IN ('success', 'failed', 'cancelled') THEN 'unknown_outcome' WHEN ended_at < started_at THEN 'ends_before_start' END"
VALID = f"{cte('records')}, valid AS (SELECT * FROM records WHERE ({CODE}) IS NULL)"
FOLDED = ["run_id", "parent_execution_id", "execution_kind", "outcome", "stage", "started_at", "ended_at"]
EXECUTIONS = f"{VALID}, executions AS (SELECT execution_id, {', '.join(f'arg_max({c}, {ORDER}) FILTER ({c} IS NOT NULL) AS {c}' for c in FOLDED)}, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, count(*) AS records FROM valid GROUP BY execution_id)"


def order():
    return F.struct("recorded_at", "l_partkey", "l_suppkey", "l_extendedprice")


def records(spark, sf):
    return f.validate(table(spark, sf, "records"), KINDS, OUTCOMES)


def executions(spark, sf):
    kept, _ = f.freeze_run(records(spark, sf)[0], order())
    return f.fold(kept, "execution_id", FOLDED, order())


@query("f1_registry_diagnostics", f"{cte('records')} SELECT execution_id, run_id, {CODE} AS code FROM records WHERE ({CODE}) IS NOT NULL")
def f1(spark, sf):
    return records(spark, sf)[1]


@query("f2_fold_runs", f"{VALID} SELECT run_id, {', '.join(f'arg_max({c}, {ORDER}) FILTER ({c} IS NOT NULL) AS {c}' for c in ('outcome', 'stage'))}, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, count(*) AS records FROM valid GROUP BY run_id")
def f2(spark, sf):
    return f.fold(records(spark, sf)[0], "run_id", ["outcome", "stage"], order())


@query("f3_fold_executions", f"{EXECUTIONS} SELECT * FROM executions")
def f3(spark, sf):
    return executions(spark, sf)


@query("f5_unresolved", f"""{EXECUTIONS}, runs AS (SELECT DISTINCT run_id FROM executions WHERE execution_kind = 'root')
SELECT execution_id, run_id, 'unresolved_run' AS code FROM executions e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = e.run_id)
UNION ALL SELECT execution_id, run_id, 'unresolved_parent' FROM executions e WHERE parent_execution_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM executions p WHERE p.run_id = e.run_id AND p.execution_id = e.parent_execution_id)""")
def f5(spark, sf):
    e = executions(spark, sf)
    return f.unresolved(e, e.where("execution_kind = 'root'").select("run_id").distinct())


TREE = """roots AS (SELECT run_id, execution_id FROM executions WHERE parent_execution_id IS NULL AND execution_kind = 'root' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at NULLS LAST, execution_id) = 1),
tops AS (SELECT e.run_id, e.execution_id, coalesce(epoch_us(e.started_at), 9223372036854775807) AS began, CASE WHEN r.execution_id IS NOT NULL THEN 'placed' WHEN e.parent_execution_id IS NULL THEN 'second_root' ELSE 'orphan' END AS state FROM executions e LEFT JOIN roots r USING (run_id, execution_id) LEFT JOIN executions p ON p.run_id = e.run_id AND p.execution_id = e.parent_execution_id WHERE e.parent_execution_id IS NULL OR p.execution_id IS NULL),
tree AS (SELECT run_id, execution_id, state, 0 AS depth, [execution_id] AS path, [{'a': began, 'e': execution_id}] AS walk, false AS barred FROM tops UNION ALL SELECT e.run_id, e.execution_id, t.state, t.depth + 1, list_append(t.path, e.execution_id), list_append(t.walk, {'a': coalesce(epoch_us(e.started_at), 9223372036854775807), 'e': e.execution_id}), t.barred OR (coalesce(e.execution_kind, '') = 'human' AND NOT (t.depth = 0 AND t.state = 'placed')) FROM tree t JOIN executions e ON e.run_id = t.run_id AND e.parent_execution_id = t.execution_id WHERE NOT list_contains(t.path, e.execution_id)),
built AS (SELECT e.run_id, e.execution_id, e.parent_execution_id, CASE WHEN t.state = 'placed' THEN t.depth END AS depth, CASE WHEN t.state = 'placed' THEN array_to_string(t.path, '/') END AS path, coalesce(t.state, 'cyclic') AS state, CASE WHEN t.state = 'placed' THEN t.walk END AS walk FROM executions e LEFT JOIN (SELECT * REPLACE (CASE WHEN barred THEN 'invalid_parent' ELSE state END AS state) FROM tree) t USING (run_id, execution_id))"""


@query("f7_build_tree", f"{EXECUTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TREE} SELECT * EXCLUDE (walk) FROM built")
def f7(spark, sf):
    return f.build_tree(executions(spark, sf), trail=("path",))


@query("g1_run_walk", f"{EXECUTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TREE} SELECT run_id, execution_id, row_number() OVER (PARTITION BY run_id ORDER BY walk)::INT AS place FROM built WHERE state = 'placed'")
def g1(spark, sf):
    from tracewright.operators.run_report import walk

    return walk(f.build_tree(executions(spark, sf), trail=("walk",)))


@query("f8_spanning_invocation", f"""{cte('invocations', 'sessions')}, {SPANS}, n AS (SELECT *, count(*) OVER (PARTITION BY agent, session_id) AS of_session FROM spans), r AS (SELECT session_id AS run_id, CASE owner % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'k' || CAST(owner AS VARCHAR) AS session_id, start_time FROM sessions)
SELECT run_id, CASE WHEN count(idx) = 1 THEN min(idx) END AS idx FROM r LEFT JOIN n ON r.agent = n.agent AND r.session_id = n.session_id AND (of_session = 1 OR (start_time >= started_at AND (until IS NULL OR start_time < until))) GROUP BY run_id""")
def f8(spark, sf):
    runs = table(spark, sf, "sessions").selectExpr("session_id AS run_id", "CASE owner % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent", "'k' || CAST(owner AS STRING) AS session_id", "start_time AS started_at")
    return f.spanning_invocation(runs, spans(spark, sf))


RUNS = "SELECT 'q' || CAST(o_orderkey AS {s}) AS run_id, CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'tk-' || CAST(o_orderkey % 30 AS {s}) AS ticket, o_orderdate AS started_at FROM {t}"
INFER = f"""{cte('invocations')}, {SPANS}, r AS ({RUNS.format(s='VARCHAR', t='orders')}),
inferred AS (SELECT run_id, count(idx) AS matches, CASE WHEN count(idx) = 1 THEN min(s.session_id) END AS session_id, CASE WHEN count(idx) = 1 THEN min(idx) END AS idx, CASE WHEN count(idx) > 1 THEN 'ambiguous_transcript' END AS diagnostic
 FROM r LEFT JOIN spans s ON r.agent = s.agent AND r.ticket = s.ticket AND r.started_at >= s.started_at AND (until IS NULL OR r.started_at < until) GROUP BY run_id)"""


def inferred(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("infer_orders")
    return f.infer_invocation(spark.sql(RUNS.format(s="STRING", t="infer_orders")), spans(spark, sf))


@query("f9_infer_join", f"{INFER} SELECT * FROM inferred")
def f9(spark, sf):
    return inferred(spark, sf)


DECLARED = """SELECT 'q' || CAST(o_orderkey AS {s}) AS run_id, CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END END AS runtime, CASE WHEN o_orderkey % 13 <> 0 THEN 'tk-' || CAST(o_orderkey % 30 AS {s}) ELSE '' END AS ticket,
 CASE WHEN o_orderkey % 4 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END ELSE '' END AS agent, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN 'k' || CAST(o_custkey AS {s}) END AS session_id, CASE WHEN o_orderkey % 7 = 3 THEN 'none' END AS root_transcript, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS started_at FROM {t}"""
NODES = """SELECT 'q' || CAST(l_orderkey AS {s}) AS run_id, 'q' || CAST(l_orderkey AS {s}) || '-' || CAST(l_linenumber AS {s}) || '-' || CAST(l_partkey AS {s}) || '-' || CAST(l_suppkey AS {s}) AS execution_id, CASE WHEN l_linenumber > 2 THEN 'up' ELSE '' END AS parent_execution_id, CASE WHEN l_linenumber = 1 OR l_tax > 0.04 THEN 'root' ELSE 'subagent' END AS execution_kind,
 CASE WHEN l_partkey % 3 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END END AS agent, CASE WHEN l_partkey % 3 = 0 THEN 'k' || CAST(l_suppkey AS {s}) ELSE '' END AS session_id, CASE WHEN l_discount > 0.01 THEN l_shipdate END AS started_at FROM {t}"""


@query("f13_declared_transcript", f"""{cte('invocations')}, {SPANS}, counted AS (SELECT *, count(*) OVER (PARTITION BY agent, session_id) AS of_session, last_idx IS NULL AS final FROM spans),
r AS (SELECT * REPLACE (nullif(agent, '') AS agent, nullif(session_id, '') AS session_id) FROM ({DECLARED.format(s='VARCHAR', t='orders')})),
roots AS (SELECT run_id, execution_id AS root_execution_id, nullif(agent, '') AS n_agent, nullif(session_id, '') AS n_session FROM ({NODES.format(s='VARCHAR', t='lineitem')}) WHERE parent_execution_id = '' AND execution_kind = 'root' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at NULLS LAST, execution_id) = 1),
e AS (SELECT r.*, root_execution_id, n_agent, n_session, coalesce(agent, session_id) IS NOT NULL AS own, coalesce(n_agent, n_session) IS NOT NULL AS by_root FROM r LEFT JOIN roots USING (run_id)),
d AS (SELECT *, CASE WHEN own THEN agent WHEN by_root THEN n_agent END AS d_agent, CASE WHEN own THEN session_id WHEN by_root THEN n_session END AS d_session FROM e),
said AS (SELECT d.run_id, CASE WHEN count(c.idx) = 1 THEN min(c.idx) END AS idx FROM d LEFT JOIN counted c ON c.agent = d.d_agent AND c.session_id = d.d_session AND (of_session = 1 OR (d.started_at >= c.started_at AND (d.started_at < until OR (until IS NULL AND final)))) WHERE own OR by_root GROUP BY d.run_id),
guess AS (SELECT d.run_id, count(c.idx) AS matches, min(c.session_id) AS session_id, min(c.idx) AS idx FROM d LEFT JOIN counted c ON c.agent = d.runtime AND c.ticket = d.ticket AND d.ticket <> '' AND d.started_at >= c.started_at AND (d.started_at < until OR (until IS NULL AND final)) WHERE NOT own AND NOT by_root AND root_transcript IS NULL GROUP BY d.run_id)
SELECT d.run_id, CASE WHEN matches = 1 THEN runtime ELSE d_agent END AS agent, CASE WHEN matches = 1 THEN guess.session_id ELSE d_session END AS session_id, CASE WHEN own OR by_root THEN 'declared' WHEN root_transcript = 'none' THEN 'none' WHEN matches = 1 THEN 'invocation' END AS basis,
 CASE WHEN matches = 1 THEN guess.idx ELSE said.idx END AS idx, root_execution_id, CASE WHEN root_execution_id IS NULL THEN NULL WHEN matches = 1 THEN runtime ELSE n_agent END AS root_agent, CASE WHEN root_execution_id IS NULL THEN NULL WHEN matches = 1 THEN guess.session_id ELSE n_session END AS root_session_id, CASE WHEN matches > 1 THEN 'ambiguous_join' END AS diagnostic, CASE WHEN matches > 1 THEN matches END AS invocations
FROM d LEFT JOIN said USING (run_id) LEFT JOIN guess USING (run_id)""")
def f13(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("declared_orders")
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("declared_nodes")
    return f.declared_transcripts(spark.sql(DECLARED.format(s="STRING", t="declared_orders")), spark.sql(NODES.format(s="STRING", t="declared_nodes")), spans(spark, sf))


@query("f10_historical_runs", f"{cte('invocations')} SELECT 'transcript:' || agent || ':' || session_id || ':' || CAST(idx AS VARCHAR) AS run_id, agent, session_id, idx, ticket, started_at FROM invocations WHERE idx <> 1")
def f10(spark, sf):
    i = table(spark, sf, "invocations")
    return f.historical_runs(i, i.where("idx = 1"))


@query("f12_child_sessions", f"""{cte('sessions').replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT agent, session_id AS root_id, session_id, 0 AS depth, [session_id] AS path FROM sessions WHERE parent_session_id IS NULL UNION ALL SELECT t.agent, t.root_id, c.session_id, t.depth + 1, list_append(t.path, c.session_id) FROM t JOIN sessions c ON c.agent = t.agent AND c.parent_session_id = t.session_id WHERE NOT list_contains(t.path, c.session_id))
SELECT agent, root_id, session_id, depth FROM t""")
def f12(spark, sf):
    return f.descendants(table(spark, sf, "sessions"))


FIRST_START = f"{EXECUTIONS}, runs AS (SELECT run_id, min(started_at) AS started_at, count(*) AS executions FROM executions GROUP BY run_id)"


@query("f6_run_time_filter", f"{FIRST_START} SELECT run_id, executions FROM runs WHERE started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1998-06-01'")
def f6(spark, sf):
    from tracewright.operators.pricing import in_range

    runs = executions(spark, sf).groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.count("*").alias("executions"))
    at = lambda x: F.expr(f"TIMESTAMP_NTZ '{x} 00:00:00'")
    return runs.where(in_range(F.col("started_at"), at("1996-01-01"), at("1998-06-01"))).select("run_id", "executions")
