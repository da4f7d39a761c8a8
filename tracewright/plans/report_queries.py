"""Queries of run reports over registry and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.tables import written
from tracewright.operators import rollups as r
from tracewright.operators import run_report as g
from tracewright.plans.adapters import cte, table
from tracewright.plans.pricing_queries import SPANS, spans
from tracewright.plans.registry import query
from tracewright.plans.run_queries import EXECUTIONS, executions

RUNS = "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS total_cost, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS parent_cost, CASE WHEN o_orderkey % 7 < 3 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS priced_children_cost, o_orderdate AS started, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 END AS failures FROM {t}"
#: A run's measures from its lines; a wall clock only where all lines ended, tokens unavailable for each sixth run.
MEASURES = "SELECT l_orderkey AS run_id, CAST(sum(l_quantity) AS BIGINT) AS execution_ms, CAST(sum(l_suppkey) AS BIGINT) AS tool_ms, CAST(sum(l_partkey) AS BIGINT) AS tokens, count(*) AS tool_calls, count_if(l_returnflag = 'R') AS children, CASE WHEN max(l_linestatus) = 'F' THEN CAST(max(l_quantity) AS BIGINT) END AS wall_ms FROM {t} GROUP BY l_orderkey"
COUNTED = ["execution_ms", "tool_ms", "tokens", "tool_calls", "children"]
SHOWN = "coalesce(total_cost, CASE WHEN parent_cost IS NOT NULL OR priced_children_cost > 0 THEN coalesce(parent_cost, 0) + coalesce(priced_children_cost, 0) END)"
MEASURED = f"""WITH r AS (SELECT *, {SHOWN} AS shown_cost, run_id % 6 = 0 AS tokens_unavailable FROM ({RUNS.format(t='orders')})), m AS ({MEASURES.format(t='lineitem')}),
x AS (SELECT r.*, wall_ms, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTED)} FROM r LEFT JOIN m ON r.run_id = m.run_id)"""
NEWEST = ["started desc", "run_id"]
RUN_SORTS = {
    "cost": ["shown_cost desc nulls last", *NEWEST],
    "failures": ["failures desc nulls last", *NEWEST],
    "newest": NEWEST,
    "wall": ["wall_ms desc nulls last", *NEWEST],
    "execution_time": ["execution_ms desc", *NEWEST],
    "tool_time": ["tool_ms desc", *NEWEST],
    "tokens": ["tokens_unavailable", "tokens desc", *NEWEST],
    "tools": ["tool_calls desc", *NEWEST],
    "children": ["children desc", *NEWEST],
}


def runs(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("report_orders")
    return spark.sql(RUNS.format(t="report_orders"))


def measured(spark, sf):
    """Runs with the cost that is shown and the measures of their lines."""
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("report_lines")
    shown = r.display_cost(runs(spark, sf)).withColumn("tokens_unavailable", F.col("run_id") % 6 == 0)
    return shown.join(spark.sql(MEASURES.format(t="report_lines")), "run_id", "left").fillna(0, COUNTED)


def _d12(key: str) -> None:
    @query(f"d12_runs_by_{key}", f"{MEASURED} SELECT run_id, (row_number() OVER (ORDER BY {', '.join(RUN_SORTS[key])}))::INT AS place FROM x")
    def f(spark, sf):
        return r.ranked(measured(spark, sf), RUN_SORTS[key]).select("run_id", "place")


for _key in RUN_SORTS:
    _d12(_key)


@query("d13_run_display_cost", f"WITH r AS ({RUNS.format(t='orders')}), s AS (SELECT run_id, total_cost, coalesce(total_cost, CASE WHEN parent_cost IS NOT NULL OR priced_children_cost > 0 THEN coalesce(parent_cost, 0) + coalesce(priced_children_cost, 0) END) AS shown_cost FROM r) SELECT run_id, shown_cost, total_cost IS NULL AND shown_cost IS NOT NULL AS partial FROM s")
def d13(spark, sf):
    return r.display_cost(runs(spark, sf)).select("run_id", "shown_cost", "partial")


@query("g8_ticket_index", f"""{cte('invocations')}, {SPANS}, s AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent, 'k' || CAST(o_custkey AS VARCHAR) AS session_id, o_orderdate + INTERVAL 1 DAY AS moment FROM orders)
SELECT s.agent, s.session_id, moment AS "at", CASE WHEN count(DISTINCT ticket) = 1 THEN min(ticket) END AS ticket FROM s LEFT JOIN spans p ON s.agent = p.agent AND s.session_id = p.session_id AND moment >= started_at AND (until IS NULL OR moment < until) GROUP BY ALL""")
def g8(spark, sf):
    s = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("CASE o_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'cursor-cli' END AS agent", "'k' || CAST(o_custkey AS STRING) AS session_id", "o_orderdate + INTERVAL 1 DAY AS at").distinct()
    return g.ticket_index(s, spans(spark, sf))


LENS = "e AS (SELECT run_id, execution_id, coalesce(stage, 'none') AS lens, records % 2 AS round, records AS attempt FROM executions), a AS (SELECT run_id, execution_id || '/a' AS attempt_id, CASE WHEN records % 2 = 1 THEN execution_id END AS a_execution_id, coalesce(stage, 'none') AS lens, records % 2 AS round, records + CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS attempt FROM executions WHERE outcome IS DISTINCT FROM 'failed')"


@query("g10_lens_groups", f"""{EXECUTIONS}, {LENS},
i AS (SELECT e.run_id, e.lens, e.round, e.attempt, e.execution_id, a.attempt_id FROM e JOIN a ON e.run_id = a.run_id AND e.execution_id = a.a_execution_id),
x AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.run_id = e.run_id AND i.execution_id = e.execution_id)), y AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.run_id = a.run_id AND i.attempt_id = a.attempt_id))
SELECT *, 'execution' AS attribution FROM i UNION ALL
SELECT coalesce(x.run_id, y.run_id), coalesce(x.lens, y.lens), coalesce(x.round, y.round), coalesce(x.attempt, y.attempt), x.execution_id, y.attempt_id, CASE WHEN x.execution_id IS NOT NULL AND y.attempt_id IS NOT NULL THEN 'transcript' WHEN x.execution_id IS NOT NULL THEN 'execution' ELSE 'unknown' END FROM x FULL JOIN y ON x.run_id = y.run_id AND x.lens = y.lens AND x.round = y.round AND x.attempt = y.attempt""")
def g10(spark, sf):
    # the fold of executions is met on both sides of each join
    x = written(executions(spark, sf), "lens-executions")
    e = x.selectExpr("run_id", "execution_id", "coalesce(stage, 'none') AS lens", "records % 2 AS round", "records AS attempt")
    a = x.where("not (outcome <=> 'failed')").selectExpr("run_id", "execution_id || '/a' AS attempt_id", "CASE WHEN records % 2 = 1 THEN execution_id END AS a_execution_id", "coalesce(stage, 'none') AS lens", "records % 2 AS round", "records + CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS attempt")
    return g.lens_groups(e, a)


@query("g6_telemetry_gaps", f"""{cte('tool_calls')}, u AS (SELECT session_id AS run_id, CASE WHEN tool_kind IS NULL THEN 'no kind' WHEN duration_ms IS NULL THEN 'no time' END AS gap, seq FROM tool_calls), f AS (SELECT run_id, gap, min(seq) AS seq FROM u WHERE gap IS NOT NULL GROUP BY ALL)
SELECT run_id, coalesce(string_agg(gap, ',' ORDER BY f.seq), '') AS gaps, CASE WHEN count(f.gap) = 0 THEN 'complete' ELSE 'partial' END AS telemetry FROM (SELECT DISTINCT run_id FROM u) LEFT JOIN f USING (run_id) GROUP BY run_id""")
def g6(spark, sf):
    units = table(spark, sf, "tool_calls").selectExpr("session_id AS run_id", "seq AS place", "CASE WHEN tool_kind IS NULL THEN 'no kind' WHEN duration_ms IS NULL THEN 'no time' END AS gap")
    return g.telemetry_gaps(units).withColumn("gaps", F.array_join("gaps", ","))


@query("g13_invocation_outcome", f"{EXECUTIONS} SELECT execution_id, coalesce(outcome, CASE WHEN ended_at IS NULL THEN 'running' ELSE 'unknown' END) AS shown_outcome FROM executions")
def g13(spark, sf):
    return g.invocation_outcome(executions(spark, sf)).select("execution_id", "shown_outcome")
