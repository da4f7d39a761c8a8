"""Queries of friction ranking and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.scalars import friction_signature
from tracewright.operators import friction as m
from tracewright.plans.adapters import cte, table
from tracewright.plans.registry import query
from tracewright.plans.rollup_queries import NORMAL

SIGNATURE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(message, chr(10), 1), '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '(?i)\bpid[ =:]*\d+', 'pid <pid>', 'g'), '(^|[^A-Za-z0-9_.~-])(~?/[^\s"'')]+)', '\1<path>', 'g'), '\d{3,}', '<n>', 'g'), '\s+', ' ', 'g'))"""
RANK = f"""SELECT kind, signature, count(*) AS events, count(DISTINCT ts::DATE) AS active_days, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_sort(list(DISTINCT session_id)), ',') AS sessions,
  CASE WHEN count(DISTINCT ts::DATE) > 0 THEN count(*) / count(DISTINCT ts::DATE) ELSE 0.0 END AS per_active_day FROM f GROUP BY kind, signature"""


def events(spark, sf):
    return table(spark, sf, "friction").withColumn("signature", friction_signature(F.col("message")))


@query("m1_friction_rank", f"{cte('friction')}, f AS (SELECT *, {SIGNATURE} AS signature FROM friction) {RANK}")
def m1(spark, sf):
    return m.friction_rank(events(spark, sf)).withColumn("sessions", F.array_join("sessions", ","))


@query("m1_friction_top", f"{cte('friction')}, f AS (SELECT *, {SIGNATURE} AS signature FROM friction) SELECT kind, signature, events, active_days FROM ({RANK}) ORDER BY per_active_day DESC, events DESC, signature, kind LIMIT 10")
def m1_top(spark, sf):
    return m.friction_rank(events(spark, sf), 10).select("kind", "signature", "events", "active_days")


@query("c6_friction_signature", f"{cte('friction')} SELECT session_id, message, {SIGNATURE} AS signature FROM friction")
def c6(spark, sf):
    return events(spark, sf).select("session_id", "message", "signature")


@query("m4_session_sources", f"{cte('sessions')} SELECT agent, session_id, cwd, start_time FROM sessions WHERE start_time >= TIMESTAMP '2000-01-01' AND cwd IS NOT NULL AND parent_session_id IS NULL")
def m4(spark, sf):
    return m.session_sources(table(spark, sf, "sessions"), F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"))


SCOPES = "scopes AS (SELECT DISTINCT 'repo' || CAST(n_nationkey AS VARCHAR) AS scope FROM nation WHERE n_nationkey % 3 <> 0)"
MARKERS = "markers AS (SELECT '/work/p' || CAST(n_nationkey AS VARCHAR) AS cwd, 'repo' || CAST(n_nationkey * 2 AS VARCHAR) AS marked FROM nation WHERE n_nationkey % 4 = 1)"
REMOTE = f"(SELECT {NORMAL} FROM (SELECT regexp_replace(regexp_replace(trim(coalesce(git_remote, '')), '\\.git$', ''), '/$', '') AS x))"
RESOLVED = f"""{SCOPES}, {MARKERS}, g AS (SELECT s.*, nullif({REMOTE}, '') AS remote, coalesce(marked, nullif(regexp_extract({REMOTE}, '([^/]+)$', 1), '')) AS guess FROM sessions s LEFT JOIN markers USING (cwd)),
resolved AS (SELECT g.*, scope FROM g LEFT JOIN scopes ON guess = scope)"""


def scopes(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 3 <> 0").selectExpr("'repo' || CAST(n_nationkey AS STRING) AS scope").distinct()


def resolved(spark, sf):
    markers = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 4 = 1").selectExpr("'/work/p' || CAST(n_nationkey AS STRING) AS cwd", "'repo' || CAST(n_nationkey * 2 AS STRING) AS scope")
    return m.resolve_scope(table(spark, sf, "sessions"), markers, scopes(spark, sf))


@query("m6_resolve_scope", f"{cte('sessions')}, {RESOLVED} SELECT agent, session_id, scope FROM resolved")
def m6(spark, sf):
    return resolved(spark, sf).select("agent", "session_id", "scope")


@query("m7_scope_collisions", f"{cte('sessions')}, {RESOLVED} SELECT scope, count(DISTINCT remote) AS remotes FROM resolved WHERE scope IS NOT NULL GROUP BY scope HAVING count(DISTINCT remote) > 1")
def m7(spark, sf):
    return m.scope_collisions(resolved(spark, sf))


@query("m16_scope_status", f"{cte('sessions')}, {RESOLVED} SELECT s.scope, count(r.session_id) AS sessions, count(DISTINCT remote) AS remotes, count(DISTINCT remote) > 1 AS collides FROM scopes s LEFT JOIN resolved r ON s.scope = r.scope GROUP BY s.scope")
def m16(spark, sf):
    return m.scope_status(scopes(spark, sf), resolved(spark, sf))


@query(
    "m5_plan_backfill",
    f"""{cte('sessions')}, {RESOLVED}, v AS (SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR) AS session_id FROM lineitem WHERE l_partkey % 10 = 0),
q AS (SELECT agent, r.session_id, start_time, CASE WHEN v.session_id IS NOT NULL THEN 'visited' WHEN agent NOT IN ('claude-code', 'codex-cli') THEN 'agent' WHEN turn_count < 3 THEN 'min-turns' WHEN cwd IS NULL THEN 'unreadable' WHEN start_time >= TIMESTAMP '2001-01-01' THEN 'active' WHEN scope IS NULL THEN 'no-scope' END AS reason FROM resolved r LEFT JOIN v ON r.session_id = v.session_id),
p AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY start_time DESC, agent, session_id)::INT AS n FROM q)
SELECT agent, session_id, CASE WHEN reason IS NULL AND n > 50 THEN 'limit' ELSE reason END AS reason, CASE WHEN reason IS NULL AND n <= 50 THEN n END AS place FROM p""",
)
def m5(spark, sf):
    visited = table(spark, sf, "sessions").select("agent", "session_id").join(spark.read.parquet(f"{sf}/lineitem.parquet").where("l_partkey % 10 = 0").selectExpr("'o' || CAST(l_orderkey AS STRING) AS session_id").distinct(), "session_id", "left_semi")
    return m.plan_backfill(resolved(spark, sf), visited, scopes(spark, sf), 3, F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"), ["claude-code", "codex-cli"], 50)


STAMPS = "stamps AS (SELECT '/work/p' || CAST(o_custkey % 20 AS VARCHAR) AS work_root, 'cwd-' || CAST(o_orderkey AS VARCHAR) AS project_cwd, o_orderdate AS stamped_at FROM orders)"


@query("m8_stamp_asof", f"{cte('sessions')}, {STAMPS} SELECT agent, session_id, arg_max(project_cwd, (stamped_at, project_cwd)) AS project_cwd, max(stamped_at) AS stamped_at FROM sessions s LEFT JOIN stamps t ON s.cwd = t.work_root AND (start_time IS NULL OR stamped_at <= start_time) GROUP BY agent, session_id")
def m8(spark, sf):
    stamps = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("'/work/p' || CAST(o_custkey % 20 AS STRING) AS work_root", "'cwd-' || CAST(o_orderkey AS STRING) AS project_cwd", "o_orderdate AS stamped_at")
    return m.stamp_asof(table(spark, sf, "sessions"), stamps)


@query("m14_liveness", f"{cte('commits')} SELECT {REMOTE} AS project, max(committed_at) AS last_commit, coalesce(date_diff('day', max(committed_at)::DATE, DATE '2001-09-10') > 60, true) AS inert FROM commits WHERE git_remote <> '' GROUP BY 1")
def m14(spark, sf):
    return m.liveness(table(spark, sf, "commits"), F.lit("2001-09-10").cast("date"))


@query("m15_evidence_missing", f"{cte('tool_calls')} SELECT DISTINCT session_id AS id, key_arg AS path FROM tool_calls WHERE key_arg NOT IN (SELECT '/src/m' || CAST(n_nationkey AS VARCHAR) || '.py' FROM nation)")
def m15(spark, sf):
    evidence = table(spark, sf, "tool_calls").select(F.col("session_id").alias("id"), F.col("key_arg").alias("path")).distinct()
    return m.evidence_missing(evidence, spark.read.parquet(f"{sf}/nation.parquet").selectExpr("'/src/m' || CAST(n_nationkey AS STRING) || '.py' AS path"))


DRAFTS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'truth' WHEN 1 THEN 'decision' WHEN 2 THEN 'ticket' ELSE 'note' END AS kind, CASE WHEN p_size % 2 = 0 THEN '## Claim ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '## How to verify ' ELSE '' END || CASE WHEN p_size % 5 < 3 THEN '## Problem' ELSE '' END AS body, CASE p_size % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'epic' WHEN 2 THEN 'task' END AS ticket_type, CASE WHEN p_size % 3 <> 0 THEN 'repo' || CAST(p_size AS {s}) END AS declared, 'repo' || CAST(p_partkey % 9 AS {s}) AS requested FROM part"


def drafts(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("draft_part")
    return spark.sql(DRAFTS.replace("FROM part", "FROM draft_part").format(s="STRING"))


@query("m9_route_destination", f"""WITH d AS ({DRAFTS.format(s='VARCHAR')}), e AS (SELECT *, CASE WHEN kind IN ('truth', 'decision') AND contains(body, '## Claim') AND contains(body, '## How to verify') THEN kind WHEN kind = 'ticket' AND contains(body, '## Problem') AND ticket_type IN ('bug', 'feature', 'task', 'chore') THEN 'ticket' END AS destination FROM d)
SELECT id, destination, CASE WHEN destination IS NOT NULL THEN NULL WHEN kind IN ('truth', 'decision') THEN 'sections missing' WHEN kind = 'ticket' THEN 'problem or type missing' ELSE 'unknown kind' END AS dropped FROM e""")
def m9(spark, sf):
    return m.route_destination(drafts(spark, sf)).select("id", "destination", "dropped")


@query("m10_route_scope", f"WITH {SCOPES}, d AS ({DRAFTS.format(s='VARCHAR')}) SELECT id, coalesce(s.scope, requested) AS scope, CASE WHEN declared IS NOT NULL AND s.scope IS NULL THEN 'unknown scope ' || declared END AS note FROM d LEFT JOIN scopes s ON declared = s.scope")
def m10(spark, sf):
    return m.route_scope(drafts(spark, sf), scopes(spark, sf)).select("id", "scope", "note")
