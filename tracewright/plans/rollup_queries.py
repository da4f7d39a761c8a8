"""Queries of the dashboard rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import rollups as r
from tracewright.plans.adapters import cte, table
from tracewright.plans.registry import query

def since():
    return F.expr("TIMESTAMP_NTZ '2000-06-01 00:00:00'")

TOP = "(agent <> 'claude-code' OR coalesce(parent_session_id, '') = '')"
REPO = "coalesce(nullif(git_remote, ''), nullif(cwd_raw, ''), nullif(cwd, ''), nullif(project, ''))"
D1 = "SELECT project, count(*) AS sessions, sum(turn_count)::BIGINT AS turns, sum(tool_call_count)::BIGINT AS tool_calls, sum(error_count)::BIGINT AS errors FROM sessions WHERE project IS NOT NULL GROUP BY project"
D2 = """SELECT project, coalesce(tool_kind, 'other') AS tool_kind, count(*) AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (duration_ms >= 0) AS timed, coalesce(sum(duration_ms) FILTER (duration_ms >= 0), 0)::BIGINT AS total_ms,
  CASE WHEN count(*) FILTER (duration_ms >= 0) > 0 THEN ((sum(duration_ms) FILTER (duration_ms >= 0) + count(*) FILTER (duration_ms >= 0) // 2) // count(*) FILTER (duration_ms >= 0))::BIGINT END AS avg_ms
  FROM tool_calls JOIN sessions USING (agent, session_id) WHERE project IS NOT NULL GROUP BY ALL"""


def _tables(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query("d1_project_metrics", f"{cte('sessions')} {D1}")
def d1(spark, sf):
    return r.project_metrics(table(spark, sf, "sessions"))


@query("d2_tool_stats", f"{cte('sessions', 'tool_calls')} {D2}")
def d2(spark, sf):
    return r.tool_stats(*_tables(spark, sf, "sessions", "tool_calls"))


@query("d3_commits_by_project", f"{cte('sessions', 'commits')} SELECT s.project, count(*) AS commits FROM commits c JOIN sessions s USING (agent, session_id) WHERE s.project IS NOT NULL GROUP BY 1")
def d3(spark, sf):
    return r.count_by_project(*_tables(spark, sf, "sessions", "commits"), "commits")


@query("d4_activity_sessions", f"{cte('sessions')} SELECT agent, session_id, {REPO} AS repo, start_time FROM sessions WHERE {TOP} AND start_time >= TIMESTAMP '2000-06-01'")
def d4(spark, sf):
    return r.activity_sessions(table(spark, sf, "sessions"), since())


@query("d5_activity_commits", f"{cte('commits')} SELECT agent, session_id, commit_hash, subject, coalesce(nullif(git_remote, ''), nullif(cwd, '')) AS repo, committed_at FROM commits WHERE committed_at >= TIMESTAMP '2000-06-01'")
def d5(spark, sf):
    return r.activity_commits(table(spark, sf, "commits"), since())


@query(
    "d6_activity_repos",
    f"""{cte('sessions', 'commits')},
s AS (SELECT coalesce({REPO}, 'unknown') AS repo, count(*) AS n FROM sessions WHERE {TOP} AND start_time >= TIMESTAMP '2000-06-01' GROUP BY 1),
c AS (SELECT coalesce(nullif(git_remote, ''), nullif(cwd, ''), 'unknown') AS repo, count(*) AS n FROM commits WHERE committed_at >= TIMESTAMP '2000-06-01' GROUP BY 1)
SELECT coalesce(s.repo, c.repo) AS repo, coalesce(s.n, 0) AS sessions, coalesce(c.n, 0) AS commits FROM s FULL JOIN c ON s.repo = c.repo""",
)
def d6(spark, sf):
    return r.activity_repos(*_tables(spark, sf, "sessions", "commits"), since())


NORMAL = "lower(CASE WHEN starts_with(x, 'git@') THEN regexp_replace(regexp_replace(x, '^git@', ''), '^([^:]*):', '\\1/') WHEN starts_with(x, 'ssh://') THEN regexp_replace(x, '^ssh://(git@)?', '') ELSE regexp_replace(x, '^https?://', '') END)"
IDENTITY = f"""i AS (SELECT *, coalesce('remote:' || nullif({NORMAL}, ''), 'cwd:' || nullif(cwd_raw, ''), 'slug:' || slug) AS identity FROM (
  SELECT *, regexp_replace(regexp_replace(trim(coalesce(git_remote, '')), '\\.git$', ''), '/$', '') AS x, regexp_replace(project, '--claude-worktrees-.*$', '') AS slug, nullif(regexp_extract(project, '--claude-worktrees-(.*)$', 1), '') AS worktree FROM sessions))"""


@query(
    "d7_identity_rollup",
    f"""{cte('sessions')}, {IDENTITY}
SELECT identity, array_to_string(list_sort(list(DISTINCT agent)), ',') AS agents, coalesce(array_to_string(list_sort(list(DISTINCT slug) FILTER (slug IS NOT NULL)), ','), '') AS slugs, coalesce(array_to_string(list_sort(list(DISTINCT worktree) FILTER (worktree IS NOT NULL)), ','), '') AS worktrees, count(*) AS sessions, sum(source_size)::BIGINT AS bytes, max(start_time) AS last_activity
FROM i WHERE identity IS NOT NULL GROUP BY identity""",
)
def d7(spark, sf):
    got = r.identity_rollup(table(spark, sf, "sessions"))
    return got.select("identity", *(F.array_join(c, ",").alias(c) for c in ("agents", "slugs", "worktrees")), "sessions", "bytes", "last_activity")


SLUGS = "slugs AS (SELECT DISTINCT identity, project AS slug FROM i WHERE identity IS NOT NULL AND project IS NOT NULL)"
D8 = f"""t AS ({D2}), m AS (SELECT identity, tool_kind, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(timed)::BIGINT AS timed, sum(total_ms)::BIGINT AS total_ms FROM t JOIN slugs ON project = slug GROUP BY ALL),
d8 AS (SELECT *, CASE WHEN timed > 0 THEN ((total_ms + timed // 2) // timed)::BIGINT END AS avg_ms FROM m)"""


def _merged(spark, sf):
    sessions, calls = _tables(spark, sf, "sessions", "tool_calls")
    slugs = sessions.select(r.identity_key().alias("identity"), F.col("project").alias("slug")).where("identity is not null and slug is not null").distinct()
    return r.merge_tools(r.tool_stats(sessions, calls), slugs)


@query("d8_identity_tool_merge", f"{cte('sessions', 'tool_calls')}, {IDENTITY}, {SLUGS}, {D8} SELECT * FROM d8")
def d8(spark, sf):
    return _merged(spark, sf)


@query("d15_top_tools", f"{cte('sessions', 'tool_calls')}, {IDENTITY}, {SLUGS}, {D8} SELECT *, row_number() OVER (PARTITION BY identity ORDER BY calls DESC, tool_kind)::INT AS rank FROM d8 QUALIFY rank <= 6")
def d15(spark, sf):
    return r.top_tools(_merged(spark, sf))


def _d9(key: str) -> None:
    order = ", ".join(r.PROJECT_SORTS[key])

    @query(f"d9_projects_by_{key}", f"{cte('sessions')} SELECT *, row_number() OVER (ORDER BY {order})::INT AS place FROM ({D1})")
    def f(spark, sf):
        return r.ranked(r.project_metrics(table(spark, sf, "sessions")), r.PROJECT_SORTS[key])


for _key in r.PROJECT_SORTS:
    _d9(_key)


def _d9_identities(key: str) -> None:
    order = ", ".join(r.IDENTITY_SORTS[key])

    @query(
        f"d9_identities_by_{key}",
        f"""{cte('sessions')}, {IDENTITY}, d AS (SELECT identity, array_to_string(list_sort(list(DISTINCT agent)), ',') AS agents, sum(source_size)::BIGINT AS bytes, max(start_time) AS last_activity FROM i WHERE identity IS NOT NULL GROUP BY identity)
SELECT *, row_number() OVER (ORDER BY {order})::INT AS place FROM d""",
    )
    def f(spark, sf):
        got = r.identity_rollup(table(spark, sf, "sessions")).select("identity", F.array_join("agents", ",").alias("agents"), "bytes", "last_activity")
        return r.ranked(got, r.IDENTITY_SORTS[key])


for _key in r.IDENTITY_SORTS:
    _d9_identities(_key)


@query("d10_ticket_summary", f"{cte('tickets')} SELECT 'status' AS dimension, status AS value, count(*) AS tickets FROM tickets GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM tickets GROUP BY ALL UNION ALL SELECT 'priority', priority::VARCHAR, count(*) FROM tickets GROUP BY ALL")
def d10(spark, sf):
    return r.ticket_summary(table(spark, sf, "tickets"))


@query("d10_next_tickets", f"{cte('tickets')} SELECT status, row_number() OVER (PARTITION BY status ORDER BY priority, created, id)::INT AS rank, id, priority FROM tickets WHERE status IN ('open', 'ready') QUALIFY rank <= 5")
def d10b(spark, sf):
    return r.next_tickets(table(spark, sf, "tickets"))


@query("d11_ticket_activity", f"{cte('tickets')} SELECT id, 'created' AS event, created AS at FROM tickets WHERE created >= TIMESTAMP '1999-01-20' UNION ALL SELECT id, 'closed', closed FROM tickets WHERE closed >= TIMESTAMP '1999-01-20'")
def d11(spark, sf):
    return r.ticket_activity(table(spark, sf, "tickets"), F.expr("TIMESTAMP_NTZ '1999-01-20 00:00:00'"))


@query("d14_top_level_sessions", f"{cte('sessions')} SELECT agent, session_id FROM sessions WHERE {TOP}")
def d14(spark, sf):
    return r.top_level(table(spark, sf, "sessions")).select("agent", "session_id")
