"""Queries of bug attribution, project state and run reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions.tables import new_path, written
from tracewright.operators import attribution as a
from tracewright.operators import run_report as g
from tracewright.plans.adapters import cte, table
from tracewright.plans.registry import query
from tracewright.plans.run_queries import EXECUTIONS, TREE, executions
from tracewright.operators import registry_runs
from tracewright.sources.files import current_state, replace_state
from tracewright.streaming.streams import events_stream, project_states

MARK = r"coalesce(nullif(regexp_extract(subject, '^\[([^\] \t]+)\]', 1), ''), nullif(regexp_extract(subject, '\[([^\[\] \t]+)\]$', 1), ''))"
BUGS = "bugs AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'ns/' ELSE '' END || 'tk-' || CAST(p_partkey AS {s}) AS ticket FROM {t} WHERE p_partkey % 5 < 3)"
FIXES = "fixes AS (SELECT DISTINCT ticket, commit_hash, session_id FROM (SELECT *, " + MARK + " AS marker FROM commits) c JOIN (SELECT ticket, ticket AS m FROM bugs UNION SELECT ticket, regexp_replace(ticket, '^[^/]*/', '') FROM bugs) i ON c.marker = i.m)"
BLAME = "blame AS (SELECT f.ticket, substring(md5(CAST(l_orderkey AS {s})), 1, 12) AS introducing_hash, CASE WHEN l_linenumber = 7 THEN 'tests/golden/x' || CAST(l_linenumber AS {s}) || '.go' WHEN l_linenumber = 6 THEN 'vendor/tests/golden/y.lock' ELSE '/src/m' || CAST(l_partkey % 50 AS {s}) || '.py' END AS path FROM {t} l JOIN fixes f ON f.session_id = 'o' || CAST(l_suppkey * 2 AS {s}))"
ROLL = r"""roll AS (SELECT ticket, introducing_hash, count(*) AS lines FROM blame b WHERE NOT starts_with(path, 'tests/golden/') AND NOT EXISTS (SELECT 1 FROM fixes x WHERE x.ticket = b.ticket AND x.commit_hash = b.introducing_hash) GROUP BY ALL),
n AS (SELECT ticket, count(*) AS commits FROM roll GROUP BY 1), nf AS (SELECT ticket, count(*) AS fixes FROM fixes GROUP BY 1),
att AS (SELECT b.ticket, coalesce(n.commits, 0) AS commits, CASE WHEN coalesce(n.commits, 0) = 1 THEN 'single' WHEN n.commits > 1 THEN 'multi' ELSE 'unattributable' END AS class, CASE WHEN n.commits IS NULL THEN CASE WHEN nf.fixes IS NULL THEN 'no fix commit' ELSE 'no blamed lines' END END AS reason FROM bugs b LEFT JOIN n USING (ticket) LEFT JOIN nf USING (ticket))"""
FULL = f"{cte('commits')}, {BUGS.format(s='VARCHAR', t='part')}, {FIXES}, {BLAME.format(s='VARCHAR', t='lineitem')}, {ROLL}"


def bugs(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("bug_part")
    return spark.sql(f"WITH {BUGS.format(s='STRING', t='bug_part')} SELECT * FROM bugs")


def fixes(spark, sf):
    return a.fix_commits(table(spark, sf, "commits"), bugs(spark, sf))


def rollup(spark, sf):
    f = fixes(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("'o' || CAST(l_suppkey * 2 AS STRING) AS session_id", "substring(md5(CAST(l_orderkey AS STRING)), 1, 12) AS introducing_hash", "CASE WHEN l_linenumber = 7 THEN 'tests/golden/x' || CAST(l_linenumber AS STRING) || '.go' WHEN l_linenumber = 6 THEN 'vendor/tests/golden/y.lock' ELSE '/src/m' || CAST(l_partkey % 50 AS STRING) || '.py' END AS path")
    return a.blame_rollup(lines.join(f, "session_id").select("ticket", "introducing_hash", "path"), f)


def attributed(spark, sf):
    n = fixes(spark, sf).groupBy("ticket").agg(F.count("*").alias("fixes"))
    b = bugs(spark, sf).join(n, "ticket", "left").withColumn("fixes", F.coalesce("fixes", F.lit(0)))
    return a.attribute(b, rollup(spark, sf))


@query("c4_ticket_marker", f"{cte('commits')} SELECT session_id, subject, {MARK} AS marker FROM commits")
def c4(spark, sf):
    return a.with_marker(table(spark, sf, "commits")).select("session_id", "subject", "marker")


@query("i1_fix_commits", f"{cte('commits')}, {BUGS.format(s='VARCHAR', t='part')}, {FIXES} SELECT * FROM fixes")
def i1(spark, sf):
    return fixes(spark, sf)


@query("i2_resolve_short_hash", f"{cte('commits')}, s AS (SELECT DISTINCT substring(md5(CAST(l_orderkey AS VARCHAR)), 1, 5 + l_linenumber) AS short_hash FROM lineitem), h AS (SELECT DISTINCT commit_hash FROM commits) SELECT short_hash, CASE WHEN count(commit_hash) = 1 THEN min(commit_hash) END AS hash FROM s LEFT JOIN h ON len(short_hash) >= 7 AND substring(commit_hash, 1, 7) = substring(short_hash, 1, 7) AND starts_with(commit_hash, short_hash) GROUP BY short_hash")
def i2(spark, sf):
    short = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("substring(md5(CAST(l_orderkey AS STRING)), 1, 5 + l_linenumber) AS short_hash")
    return a.resolve_short(short, table(spark, sf, "commits").select(F.col("commit_hash").alias("hash")))


@query("i3_commit_owner_session", f"{cte('commits')} SELECT commit_hash, agent, session_id, committed_at FROM commits QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY committed_at NULLS LAST, agent, session_id) = 1")
def i3(spark, sf):
    return a.first_owner(table(spark, sf, "commits"))


@query("i4_blame_rollup", f"{FULL} SELECT * FROM roll")
def i4(spark, sf):
    return rollup(spark, sf)


@query("i5_attribute_bugs", f"{FULL} SELECT * FROM att")
def i5(spark, sf):
    return attributed(spark, sf)


@query("i6_credit_slices", f"{FULL}, w AS (SELECT commit_hash, agent, coalesce(model, '') AS model, coalesce(cli_version, '') AS cli_version FROM commits QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY committed_at NULLS LAST, agent, session_id) = 1), s AS (SELECT introducing_hash, sum(1.0::DOUBLE / commits) AS credit FROM roll JOIN att USING (ticket) GROUP BY 1) SELECT agent, model, cli_version, count(*) AS commits, count(credit) AS introducing, round(coalesce(sum(credit), 0.0::DOUBLE), 6) AS credit, round(count(credit) / count(*), 6) AS rate FROM w LEFT JOIN s ON commit_hash = introducing_hash GROUP BY ALL")
def i6(spark, sf):
    owners = a.first_owner(table(spark, sf, "commits"), "model", "cli_version")
    return a.credit_slices(rollup(spark, sf), attributed(spark, sf), owners).select("agent", "model", "cli_version", "commits", "introducing", F.round("credit", 6).alias("credit"), F.round("rate", 6).alias("rate"))


@query("i7_attribution_precision", f"{FULL}, lab AS (SELECT ticket, min(introducing_hash) AS h FROM roll GROUP BY 1 HAVING length(ticket) % 2 = 0 UNION ALL SELECT ticket, 'none' FROM roll GROUP BY 1 HAVING length(ticket) % 2 = 1) SELECT count(*) AS labelled, count(*) FILTER (h = introducing_hash) AS right, count(*) FILTER (h = introducing_hash) / nullif(count(*), 0) AS precision FROM att JOIN roll USING (ticket) JOIN lab USING (ticket) WHERE class = 'single'")
def i7(spark, sf):
    roll = rollup(spark, sf)
    labels = roll.groupBy("ticket").agg(F.array(F.when(F.length("ticket") % 2 == 0, F.min("introducing_hash")).otherwise("none")).alias("introducing"))
    return a.precision(roll, attributed(spark, sf), labels)


@query("i8_class_counts", f"{FULL} SELECT class, reason, count(*) AS bugs FROM att GROUP BY ALL")
def i8(spark, sf):
    return a.class_counts(attributed(spark, sf))


@query("i9_commit_owner_parent", f"{cte('commits', 'sessions')} SELECT c.agent, coalesce(s.parent_session_id, s.session_id) AS owner, commit_hash FROM commits c JOIN sessions s USING (agent, session_id) WHERE EXISTS (SELECT 1 FROM sessions p WHERE p.agent = c.agent AND p.session_id = coalesce(s.parent_session_id, s.session_id))")
def i9(spark, sf):
    return a.owner_parent(table(spark, sf, "commits"), table(spark, sf, "sessions"))


WANTED = "wanted AS (SELECT DISTINCT 'tk-' || CAST(n_nationkey * 4 AS VARCHAR) AS ticket FROM nation)"


def wanted(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr("'tk-' || CAST(n_nationkey * 4 AS STRING) AS ticket").distinct()


@query("i10_sessions_for_tickets", f"{cte('commits')}, {WANTED} SELECT agent, session_id, min(committed_at) AS first_commit FROM (SELECT *, {MARK} AS marker FROM commits) WHERE marker IN (SELECT ticket FROM wanted) GROUP BY ALL")
def i10(spark, sf):
    return a.sessions_for_tickets(table(spark, sf, "commits"), wanted(spark, sf))


@query("i11_epic_expansion", f"{cte('tickets')}, {WANTED} SELECT ticket FROM wanted UNION SELECT id FROM tickets WHERE parent IN (SELECT ticket FROM wanted)")
def i11(spark, sf):
    return a.expand_epics(wanted(spark, sf), table(spark, sf, "tickets"))


A, B = "TIMESTAMP '1999-06-01 00:00:00'", "TIMESTAMP '1999-09-01 00:00:00'"


def bounds():
    return F.expr("TIMESTAMP_NTZ '1999-06-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1999-09-01 00:00:00'")


SCOPE_COMMITS = f"sc AS (SELECT CASE WHEN contains({MARK}, '/') THEN split_part({MARK}, '/', 1) ELSE s.project END AS scope, commit_hash, committed_at FROM commits c JOIN sessions s USING (agent, session_id))"
SCOPE_TICKETS = "st AS (SELECT CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE 'proj-' || CAST(priority AS VARCHAR) END AS scope, status, closed FROM tickets)"


STATE = f"""{cte('commits', 'sessions', 'tickets')}, {SCOPE_COMMITS}, {SCOPE_TICKETS}, scopes AS (SELECT 'ns' AS scope UNION SELECT project FROM sessions WHERE project IS NOT NULL),
c AS (SELECT scope, count(*) FILTER (m >= {A} AND m < {B}) AS n, max(m) AS last FROM (SELECT scope, commit_hash, min(committed_at) AS m FROM sc GROUP BY ALL) GROUP BY scope),
s AS (SELECT project AS scope, count(*) FILTER (coalesce(end_time, start_time) >= {A} AND start_time < {B}) AS n, max(coalesce(end_time, start_time)) AS last FROM sessions GROUP BY 1),
t AS (SELECT scope, count(*) FILTER (status <> 'closed') AS open, count(*) FILTER (closed >= {A} AND closed < {B}) AS n, max(closed) AS last FROM st GROUP BY 1)
SELECT scope, coalesce(c.n, 0) AS commits_in_window, coalesce(s.n, 0) AS sessions_in_window, coalesce(t.open, 0) AS open_tickets, coalesce(t.n, 0) AS tickets_closed_in_window, c.last AS last_commit_at, s.last AS last_session_at, t.last AS last_ticket_closed_at, coalesce(c.n, 0) = 0 AND coalesce(s.n, 0) = 0 AND coalesce(t.n, 0) = 0 AS dormant
FROM scopes LEFT JOIN c USING (scope) LEFT JOIN s USING (scope) LEFT JOIN t USING (scope)"""


@query("j1_project_state", STATE)
def j1(spark, sf):
    sessions = table(spark, sf, "sessions").withColumn("scope", F.col("project"))
    marked = a.with_marker(table(spark, sf, "commits")).join(sessions.select("agent", "session_id", "project"), ["agent", "session_id"])
    commits = marked.withColumn("scope", F.when(F.instr("marker", "/") > 0, F.substring_index("marker", "/", 1)).otherwise(F.col("project")))
    tickets = table(spark, sf, "tickets").withColumn("scope", F.when(F.instr("id", "/") > 0, F.substring_index("id", "/", 1)).otherwise(F.concat(F.lit("proj-"), F.col("priority").cast("string"))))
    scopes = sessions.where("project is not null").select("scope").union(spark.range(1).select(F.lit("ns").alias("scope"))).distinct()
    return a.project_state(scopes, commits, sessions, tickets, *bounds())


@query("j6_replace_state", STATE)
def j6(spark, sf):
    path, state = new_path(spark, "j6"), j1(spark, sf)
    replace_state(state.where("dormant"), path, 0)
    replace_state(state, path, 1)
    return current_state(spark, path)


@query("p5_stream_project_state", STATE)
def p5(spark, sf):
    return project_states(events_stream(spark, sf).select("event_id"), lambda: j1(spark, sf))



@query("j2_session_window_overlap", f"{cte('sessions')} SELECT agent, session_id FROM sessions WHERE coalesce(end_time, start_time) >= {A} AND start_time < {B}")
def j2(spark, sf):
    since, until = bounds()
    return table(spark, sf, "sessions").where((F.coalesce("end_time", "start_time") >= since) & (F.col("start_time") < until)).select("agent", "session_id")


@query("j3_ticket_signals", f"""{cte('tickets')}, f AS (SELECT id, coalesce(created >= {A} AND created < {B}, false) AS n, coalesce(closed >= {A} AND closed < {B}, false) AS d, coalesce(updated >= {A} AND updated < {B}, false) AS u FROM tickets)
SELECT id, concat_ws(',', CASE WHEN n THEN 'new' END, CASE WHEN d THEN 'done' END, CASE WHEN NOT n AND NOT d AND u THEN 'edited' END) AS signals FROM f WHERE n OR d OR u""")
def j3(spark, sf):
    return a.ticket_signals(table(spark, sf, "tickets"), F.expr("TIMESTAMP_NTZ '1999-06-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1999-09-01 00:00:00'")).withColumn("signals", F.array_join("signals", ","))


@query("j4_ticket_sessions", f"""{cte('commits', 'sessions')}, m AS (SELECT {MARK} AS ticket, agent, session_id, array_to_string(list_sort(list(DISTINCT commit_hash)), '+') AS c FROM commits WHERE {MARK} IS NOT NULL GROUP BY ALL)
SELECT ticket, count(*) AS sessions, string_agg(session_id || ':' || c, ',' ORDER BY start_time NULLS LAST, agent, session_id) AS "order" FROM m JOIN sessions USING (agent, session_id) GROUP BY ticket""")
def j4(spark, sf):
    return a.ticket_sessions(table(spark, sf, "commits"), table(spark, sf, "sessions")).withColumn("order", F.array_join("order", ","))


@query("j5_unticketed_sessions", f"{cte('commits', 'sessions')} SELECT agent, session_id, start_time FROM sessions s WHERE coalesce(end_time, start_time) >= {A} AND start_time < {B} AND NOT EXISTS (SELECT 1 FROM commits c WHERE c.agent = s.agent AND c.session_id = s.session_id AND {MARK} IS NOT NULL)")
def j5(spark, sf):
    return a.unticketed(table(spark, sf, "sessions"), table(spark, sf, "commits"), *bounds())


CHECKOUTS = "SELECT '/work' || CASE WHEN n_nationkey % 2 = 0 THEN '/p' || CAST(n_nationkey AS {s}) ELSE '' END AS path, 'ns' || CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 99 END AS {s}) AS namespace FROM {t}"


@query("j7_cwd_namespace", f"{cte('sessions')}, k AS (SELECT DISTINCT * FROM ({CHECKOUTS.format(s='VARCHAR', t='nation')})) SELECT agent, session_id, arg_max(namespace, length(path)) AS namespace FROM sessions LEFT JOIN k ON cwd = path OR starts_with(cwd, path || '/') GROUP BY ALL")
def j7(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("checkout_nation")
    return a.cwd_namespace(table(spark, sf, "sessions"), spark.sql(CHECKOUTS.format(s="STRING", t="checkout_nation")).distinct())


UNITS = f"{EXECUTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TREE}"


def units(spark, sf):
    """Executions with their kind, records and state and, where they are placed, their depth."""
    return registry_runs.build_tree(executions(spark, sf), trail=(), keep=("execution_kind", "records"))


@query("g5_meter_scopes", f"""{UNITS}, u AS (SELECT e.*, b.depth, CASE WHEN b.depth = 0 OR execution_kind = 'human' THEN 'parent' ELSE 'descendants' END AS part FROM executions e JOIN built b USING (run_id, execution_id) WHERE state = 'placed')
SELECT run_id, coalesce(part, 'total') AS scope, count(*) AS units, sum(records)::BIGINT AS records FROM u GROUP BY GROUPING SETS ((run_id, part), (run_id))""")
def g5(spark, sf):
    return g.meter_scopes(units(spark, sf).where("state = 'placed'"), ["records"])


@query("g4_meter_tokens", f"""{cte('tool_calls')}, t AS (SELECT session_id AS run_id, agent, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens FROM tool_calls GROUP BY ALL)
SELECT *, input_tokens + output_tokens + CASE WHEN agent = 'codex-cli' THEN 0 ELSE coalesce(cached_tokens, 0) END AS total_tokens FROM t""")
def g4(spark, sf):
    return g.meter_tokens(table(spark, sf, "tool_calls").withColumn("run_id", F.col("session_id")))


U = "u AS (SELECT session_id || '/a' AS unit, agent, session_id, 2 AS first, 5 AS last FROM sessions WHERE turn_count > 1 UNION ALL SELECT session_id || '/b', agent, session_id, 0, NULL FROM sessions WHERE turn_count IS NULL)"
METER = f"""{cte('sessions', 'tool_calls', 'errors')}, {U}, c AS (SELECT *, (seq + 1)::INT AS turn_idx FROM tool_calls),
t AS (SELECT unit, count(*) AS turns, count(*) FILTER (c.tool_kind IS NOT NULL) AS turns_with_model, 0::BIGINT AS turns_with_effort, count(*) FILTER (duration_ms IS NOT NULL) AS turns_with_cli_version FROM u JOIN c USING (agent, session_id) WHERE turn_idx >= first AND (last IS NULL OR turn_idx <= last) GROUP BY unit),
k AS (SELECT unit, coalesce(tool_kind, 'unknown') AS kind, count(*) AS n, count(*) FILTER (is_error) AS e, count(*) FILTER (duration_ms >= 0) AS timed, sum(duration_ms) FILTER (duration_ms >= 0) AS ms FROM u JOIN c USING (agent, session_id) WHERE turn_idx >= first AND (last IS NULL OR turn_idx <= last) GROUP BY ALL),
kk AS (SELECT unit, sum(n)::BIGINT AS tool_calls, sum(e)::BIGINT AS errored_calls, sum(timed)::BIGINT AS timed_calls, sum(ms)::BIGINT AS tool_ms, string_agg(kind || '=' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS calls_by_kind FROM k GROUP BY unit),
e AS (SELECT unit, count(*) FILTER (source = 'api_error') AS api_failures, count(*) FILTER (source IN ('tool_error', 'exec_error', 'patch_error')) AS tool_failures, count(*) FILTER (source = 'turn_aborted') AS process_failures, count(*) FILTER (source = 'quota') AS other_failures, count(*) FILTER (source = 'stop_hook') AS hook_signals FROM u JOIN errors USING (agent, session_id) WHERE turn_idx >= first AND (last IS NULL OR turn_idx <= last) GROUP BY unit),
metered AS (SELECT unit, coalesce(turns, 0) AS turns, coalesce(turns_with_model, 0) AS turns_with_model, coalesce(turns_with_effort, 0) AS turns_with_effort, coalesce(turns_with_cli_version, 0) AS turns_with_cli_version, coalesce(tool_calls, 0) AS tool_calls, coalesce(errored_calls, 0) AS errored_calls, coalesce(timed_calls, 0) AS timed_calls, tool_ms, coalesce(calls_by_kind, '') AS calls_by_kind, coalesce(api_failures, 0) AS api_failures, coalesce(tool_failures, 0) AS tool_failures, coalesce(process_failures, 0) AS process_failures, coalesce(other_failures, 0) AS other_failures, coalesce(hook_signals, 0) AS hook_signals FROM u LEFT JOIN t USING (unit) LEFT JOIN kk USING (unit) LEFT JOIN e USING (unit))"""


def spanned(spark, sf):
    """The units of sessions with a span of turns."""
    return table(spark, sf, "sessions").where("turn_count > 1").selectExpr("session_id || '/a' AS unit", "agent", "session_id", "2 AS first", "5 AS last")


def metered(spark, sf):
    s = table(spark, sf, "sessions")
    u = spanned(spark, sf).union(s.where("turn_count IS NULL").selectExpr("session_id || '/b'", "agent", "session_id", "0", "CAST(NULL AS INT)"))
    c = table(spark, sf, "tool_calls").withColumn("turn_idx", (F.col("seq") + 1).cast("int"))
    turns = c.selectExpr("agent", "session_id", "turn_idx AS idx", "tool_kind AS model", "'' AS effort", "CAST(duration_ms AS STRING) AS cli_version")
    return g.meter_units(u, turns, c, table(spark, sf, "errors"))


@query("g3_meter_units", f"{METER} SELECT * FROM metered")
def g3(spark, sf):
    return metered(spark, sf)


@query("g11_run_summaries", f"""{METER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {EXECUTIONS.replace('WITH ', '', 1)}, {TREE}, r AS (SELECT DISTINCT run_id FROM executions), n AS (SELECT run_id, count(*) AS units, count(*) FILTER (NOT (b.depth = 0 OR execution_kind = 'human')) AS children FROM executions e JOIN built b USING (run_id, execution_id) WHERE state = 'placed' GROUP BY run_id)
SELECT r.run_id, units, children, api_failures + tool_failures + process_failures + other_failures AS failures FROM r LEFT JOIN n USING (run_id) LEFT JOIN metered ON unit = 'o' || substring(run_id, 2) || '/a'""")
def g11(spark, sf):
    # one fold and one tree give the runs and their units
    tree = written(units(spark, sf).select("run_id", "state", "depth", "execution_kind", "records"), "run-units")
    failures = g.unit_failures(spanned(spark, sf), table(spark, sf, "errors")).withColumn("run_id", F.concat(F.lit("r"), F.regexp_extract("unit", "^o(.*)/a$", 1)))
    return g.run_summaries(tree.select("run_id").distinct(), g.meter_scopes(tree.where("state = 'placed'"), ["records"]), failures)


@query("g14_drift_gaps", "SELECT 's' || CAST(user_id AS VARCHAR) AS session_id, event_type || ':t' || CAST(user_id % 3 AS VARCHAR) || ' count=' || CAST(count(*) AS VARCHAR) AS gap FROM events WHERE user_id % 3 = 2 AND event_type <> 'view' GROUP BY user_id, event_type")
def g14(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CASE WHEN user_id % 3 = 2 THEN 'cursor-cli' ELSE 'codex-cli' END AS agent", "'s' || CAST(user_id AS STRING) AS session_id", "CASE WHEN event_type = 'view' THEN 'usage' ELSE event_type END AS type", "'t' || CAST(user_id % 3 AS STRING) AS subtype")
    return g.drift_gaps(e.groupBy("agent", "session_id", "type", "subtype").agg(F.count("*").alias("count")))


SPAN_RUNS = "SELECT 'q' || CAST(o_orderkey AS {s}) AS run_id, 'a' AS agent, 'k' || CAST(o_custkey AS {s}) AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS idx, o_orderdate AS at, CASE WHEN o_orderkey % 4 = 0 THEN {cut} END AS cutoff FROM {t} WHERE o_orderkey % 5 = 0"
SPAN_TURNS = "SELECT 'a' AS agent, 'k' || CAST(o_custkey AS {s}) AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS idx, o_orderdate AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN {end} END AS ended_at FROM {t}"
SPAN_INVOCATIONS = "SELECT DISTINCT 'a' AS agent, 'k' || CAST(o_custkey AS {s}) AS session_id, i AS idx, i * 3 AS first, CASE i WHEN 0 THEN 2 END AS last FROM {t} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1)"


@query("g2_root_span", f"""WITH r AS ({SPAN_RUNS.format(s='VARCHAR', t='orders', cut='o_orderdate + INTERVAL 400 DAY')}), t AS ({SPAN_TURNS.format(s='VARCHAR', t='orders', end='o_orderdate + INTERVAL 2 DAY')}), i AS ({SPAN_INVOCATIONS.format(s='VARCHAR', t='orders')}),
s AS (SELECT r.*, i.idx IS NOT NULL AS found, coalesce(first, 0) AS low, last FROM r LEFT JOIN i USING (agent, session_id, idx)),
n AS (SELECT s.run_id, bool_or(s."at" > t.started_at AND (t.ended_at IS NULL OR s."at" > t.ended_at)) AS late FROM s JOIN t USING (agent, session_id) WHERE t.idx = s.low GROUP BY 1),
b AS (SELECT s.*, t.idx AS turn, t.started_at, coalesce(found AND late, false) AS narrowed FROM s LEFT JOIN n USING (run_id) JOIN t USING (agent, session_id) WHERE t.idx >= low AND (last IS NULL OR t.idx <= last)),
k AS (SELECT *, (NOT narrowed OR started_at >= "at") AND (cutoff IS NULL OR started_at <= cutoff) AS kept FROM b)
SELECT run_id, min(turn) FILTER (kept) AS first_turn, max(turn) FILTER (kept) AS last_turn, CASE WHEN bool_or(narrowed) THEN 'started_at' WHEN bool_or(found) THEN 'invocation' ELSE 'session' END AS basis, CASE WHEN bool_or(last IS NOT NULL) THEN 'next invocation' ELSE 'session end' END AS "bound" FROM k GROUP BY run_id""")
def g2(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("span_orders")
    got = lambda x, **more: spark.sql(x.format(s="STRING", t="span_orders", **more))
    return g.root_span(got(SPAN_RUNS, cut="o_orderdate + INTERVAL 400 DAY"), got(SPAN_INVOCATIONS), got(SPAN_TURNS, end="o_orderdate + INTERVAL 2 DAY"))


@query("g7_run_time", f"""{EXECUTIONS}, e AS (SELECT run_id, min(started_at) AS a, max(ended_at) AS z, max(last_seen) AS seen, sum((epoch_us(ended_at) - epoch_us(started_at)) // 1000) FILTER (ended_at >= started_at)::BIGINT AS execution_ms, count(*) FILTER (ended_at >= started_at) AS timed, count(*) AS executions FROM executions GROUP BY run_id)
SELECT run_id, CASE WHEN coalesce(z, seen) >= a THEN (epoch_us(coalesce(z, seen)) - epoch_us(a)) // 1000 END AS wall_ms, CASE WHEN z IS NOT NULL THEN 'ended' ELSE 'observed' END AS basis, execution_ms, timed, executions FROM e""")
def g7(spark, sf):
    return g.run_time(executions(spark, sf))


@query("g9_stage_groups", f"""{EXECUTIONS}, o AS (SELECT *, coalesce(CASE WHEN records < 3 THEN records END, 0) AS occurrence, sum(records) OVER (PARTITION BY run_id ORDER BY execution_id DESC) AS place FROM executions) SELECT run_id, coalesce(stage, '') AS stage, occurrence, count(*) AS attempts, string_agg(execution_id, ',' ORDER BY place) AS "order", count(*) - 1 AS retries FROM o WHERE execution_kind = 'subagent' GROUP BY ALL""")
def g9(spark, sf):
    # any order will do for a walk here; it is not that of the starts
    walk = F.sum("records").over(Window.partitionBy("run_id").orderBy(F.desc("execution_id")))
    return g.stage_groups(executions(spark, sf).withColumns({"stage_occurrence": F.when(F.col("records") < 3, F.col("records")), "place": walk, "execution_kind": F.when(F.col("execution_kind") == "subagent", "stage").otherwise(F.col("execution_kind"))}))
