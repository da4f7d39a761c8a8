"""Queries of review lenses: the command grammar (H4), joined records (H5), the walk of attempts (H6) and child verdicts (H8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import compliance as h
from tracewright.operators import lenses as ln
from tracewright.plans.registry import query

ROUTER = "~/.codex/codex-lens.sh --lens security --payload /tmp/c.md"
#: Key arguments that line items get by their part, each made of the item's own numbers.
COMMANDS = [
    ("bash", "'~/.codex/codex-lens.sh --lens ' || lens || ' --payload /tmp/' || n || '/c.md'"),
    ("bash", "'bash -lc SCRATCH=/tmp/' || n || ' /x/codex-lens.sh --lens ' || lens || ' 2>/dev/null'"),
    ("bash", "'/x/codex-lens.sh --lens ' || lens || ' > /tmp/' || n || '.txt'"),
    ("bash", "'/x/codex-lens.sh --lens ' || lens || ' 2> /tmp/e >\"/tmp/' || n || '.txt\"'"),
    ("bash", "'/x/codex-lens.sh --lens ' || lens || ' >> /tmp/' || n || '.txt'"),
    ("bash", "'/x/codex-lens.sh --lens ' || lens || '; cat README.md > /tmp/' || n"),
    ("bash", "'/x/codex-lens.sh --lens ' || lens || ' | tee /tmp/' || n"),
    ("bash", "'cd /tmp/' || n || ' && /x/codex-lens.sh --runtime a --payload /tm…'"),
    ("bash", "'/x/codex-lens.sh --runtime a' || n || ' --lens ' || substring(lens, 1, 3) || '…'"),
    ("bash", "'/x/codex-lens.sh --runtime a' || n || ' --lens ' || lens || ' --at…'"),
    ("bash", "'echo codex-lens.sh is at /x/' || n || '…'"),
    ("custom", "'/bin/cat -- \"/tmp/' || n || '.txt\"'"),
    ("bash", "'  bash -lc cat /tmp/' || n || '.txt  '"),
    ("bash", "'cat README.md /tmp/' || n || '.txt'"),
    ("read", "'cat /tmp/' || n || '.txt'"),
    ("task", "'Review the ' || lens || ' of ' || n"),
    ("task", "'Lens pass, ' || n"),
    ("task", "'fix the ' || lens || ' findings of ' || n"),
    ("custom", "'/x/codex-lens.sh --lens bogus' || n"),
]
KIND = "CASE l_partkey % 20 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (kind, _) in enumerate(COMMANDS)) + " END"
KEY = "CASE l_partkey % 20 " + " ".join(f"WHEN {k} THEN {key}" for k, (_, key) in enumerate(COMMANDS)) + " END"
CALLS = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {KIND} AS kind, {KEY} AS key_arg FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey AS {{s}}) AS n, CASE l_suppkey % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'quality' ELSE 'security' END AS lens FROM {{t}}) x"

H4_SQL = rf"""WITH c AS ({CALLS.format(s='VARCHAR', t='lineitem')}), d AS (SELECT *, lower(coalesce(key_arg, '')) AS low, regexp_replace(trim(coalesce(key_arg, '')), '^(?:bash|sh|zsh) -[a-z]*c[a-z]* ', '') AS cmd FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE WHEN kind = 'task' THEN CASE WHEN NOT (low LIKE '%lens%' OR low LIKE '%review%') THEN NULL WHEN low LIKE '%contract%' THEN 'contract' WHEN low LIKE '%quality%' THEN 'quality' WHEN low LIKE '%security%' THEN 'security' END
ELSE nullif(regexp_extract(low, 'codex-lens\.sh\b[^\n]*--lens (contract|quality|security)\b', 1), '') END AS lens,
l_partkey % 20 IN (7, 8) AS cut, l_partkey % 20 IN (0, 1, 18) AS alone,
CASE WHEN l_partkey % 20 IN (2, 3) THEN '/tmp/' || CAST(l_suppkey AS VARCHAR) || '.txt' END AS redirect,
CASE WHEN l_partkey % 20 IN (11, 12) THEN '/tmp/' || CAST(l_suppkey AS VARCHAR) || '.txt' END AS reads FROM d"""


@query("h4_lens_dispatches", H4_SQL)
def h4(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("lens_lines")
    return ln.lens_calls(spark.sql(CALLS.format(s="STRING", t="lens_lines"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lens", "cut", "alone", "redirect", "reads")


# a run is an order; what happens in it is the case of its key, times are seconds from the order's date
#: case, turn, seq, call_id, kind, key_arg, start, milliseconds (0: unknown), failed
RUN_CALLS = [
    (0, 0, 1, "c1", "task", "contract lens", 5, 0, False), (0, 0, 2, "q1", "task", "quality lens", 6, 0, True), (0, 0, 3, "q2", "task", "quality lens", 7, 0, False), (0, 0, 4, "s1", "bash", ROUTER, 8, 2000, False),
    (1, 0, 1, "s1", "bash", ROUTER + " > /tmp/v", 5, 2000, False),
    (2, 0, 1, "s1", "bash", ROUTER + " > /tmp/v", 5, 2000, False), (2, 0, 2, "r1", "bash", "cat /tmp/v", 9, 10, False),
    (3, 0, 1, "s1", "bash", ROUTER + " > /tmp/v", 5, 2000, False), (3, 0, 2, "r1", "bash", "cat README.md /tmp/v", 9, 10, False),
    (4, 0, 1, "s1", "bash", ROUTER + " > /tmp/v; cat README.md", 5, 2000, False), (4, 0, 2, "r1", "bash", "cat /tmp/v", 9, 10, False),
    (5, 0, 1, "c1", "task", "contract lens", 5, 0, False),
    (6, 0, 1, "c1", "task", "contract lens", 5, 0, False),
    (7, 0, 1, "c1", "task", "have a look", 5, 0, False),
    (8, 0, 1, "s1", "bash", "/x/codex-lens.sh --runtime a --payload /t…", 5, 2000, False),
    (10, 0, 1, "c1", "task", "contract lens", 5, 0, False), (10, 0, 2, "c2", "task", "contract lens", 20, 0, False),
    (11, 0, 1, "c1", "task", "contract lens", 5, 0, False),
]
#: case, turn, ord, origin, dispatch_id, lens, status, reason, at
RUN_RESPONSES = [
    (0, 0, 0, "result", "c1", "contract", "parsed", None, None), (0, 0, 0, "result", "q2", "quality", "parsed", None, None), (0, 0, 0, "result", "s1", "security", "parsed", None, None),
    (2, 0, 0, "result", "r1", "security", "parsed", None, None), (3, 0, 0, "result", "r1", "security", "parsed", None, None),
    (4, 0, 0, "result", "s1", "security", "parsed", None, None), (4, 0, 0, "result", "r1", "security", "parsed", None, None),
    (5, 0, 0, "result", "c1", "quality", "parsed", None, None),
    (6, 2, 0, "notification", "c1", "contract", "parsed", None, 90), (6, 2, 1, "notification", "zz", "contract", "parsed", None, 91),
    (7, 0, 0, "result", "c1", "quality", "parsed", None, None),
    (9, 0, 0, "assistant", None, "contract", "parsed", None, None), (9, 0, 1, "assistant", None, "contract", "malformed", "unterminated", None), (9, 0, 2, "file_write", None, "quality", "parsed", None, 3),
    (10, 0, 0, "notification", "c1", "contract", "parsed", None, 10), (10, 0, 1, "notification", None, "contract", "parsed", None, 10),
    (11, 1, 0, "notification", "c1", "contract", "parsed", None, 30), (11, 1, 1, "notification", "c1", "contract", "malformed", "invalid_json", 31), (11, 1, 2, "notification", "c1", "security", "parsed", None, 32),
]
FENCE = chr(96) * 3
LINE = "dispatching (tk-1 round {}): {}"
RUN_TEXTS = [
    *((k, 0, LINE.format(1, "contract, quality, security")) for k in (0,)),
    *((k, 0, LINE.format(1, "security")) for k in (1, 2, 3, 4)),
    *((k, 0, "Dispatching (round 1): contract") for k in (5, 6, 11)),
    (9, 0, f'{LINE.format(1, "contract, quality, security")}\n{FENCE}json\n{{"lens": "contract"}}\n{FENCE}\n{LINE.format(2, "contract")}\n{FENCE}json\n{{"lens": "contract"'),
    (10, 0, LINE.format(1, "contract") + "\n" + LINE.format(2, "contract")),
    (10, 1, "dispatching (no number): quality"),
]
#: case, record, dispatch_id, lens, round, attempt, start, child session
RUN_RECORDS = [(7, "e1", "c1", "quality", 3, 2, None, None), (8, "e1", None, "security", 2, 0, 8, "child"), (8, "e2", None, "security", 2, 0, 99, "child"), (8, "e0", "other", "security", 9, 1, 6, None)]
#: case, place, lens, round, attempt, status, dispatched, routed, provenance, superseded, late, malformed, execution: what the rules give, worked out by hand
RUN_ATTEMPTS = """(0,0,'contract',1,1,'parsed',true,false,NULL,false,false,NULL,NULL), (0,1,'quality',1,1,'failed',true,false,NULL,true,false,NULL,NULL), (0,2,'quality',1,2,'parsed',true,false,NULL,false,false,NULL,NULL), (0,3,'security',1,1,'parsed',true,true,'router_result',false,false,NULL,NULL),
(1,0,'security',1,1,'dispatched',true,true,NULL,false,false,NULL,NULL), (2,0,'security',1,1,'parsed',true,true,'read_back',false,false,NULL,NULL), (3,0,'security',1,1,'dispatched',true,true,NULL,false,false,NULL,NULL), (4,0,'security',1,1,'dispatched',true,true,NULL,false,false,NULL,NULL),
(5,0,'contract',1,1,'responded',true,false,NULL,false,false,'lens mismatch: response names quality, dispatch named contract',NULL), (6,0,'contract',1,1,'parsed',true,false,NULL,false,true,NULL,NULL),
(7,0,'quality',3,2,'parsed',true,false,NULL,false,false,NULL,'e1'), (8,0,'security',2,1,'dispatched',true,true,NULL,false,false,NULL,'e1'),
(9,0,'contract',1,1,'parsed',false,false,NULL,false,false,NULL,NULL), (9,1,'quality',1,1,'parsed',false,false,NULL,false,false,NULL,NULL), (9,2,'security',1,0,'missing',false,false,NULL,false,false,NULL,NULL), (9,3,'contract',2,1,'responded',false,false,NULL,false,false,'unterminated',NULL),
(10,0,'contract',1,1,'parsed',true,false,NULL,false,false,NULL,NULL), (10,1,'contract',2,1,'dispatched',true,false,NULL,false,false,NULL,NULL),
(11,0,'contract',1,1,'parsed',true,false,NULL,true,false,NULL,NULL), (11,1,'contract',1,2,'responded',true,false,NULL,false,false,'invalid_json',NULL)"""
CASES = 13  # of which the last has no events
EXPECTED = f"WITH e(k, place, lens, round, attempt, status, dispatched, routed, provenance, superseded, late, malformed, execution_id) AS (VALUES {RUN_ATTEMPTS})"


def run_tables(spark, sf) -> dict[str, DataFrame]:
    """The tables of runs, of the orders; each case's rows are some ten, joined by the case."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.pmod("o_orderkey", F.lit(CASES)).cast("int").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t0"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("t0") + F.make_interval(secs=F.col(c)))
    of = lambda rows, names: orders.join(F.broadcast(spark.createDataFrame(rows, names)), "k")
    runs = orders.select("run_id", F.lit(0).cast("long").alias("first_idx"), F.lit(1).cast("long").alias("last_idx"), (F.col("k") == 9).alias("inlines"), F.lit("claude-code").alias("run_agent"), F.col("run_id").alias("run_session"))
    calls = of(RUN_CALLS, "k int, turn_idx long, seq long, call_id string, kind string, key_arg string, s int, duration_ms long, failed boolean").withColumn("started_at", at("s"))
    responses = of(RUN_RESPONSES, "k int, turn_idx long, ord long, origin string, dispatch_id string, lens string, status string, reason string, s int")
    nothing = {c: F.lit(None).cast("string") for c in ("verdict", "summary", "context_kind", "context_state", "source_path")}
    responses = responses.withColumns({"at": at("s"), "response_id": F.concat_ws("/", "run_id", "turn_idx", "ord", "origin", "dispatch_id"), "call_id": F.when(F.col("origin") == "result", F.col("dispatch_id")), "contaminated": F.lit(False), "source_line": F.lit(None).cast("long")} | nothing)
    texts = of(RUN_TEXTS, "k int, turn_idx long, text string")
    records = of(RUN_RECORDS, "k int, record_id string, dispatch_id string, r_lens string, r_round int, r_attempt int, s int, child string").select("run_id", "record_id", "dispatch_id", "r_lens", "r_round", "r_attempt", at("s").alias("r_started"), F.when(F.col("child").isNotNull(), "codex-cli").alias("agent"), F.concat("child", F.lit("-"), "run_id").alias("session_id"))
    return {"runs": runs, "calls": ln.lens_calls(calls), "responses": responses, "texts": texts, "records": records}


def run_attempts(t: dict[str, DataFrame]) -> DataFrame:
    return ln.attempt_walk(ln.lens_events(t["runs"], t["texts"], t["calls"], t["responses"], t["records"], ln.join_records(t["calls"], t["records"])))


SHOWN = ["run_id", "place", "lens", "round", "attempt", "status", "dispatched", "routed", "provenance", "superseded", "late", "malformed", "execution_id"]


@query("h5_join_lens_executions", f"SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, call_id, 'e1' AS record_id, basis FROM orders JOIN (VALUES (7, 'c1', 'dispatch'), (8, 's1', 'time')) v(k, call_id, basis) ON o_orderkey % {CASES} = k")
def h5(spark, sf):
    t = run_tables(spark, sf)
    return ln.join_records(t["calls"], t["records"])


@query("h6_lens_attempt_walk", f"{EXPECTED} SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, e.* EXCLUDE (k) FROM orders JOIN e ON o_orderkey % {CASES} = k")
def h6(spark, sf):
    return run_attempts(run_tables(spark, sf)).select(*SHOWN)


# every third child of a routed run answered with its lens, another with a different one, the rest not at all
@query(
    "h8_child_lens_verdict",
    f"""{EXPECTED}, r AS (SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey % 3 AS c, e.* EXCLUDE (k) FROM orders JOIN e ON o_orderkey % {CASES} = k WHERE k = 8)
SELECT run_id, place, lens, round, attempt, CASE c WHEN 0 THEN 'parsed' WHEN 1 THEN 'responded' ELSE status END AS status, dispatched, routed, CASE WHEN c < 2 THEN 'child_session' END AS provenance, superseded, late,
CASE c WHEN 1 THEN 'lens mismatch: response names quality, dispatch named security' END AS malformed, execution_id, CASE WHEN c < 2 THEN 'last-' || run_id END AS response_id FROM r""",
)
def h8(spark, sf):
    t = run_tables(spark, sf)
    attempts = run_attempts({k: v.join(t["runs"].where("pmod(bigint(substring(run_id, 2)), 13) = 8").select("run_id"), "run_id", "left_semi") for k, v in t.items()})
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 3 < 2")
    said = orders.select(F.lit("codex-cli").alias("agent"), F.concat(F.lit("child-r"), F.col("o_orderkey").cast("string")).alias("session_id"), F.when(F.col("o_custkey") % 3 == 0, "security").otherwise("quality").alias("lens"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn_idx"))
    last = F.concat(F.when(F.col("turn_idx") == 1, "last").otherwise("early"), F.lit("-"), F.substring("session_id", 7, 99))
    responses = said.select("agent", "session_id", F.col("turn_idx").cast("long").alias("turn_idx"), F.lit(0).alias("ord"), F.when(F.col("turn_idx") == 2, "result").otherwise("assistant").alias("origin"), last.alias("response_id"), "lens", F.lit("parsed").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("reason", "source_path", "verdict", "summary", "context_kind", "context_state")), F.lit(None).cast("long").alias("source_line"), F.lit(False).alias("contaminated"))
    return ln.child_verdicts(attempts, t["records"], t["runs"].select("run_id", "run_agent", "run_session"), responses).select(*SHOWN, "response_id")


#: case, commitment lines, highest round, a round is unreadable, spoken or called, lens subagents, routed verdicts, inlined fan-out, parsed responses, a contract attempt stands: worked out by hand
RUN_FACTS = """(0,1,1,false,true,3,1,false,3,true), (1,1,1,false,true,0,0,false,0,false), (2,1,1,false,true,0,1,false,1,false), (3,1,1,false,true,0,0,false,0,false), (4,1,1,false,true,0,0,false,0,false), (5,1,1,false,true,1,0,false,0,false), (6,1,1,false,true,1,0,false,1,true),
(7,0,NULL,false,true,0,0,false,0,false), (8,0,NULL,false,true,0,0,false,0,false), (9,2,2,false,true,0,0,true,2,true), (10,3,2,true,true,2,0,false,1,true), (11,1,1,false,true,1,0,false,1,false), (12,0,NULL,false,false,0,0,false,0,false)"""
RUNTIME = "CASE o_custkey % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'cursor' ELSE 'unknown' END"

# a returned line item is a ticket edit of its order's run, and each line item a criterion of its contract responses
H1_SQL = f"""WITH f(k, lines, round, unreadable, activity, agents, routers, inlined, parsed, stands) AS (VALUES {RUN_FACTS}),
i AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_returnflag = 'R') AS edits, min(l_shipdate) FILTER (l_returnflag = 'R') AS first, max(l_shipdate) FILTER (l_returnflag = 'R') AS last, count(*) AS items FROM lineitem GROUP BY 1),
r AS (SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, {RUNTIME} AS runtime, o_custkey % 5 = 0 AS dirty, o_orderkey % 2 = 0 AS committed, f.*, i.*, activity OR coalesce(edits, 0) > 0 AS active FROM orders JOIN f ON o_orderkey % {CASES} = k LEFT JOIN i ON l_orderkey = o_orderkey),
t AS (SELECT *, CASE runtime WHEN 'claude' THEN agents >= 2 OR (agents >= 1 AND routers > 0) WHEN 'unknown' THEN false ELSE routers > 0 END AS tool FROM r),
e AS (SELECT *, tool OR (runtime IN ('codex', 'cursor') AND inlined) AS evidence FROM t)
SELECT run_id, runtime, round::BIGINT AS review_iterations, evidence AS fan_out_dispatched, CASE WHEN dirty THEN parsed ELSE 0 END AS contamination_reports, CASE WHEN stands AND items > 0 THEN open END AS criteria_unverified, CASE WHEN edits >= 2 THEN epoch_ms(last) - epoch_ms(first) END AS open_to_done_ms, committed,
CASE WHEN runtime = 'unknown' OR NOT active OR unreadable THEN 'unknown' WHEN lines > 0 AND evidence THEN 'compliant' WHEN lines = 0 AND tool THEN 'compliant' WHEN lines = 0 AND NOT evidence AND committed THEN 'skipped_fan_out' WHEN lines = 0 AND NOT evidence THEN 'incomplete' ELSE 'unknown' END AS class FROM e"""


@query("h1_compliance_runs", H1_SQL)
def h1(spark, sf):
    t = run_tables(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.expr(RUNTIME).alias("runtime"), F.expr("o_custkey % 5 = 0").alias("dirty"), F.expr("o_orderkey % 2 = 0").alias("landed"))
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), "l_shipdate", "l_returnflag", "l_linestatus")
    edits = items.where("l_returnflag = 'R'").select("run_id", F.lit(0).cast("long").alias("turn_idx"), F.lit("mcp").alias("kind"), F.lit(None).cast("string").alias("key_arg"), F.lit("mcp__tk__ticket_edit").alias("tool_name"), F.col("l_shipdate").cast("timestamp").alias("started_at"))
    calls = t["calls"].select("run_id", "turn_idx", "kind", "key_arg", F.col("kind").alias("tool_name"), "started_at").unionByName(edits)
    criteria = items.groupBy("run_id").agg(F.collect_list(F.when(F.col("l_linestatus") == "O", "unverified").otherwise("met")).alias("criteria"))
    t["responses"] = t["responses"].drop("contaminated").join(orders.select("run_id", F.col("dirty").alias("contaminated")), "run_id")
    none = t["records"].where(F.lit(False))
    attempts = ln.attempt_walk(ln.lens_events(t["runs"], t["texts"], t["calls"], t["responses"], none, ln.join_records(t["calls"], none)))
    return h.compliance_runs(t["runs"].join(orders.select("run_id", "runtime"), "run_id"), t["texts"], calls, t["responses"].join(criteria, "run_id", "left"), attempts, orders.where("landed"))


@query("g12_run_detail_responses", f"""{EXPECTED}, p AS (SELECT k, lens, round, attempt FROM e WHERE status IN ('parsed', 'responded'))
SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, lens, round, attempt, 'verdict of ' || CAST(o_custkey AS VARCHAR) AS raw FROM orders JOIN p ON o_orderkey % {CASES} = k WHERE o_orderkey % 10 <> 7""")
def g12(spark, sf):
    t = run_tables(spark, sf)
    of = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 10 <> 7").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("verdict of "), F.col("o_custkey").cast("string")).alias("raw"))
    return h.attempt_responses(run_attempts(t), t["responses"].join(of, "run_id").select("response_id", "raw"))
