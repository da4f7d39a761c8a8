"""Queries of review compliance and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.tables import dealt
from tracewright.operators import compliance as h
from tracewright.plans.adapters import cte, table
from tracewright.plans.pricing_queries import SPANS, spans
from tracewright.plans.registry import query

EVIDENCE = "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE 'known' END AS runtime, o_orderkey % 11 <> 0 AS activity, o_orderkey % 7 <> 0 AS readable, o_custkey % 3 AS lines, o_custkey % 2 = 0 AS evidence, o_orderkey % 5 < 2 AS tool_evidence, o_orderstatus = 'F' AS committed FROM {t}"
CLASS = "CASE WHEN runtime = 'unknown' OR NOT activity OR NOT readable THEN 'unknown' WHEN lines > 0 AND evidence THEN 'compliant' WHEN lines = 0 AND tool_evidence THEN 'compliant' WHEN lines = 0 AND NOT evidence AND committed THEN 'skipped_fan_out' WHEN lines = 0 AND NOT evidence THEN 'incomplete' ELSE 'unknown' END"


def classified(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("evidence_orders")
    return spark.sql(EVIDENCE.format(t="evidence_orders")).withColumn("class", h.classify_run())


@query("h2_classify_run", f"WITH e AS ({EVIDENCE.format(t='orders')}) SELECT run_id, {CLASS} AS class FROM e")
def h2(spark, sf):
    return classified(spark, sf).select("run_id", "class")


@query("h3_compliance_totals", f"WITH e AS ({EVIDENCE.format(t='orders')}) SELECT {CLASS} AS class, count(*) AS runs FROM e GROUP BY 1")
def h3(spark, sf):
    return h.compliance_totals(classified(spark, sf))


ATTEMPTS = "SELECT l_orderkey AS run_id, l_returnflag AS lens, l_linenumber % 2 AS round, l_shipdate AS at, CAST(l_partkey AS {s}) || '-' || CAST(l_suppkey AS {s}) || '-' || CAST(l_extendedprice AS {s}) || '-' || CAST(l_linenumber AS {s}) AS attempt_id FROM {t}"


def attempts(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("attempt_lines")
    return spark.sql(ATTEMPTS.format(s="STRING", t="attempt_lines").replace("CAST(l_extendedprice AS STRING)", "CAST(CAST(l_extendedprice * 100 AS BIGINT) AS STRING)"))


SQL_ATTEMPTS = ATTEMPTS.format(s="VARCHAR", t="lineitem").replace("CAST(l_extendedprice AS VARCHAR)", "CAST(CAST(trunc(l_extendedprice * 100) AS BIGINT) AS VARCHAR)").replace("AS at,", "AS moment,")


@query("h7_attempt_numbering", f"""WITH a AS ({SQL_ATTEMPTS}), n AS (SELECT *, row_number() OVER w::INT AS attempt, lead(attempt_id) OVER w IS NOT NULL AS superseded FROM a WINDOW w AS (PARTITION BY run_id, lens, round ORDER BY moment, attempt_id)) SELECT run_id, lens, round, attempt, superseded, row_number() OVER (PARTITION BY run_id ORDER BY round, lens, attempt)::INT AS place FROM n""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def h7(spark, sf):
    return h.number_attempts(attempts(spark, sf)).select("run_id", "lens", "round", "attempt", "superseded", "place")


@query("h7_missing_attempts", f"WITH a AS ({SQL_ATTEMPTS}) SELECT o_orderkey AS run_id, l.lens FROM orders, (SELECT unnest(['A', 'N', 'R']) AS lens) l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.run_id = o_orderkey AND a.lens = l.lens)")
def h7b(spark, sf):
    committed = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.explode(F.array(*map(F.lit, "ANR"))).alias("lens"))
    return h.missing_attempts(committed, attempts(spark, sf))


PAIRS = "SELECT CAST(o_custkey AS BIGINT) AS session, o_orderkey AS ref, l_partkey AS cand, max((l_partkey * 7 + o_orderkey * 3) % 100) / CAST(100.0 AS DOUBLE) AS score FROM {l} JOIN {o} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, l_partkey"


# of a session, pair n (best first) is taken if neither of its ends was taken by a pair before
GREEDY = f"""WITH RECURSIVE p AS ({PAIRS.format(o='orders', l='lineitem')}), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, ref, cand) AS n FROM p),
g AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS refs, CAST([] AS BIGINT[]) AS cands, FALSE AS took FROM (SELECT DISTINCT session FROM p)
UNION ALL SELECT g.session, o.n, CASE WHEN free THEN list_append(refs, ref) ELSE refs END, CASE WHEN free THEN list_append(cands, cand) ELSE cands END, free
FROM g JOIN o ON o.session = g.session AND o.n = g.n + 1, LATERAL (SELECT NOT list_contains(refs, ref) AND NOT list_contains(cands, cand) AS free) f)
SELECT o.session, ref, cand, score FROM o JOIN g ON o.session = g.session AND o.n = g.n WHERE took"""


@query("m12_greedy_match", GREEDY)
def m12(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = lines.count()
    dealt(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"), rows, "o_orderkey").createOrReplaceTempView("match_orders")
    dealt(lines.select("l_orderkey", "l_partkey"), rows, "l_orderkey").createOrReplaceTempView("match_lines")
    return h.greedy_match(spark.sql(PAIRS.format(o="match_orders", l="match_lines")), rows)


@query("m13_eval_matrix", "SELECT l_suppkey AS session, avg(l_quantity) FILTER (l_returnflag = 'A') AS A, avg(l_quantity) FILTER (l_returnflag = 'N') AS N, avg(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_suppkey")
def m13(spark, sf):
    return h.eval_matrix(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("session"), F.col("l_returnflag").alias("config"), F.col("l_quantity").alias("score")), ["A", "N", "R"])


WORDS = "list_distinct(string_split({c}, ' '))"


@query("m11_truth_similarity", f"""WITH p AS (SELECT p_partkey, {WORDS.format(c='p_name')} AS t, {WORDS.format(c="(p_type || ' ' || p_brand)")} AS c, [CAST(p_size AS VARCHAR)] AS e FROM part), q AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.t AS wa, b.t AS wb, a.c AS ac, b.c AS bc, a.e = b.e AS same FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, round(0.4 * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) + 0.4 * len(list_intersect(ac, bc)) / len(list_distinct(list_concat(ac, bc))) + CASE WHEN same THEN 0.2 ELSE 0 END, 9)::DOUBLE AS score FROM q""")
def m11(spark, sf):
    words = lambda c: F.array_distinct(F.split(c, " "))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", words(F.col("p_name")).alias("title"), words(F.concat_ws(" ", "p_type", "p_brand")).alias("claim"), F.array(F.col("p_size").cast("string")).alias("paths"))
    side = lambda x: p.select(F.col("p_partkey").alias(f"{x}_id"), *(F.col(c).alias(f"{x}_{c}") for c in ("title", "claim", "paths")))
    both = side("r").join(side("c"), F.col("c_id") == F.col("r_id") + 1)
    return both.select(F.col("r_id").alias("a"), F.col("c_id").alias("b"), F.round(h.truth_similarity(), 9).alias("score"))


DISPATCHES = "SELECT agent, session_id, CAST(idx + 1 AS BIGINT) AS turn_idx, 't' || session_id || '-' || CAST(idx AS {s}) AS tool_use_id, CASE WHEN idx % 3 = 0 THEN 'tr' || session_id END AS transcript FROM {t}"


@query("f11_attach_subagents", f"""{cte('invocations')}, {SPANS}, d AS ({DISPATCHES.format(s='VARCHAR', t='invocations')}), s AS (SELECT *, session_id || '/' || CAST(idx AS VARCHAR) AS run_id FROM spans),
r AS (SELECT run_id, CASE WHEN idx % 2 = 0 THEN 't' || session_id || '-' || CAST(idx AS VARCHAR) END AS dispatch_id, CASE WHEN idx % 5 = 4 THEN 'tr' || session_id END AS transcript FROM s)
SELECT s.run_id, d.tool_use_id, d.turn_idx, d.transcript FROM s JOIN d ON s.agent = d.agent AND s.session_id = d.session_id AND d.turn_idx >= s.idx AND (s.last_idx IS NULL OR d.turn_idx <= s.last_idx)
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = s.run_id AND r.dispatch_id = d.tool_use_id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = s.run_id AND r.transcript = d.transcript)""")
def f11(spark, sf):
    table(spark, sf, "invocations").createOrReplaceTempView("dispatch_invocations")
    s = spans(spark, sf).withColumn("run_id", F.concat_ws("/", "session_id", F.col("idx").cast("string")))
    recorded = s.select("run_id", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("t"), "session_id", F.lit("-"), F.col("idx").cast("string"))).alias("dispatch_id"), F.when(F.col("idx") % 5 == 4, F.concat(F.lit("tr"), "session_id")).alias("transcript"))
    return h.attach_subagents(s.select("agent", "session_id", "idx", "last_idx", "run_id"), spark.sql(DISPATCHES.format(s="STRING", t="dispatch_invocations")), recorded)
