"""Children of a third agent's sessions (E11): each order is a session whose case its key names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators.children import declared_children
from tracewright.plans.registry import query

#: case, call, turn, child, resumed child, milliseconds; children are named within their order
CALLS = [
    (0, "d1", 1, "a", None, 5000), (1, "d1", 1, "a", None, 5000), (2, "d1", 1, "a", None, None), (2, "d1", 2, "b", None, None), (3, "d1", 1, "a", None, None), (3, "d2", 1, "a", None, None),
    (4, "d1", 1, "a", None, 100), (4, "d2", 2, None, "a", 200), (5, "d1", 1, "a", None, None), (5, "d2", 6, None, "a", None), (6, "d1", 1, "a", "b", None), (7, "d1", 1, "a", None, None), (8, "d1", 1, "a", None, None), (9, "d1", 1, "a", None, None), (9, "d2", 2, None, "a", None), (10, "d1", 3, "a", None, 70),
]
#: case, child, parent ("" is the order's own session), dispatch, seconds
SESSIONS = [(1, "a", "", "d1", 9), (3, "a", "", None, None), (4, "a", "", "d2", None), (7, "a", "x", "d1", 3), (8, "a", "", "d9", 3), (9, "a", "", "d2", -4), (11, "a", "", None, 8), (11, "b", "", "d7", None)]
CASES = 13
#: case, child, dispatch, dispatches, turn, resolved, transcript missing, milliseconds, conflict: worked out by hand
EXPECTED = """(0,'a','d1','d1',1,true,true,5000,false), (1,'a','d1','d1',1,true,false,9000,false), (2,'a','d1','d1',1,false,true,NULL,true), (2,'b','d1','d1',1,false,true,NULL,true), (3,'a','d2','d1,d2',1,false,false,NULL,true),
(4,'a','d1','d1,d2',1,true,false,NULL,false), (5,'a','d1','d1,d2',1,false,true,NULL,false), (6,'a','d1','d1',1,false,true,NULL,true), (7,'a','d1','d1',1,false,false,3000,true), (8,'a','d1','d1,d9',1,false,false,3000,true), (9,'a','d1','d1,d2',1,true,false,NULL,false), (10,'a','d1','d1',3,true,true,70,false),
(11,'a',NULL,NULL,0,false,false,8000,false), (11,'b','d7','d7',0,false,false,NULL,false)"""
SQL = f"""WITH e(k, child, dispatch_id, dispatch_ids, turn_idx, resolved, transcript_missing, duration_ms, conflict) AS (VALUES {EXPECTED}), x AS (SELECT 'x' AS session_id, 'o' || CAST(o_orderkey AS VARCHAR) || 'a' AS child_session_id, 'd1' AS dispatch_id, 'd1' AS dispatch_ids, 0 AS turn_idx, false AS resolved, false AS transcript_missing, 3000 AS duration_ms, false AS conflict, o_orderkey AS o FROM orders WHERE o_orderkey % {CASES} = 7)
SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS session_id, 'o' || CAST(o_orderkey AS VARCHAR) || child AS child_session_id, dispatch_id, dispatch_ids, turn_idx, resolved, transcript_missing, duration_ms, conflict FROM orders JOIN e ON o_orderkey % {CASES} = k
UNION ALL SELECT 'x' || CAST(o AS VARCHAR), child_session_id, dispatch_id, dispatch_ids, turn_idx, resolved, transcript_missing, duration_ms, conflict FROM x"""


@query("e11_cursor_children", SQL)
def e11(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"), F.pmod("o_orderkey", F.lit(CASES)).cast("int").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t0"), "o_orderkey")
    of = lambda rows, names: orders.join(F.broadcast(spark.createDataFrame(rows, names)), "k")
    calls = of(CALLS, "k int, call_id string, turn_idx long, c string, r string, child_duration_ms long").select(F.col("o").alias("session_id"), "call_id", "turn_idx", F.concat("o", "c").alias("child_session_id"), F.concat("o", "r").alias("child_resume_id"), "child_duration_ms")
    named = F.when(F.col("p") == "", F.col("o")).otherwise(F.concat("p", F.col("o_orderkey").cast("string")))
    sessions = of(SESSIONS, "k int, c string, p string, parent_tool_call_id string, s int").select(F.concat("o", "c").alias("session_id"), named.alias("parent_session_id"), "parent_tool_call_id", F.col("t0").alias("start_time"), (F.col("t0") + F.make_interval(secs=F.col("s"))).alias("end_time"))
    invocations = orders.select(F.col("o").alias("session_id"), F.explode(F.array(F.lit(0), F.lit(5))).alias("idx"))
    return declared_children(calls, sessions, invocations)
