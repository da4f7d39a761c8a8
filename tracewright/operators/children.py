"""Children of a third agent's sessions (E11): what dispatches declared and what children's own metadata say, reconciled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.tables import written

PAIR = ["parent", "child"]


def declared_children(calls: DataFrame, sessions: DataFrame, invocations: DataFrame) -> DataFrame:
    """Each child of each session once: dispatches, the one that made it, its turn, bounds, duration, and whether the evidence agrees.

    calls: session_id, call_id, turn_idx, child_session_id, child_resume_id, child_duration_ms; sessions: session_id, parent_session_id,
    parent_tool_call_id, start_time, end_time; invocations: session_id, idx. A dispatch that names several children is a conflict of all of
    them, as are two creations of one child, a resume of another, metadata that names another parent, and a metadata dispatch that is
    neither the creation nor a resume of the child. A child is resolved without a conflict, if each dispatch is one call and all are of one invocation.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    told = calls.withColumn("child", F.coalesce(some("child_session_id"), some("child_resume_id"))).where("child is not null")
    told = told.select(F.col("session_id").alias("parent"), "child", some("call_id").alias("dispatch"), "turn_idx", some("child_resume_id").alias("resume"), "child_duration_ms")
    meta = sessions.select(F.col("session_id").alias("child"), some("parent_session_id").alias("named"), some("parent_tool_call_id").alias("meta_dispatch"), "start_time", "end_time")
    # a child's metadata counts where it names the session, and where a dispatch of the session names the child
    pairs = told.select(*PAIR).union(meta.where("named is not null").select(F.col("named").alias("parent"), "child")).distinct()
    pairs = written(pairs.join(meta.withColumn("has_meta", F.lit(True)), "child", "left"), "e11-pairs")
    told = written(told, "e11-told")
    met = told.where("dispatch is not null").select(*PAIR, "dispatch").union(pairs.where("meta_dispatch is not null").select(*PAIR, "meta_dispatch")).distinct()
    shared = met.groupBy("parent", "dispatch").agg(F.count("*").alias("children")).where("children > 1").select("parent", "dispatch")
    spread = met.join(shared, ["parent", "dispatch"], "left_semi").select(*PAIR).distinct().withColumn("spread", F.lit(True))
    made = F.col("resume").isNull()
    own = told.groupBy(*PAIR).agg(
        F.count_distinct(F.when(made, F.coalesce("dispatch", F.lit("")))).alias("creations"),
        F.max_by(F.when(made, F.col("dispatch")), F.when(made, F.struct("turn_idx", "dispatch"))).alias("creation"),
        F.coalesce(F.bool_or(F.col("resume") != F.col("child")), F.lit(False)).alias("resumes_other"),
        F.collect_set(F.when(F.col("resume") == F.col("child"), F.col("dispatch"))).alias("resumed_by"),
        F.max_by("child_duration_ms", F.when(F.col("child_duration_ms").isNotNull(), F.struct("turn_idx", "dispatch"))).alias("told_ms"),
    )
    # a dispatch's calls, and how many invocations began at or before its turn
    counted = calls.groupBy(F.col("session_id").alias("parent"), F.col("call_id").alias("dispatch")).agg(F.count("*").alias("calls"), F.min("turn_idx").alias("turn"))
    turns = counted.join(met.select("parent", "dispatch").distinct(), ["parent", "dispatch"])
    begun = turns.join(invocations.select(F.col("session_id").alias("parent"), "idx"), "parent", "left").groupBy("parent", "dispatch", "calls", "turn").agg(F.count_if(F.col("idx") <= F.col("turn")).alias("invocation"))
    at = met.join(begun, ["parent", "dispatch"], "left").groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("dispatch", "turn"))).alias("by"),
        F.bool_and((F.coalesce("calls", F.lit(0)) == 1) & F.col("turn").isNotNull()).alias("single"),
        F.count_distinct(F.coalesce("invocation", F.lit(-1))).alias("owners"),
    )
    both = pairs.join(own, PAIR, "left").join(at, PAIR, "left").join(spread, PAIR, "left")
    odd = F.col("meta_dispatch").isNotNull() & F.col("creation").isNotNull() & (F.col("meta_dispatch") != F.col("creation")) & ~F.coalesce(F.array_contains("resumed_by", F.col("meta_dispatch")), F.lit(False))
    conflict = F.coalesce("spread", F.lit(False)) | (F.coalesce("creations", F.lit(0)) > 1) | F.coalesce("resumes_other", F.lit(False)) | F.coalesce(F.col("named") != F.col("parent"), F.lit(False)) | odd
    first = F.get("by", F.lit(0))
    chosen = F.coalesce(F.get(F.filter("by", lambda x: x["dispatch"] == F.col("creation")), F.lit(0)), first)
    observed = F.when(F.col("end_time") >= F.col("start_time"), F.unix_millis(F.col("end_time").cast("timestamp")) - F.unix_millis(F.col("start_time").cast("timestamp")))
    return both.select(
        F.col("parent").alias("session_id"),
        F.col("child").alias("child_session_id"),
        chosen["dispatch"].alias("dispatch_id"),
        F.array_join(F.transform("by", lambda x: x["dispatch"]), ",").alias("dispatch_ids"),
        F.coalesce(chosen["turn"], F.lit(0)).cast("long").alias("turn_idx"),
        (~conflict & F.coalesce(F.col("single") & (F.col("owners") == 1), F.lit(False))).alias("resolved"),
        F.col("has_meta").isNull().alias("transcript_missing"),
        F.coalesce(observed, F.when(F.coalesce(F.size("by"), F.lit(0)) < 2, F.col("told_ms"))).alias("duration_ms"),
        conflict.alias("conflict"),
    )
