"""Cost report (E6): what each invocation did, each fact measured on its own before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.pricing import in_span

KEY = ["agent", "session_id", "idx"]


def call_measures(spans: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool calls of each span: how many, by kind, how many failed, and their time (null if none was timed).

    ``calls`` has c_agent, c_session, at, kind, ms, bad. The session is an equality, the time a range beside it.
    """
    both = spans.join(calls, (F.col("agent") == F.col("c_agent")) & (F.col("session_id") == F.col("c_session")) & in_span())
    kinds = both.groupBy(*KEY, "kind").agg(F.count("*").alias("n"), F.count_if("bad").alias("errors"), F.sum(F.when(F.col("ms") >= 0, F.col("ms"))).alias("ms"))
    got = kinds.groupBy(*KEY).agg(F.sum("n").alias("tool_calls"), F.sum("errors").alias("errors"), F.sum("ms").alias("active_ms"), F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))
    return spans.join(got, KEY, "left").withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0))).withColumn("errors", F.coalesce("errors", F.lit(0)))


def turn_measures(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of each span by index: how many, their tokens and wall time, and the ordered distinct models.

    ``turns`` has t_agent, t_session, turn_idx, input_tokens, output_tokens, wall_ms, model.
    """
    from tracewright.functions.scalars import ordered_distinct

    both = spans.join(turns, (F.col("agent") == F.col("t_agent")) & (F.col("session_id") == F.col("t_session")) & (F.col("turn_idx") >= F.col("idx")) & (F.col("last_idx").isNull() | (F.col("turn_idx") <= F.col("last_idx"))))
    got = both.groupBy(*KEY).agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.when(F.col("wall_ms") >= 0, F.col("wall_ms"))).alias("wall_ms"), ordered_distinct(F.col("turn_idx"), F.col("model")).alias("models"))
    return spans.join(got, KEY, "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
