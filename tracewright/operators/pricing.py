"""Pricing (E): rates as of a time, token costs, invocation spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_intervals(rates: DataFrame) -> DataFrame:
    """Each rate with the time that the model's next one takes over."""
    return rates.withColumn("until", F.lead("effective").over(Window.partitionBy("model").orderBy("effective")))


def rate_asof(usage: DataFrame, rates: DataFrame, at: str = "at") -> DataFrame:
    """Left as-of join: the model's latest rate that is effective at the row's time; the rates are null where there is none.

    An equality on the model with a range beside it: a hash join, never a loop over rates.
    """
    r = rate_intervals(rates).withColumnRenamed("model", "rate_model")
    fits = (F.col("model") == F.col("rate_model")) & (F.col(at) >= F.col("effective")) & (F.col("until").isNull() | (F.col(at) < F.col("until")))
    return usage.join(r, fits, "left").drop("rate_model", "until")


def cost_of(input_: Column, output: Column, cached: Column, write_5m: Column, write_1h: Column) -> Column:
    """E2 at plain speed: dollars for tokens at the joined rates, which are per million."""
    return (input_ * F.col("input_rate") + output * F.col("output_rate") + cached * F.col("cache_read_rate") + write_5m * F.col("cache_write_5m_rate") + write_1h * F.col("cache_write_1h_rate")) / 1e6


def fast_cost(input_: Column, output: Column, cached: Column, fast_input: Column, fast_output: Column) -> Column:
    """E2 at fast speed: cache rates scale with the fast input rate; null without fast rates or an input rate."""
    scale = fast_input / F.nullif(F.col("input_rate"), F.lit(0.0))
    return (input_ * fast_input + output * fast_output + cached * F.col("cache_read_rate") * scale) / 1e6


def split_cache(total: Column, hour: Column) -> tuple[Column, Column]:
    """Cache writes of five minutes and of one hour; null where the hour's part is more than the whole."""
    ok = F.coalesce(hour, F.lit(0)) <= total
    return F.when(ok, total - F.coalesce(hour, F.lit(0))), F.when(ok, F.coalesce(hour, F.lit(0)))


def billable(rows: DataFrame) -> DataFrame:
    """The input tokens to bill and the reason why a row can't be billed.

    Agent A counts cached tokens beside the input, agent B within it; of others cached tokens can't be told apart.
    """
    a, b = F.col("agent") == "claude-code", F.col("agent") == "codex-cli"
    reason = F.when(b & (F.col("cached_tokens") > F.col("input_tokens")), "cached exceeds input").when(~a & ~b & (F.col("cached_tokens") > 0), "cache semantics unknown")
    inside = F.when(b, F.col("input_tokens") - F.col("cached_tokens")).otherwise(F.col("input_tokens"))
    return rows.withColumn("reason", reason).withColumn("billed_input", F.when(F.col("reason").isNull(), inside))


def invocation_spans(invocations: DataFrame, end: str = "session_end") -> DataFrame:
    """E5: an invocation goes on until the session's next one: turn span [idx, next idx - 1], time span [start, next start or session end)."""
    w = Window.partitionBy("agent", "session_id").orderBy("idx")
    return invocations.withColumn("last_idx", F.lead("idx").over(w) - 1).withColumn("until", F.coalesce(F.lead("started_at").over(w), F.col(end)))


def in_span(start: str = "started_at", at: str = "at", until: str = "until") -> Column:
    return (F.col(at) >= F.col(start)) & (F.col(until).isNull() | (F.col(at) < F.col(until)))


def cost_or_null(priced: DataFrame, keys: list[str]) -> DataFrame:
    """The cost of a group is known only if each unit with tokens is priced; 0 when there is nothing to price. Warnings are distinct, in order.

    ``priced`` has ord, tokens, cost and reason. Sums are of whole nano-dollars, so they don't depend on the order of rows.
    """
    bears = F.coalesce(F.col("tokens"), F.lit(0)) > 0
    warn = F.array_sort(F.collect_list(F.when(bears & F.col("cost").isNull(), F.struct(F.col("ord"), F.col("reason")))))
    got = priced.groupBy(*keys).agg(F.count("*").alias("units"), F.count_if(bears & F.col("cost").isNull()).alias("unpriced"), F.sum(F.when(bears, F.floor(F.col("cost") * 1e9 + 0.5))).alias("total"), F.array_distinct(F.transform(warn, lambda x: x["reason"])).alias("warnings"))
    return got.withColumn("cost_usd", F.when(F.col("unpriced") == 0, F.floor((F.coalesce("total", F.lit(0)) + 500) / 1000) / 1e6)).drop("total")


def in_range(at: Column, since: Column | None, until: Column | None) -> Column:
    """At or after since and before until; a row without time only in the unbounded range."""
    if since is None and until is None:
        return F.lit(True)
    ok = at.isNotNull()
    if since is not None:
        ok = ok & (at >= since)
    if until is not None:
        ok = ok & (at < until)
    return F.coalesce(ok, F.lit(False))


def run_commit(spans: DataFrame, commits: DataFrame) -> DataFrame:
    """Whether a span's work was committed: a subject names its ticket, or a commit falls in its time; and the last such time.

    A commit stamped exactly at the session's start has no time of its own and is not placed.
    """
    from tracewright.functions.scalars import subject_names_ticket

    c = commits.select(F.col("agent").alias("c_agent"), F.col("session_id").alias("c_session"), "committed_at", "subject")
    both = spans.join(c, (F.col("agent") == F.col("c_agent")) & (F.col("session_id") == F.col("c_session")), "left")
    inside = F.coalesce((F.col("committed_at") >= F.col("started_at")) & (F.col("until").isNull() | (F.col("committed_at") < F.col("until"))) & ~F.col("committed_at").eqNullSafe(F.col("session_start")), F.lit(False))
    named = F.coalesce(subject_names_ticket(F.col("subject"), F.col("ticket")), F.lit(False))
    return both.groupBy("agent", "session_id", "idx", "ticket", "started_at").agg(F.bool_or(inside | named).alias("committed"), F.max(F.when(inside, F.col("committed_at"))).alias("commit_at"))


def wall_ms(started: Column, committed: Column) -> Column:
    """Milliseconds from invocation to commit; null if there was none or it came before."""
    ms = F.floor((F.unix_micros(committed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000)
    return F.when(committed >= started, ms.cast("long"))
