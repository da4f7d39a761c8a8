"""Run report (G): walks, meters and groups over run trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.tables import written


def walk(tree: DataFrame) -> DataFrame:
    """G1: the placed executions of each run, depth first; siblings by start, then id."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("walk"))
    return tree.where("state = 'placed'").select("run_id", "execution_id", place.alias("place"))


def first_of_transcript(units: DataFrame) -> DataFrame:
    """G1: each transcript counts once in a run, where the walk meets it first."""
    n = F.row_number().over(Window.partitionBy("run_id", "transcript").orderBy("place"))
    return units.withColumn("counted", F.col("transcript").isNotNull() & (n == 1))


def meter_scopes(units: DataFrame, measures: list[str]) -> DataFrame:
    """Sums of measures (null if never measured) by run and scope, with their total: parent, descendants, total."""
    scope = F.when((F.col("depth") == 0) | (F.col("execution_kind") == "human"), "parent").otherwise("descendants")
    rows = units.withColumn("part", scope)
    got = rows.groupingSets([["run_id", "part"], ["run_id"]], "run_id", "part").agg(F.count("*").alias("units"), *(F.sum(m).alias(m) for m in measures), F.grouping("part").alias("g"))
    return got.withColumn("scope", F.when(F.col("g") == 1, "total").otherwise(F.col("part"))).drop("g", "part")


def meter_tokens(units: DataFrame) -> DataFrame:
    """Tokens by run and runtime; the total leaves out cached tokens where they are part of the input."""
    got = units.groupBy("run_id", "agent").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
    cached = F.when(F.col("agent") == "codex-cli", F.lit(0)).otherwise(F.coalesce("cached_tokens", F.lit(0)))
    return got.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + cached)


#: The class of each error source; a stop hook is a signal and no failure, other sources are ``other``.
FAILURE_CLASSES = {"api_error": "api", "tool_error": "tool", "exec_error": "tool", "patch_error": "tool", "turn_aborted": "process", "stop_hook": "hook"}


def within_span(units: DataFrame, facts: DataFrame, idx: str) -> DataFrame:
    """The facts of a unit's session whose turn is in its span."""
    return units.join(facts, ["agent", "session_id"]).where((F.col(idx) >= F.col("first")) & (F.col("last").isNull() | (F.col(idx) <= F.col("last"))))


def unit_failures(units: DataFrame, errors: DataFrame) -> DataFrame:
    """A unit's failures by class, 0 where it has none. units and errors: as of ``meter_units``."""
    table = F.create_map(*(F.lit(x) for kv in FAILURE_CLASSES.items() for x in kv))
    e = within_span(units, errors, "turn_idx").withColumn("class", F.coalesce(F.try_element_at(table, F.col("source")), F.lit("other")))
    e = e.groupBy("unit").agg(*(F.count_if(F.col("class") == x).alias(f"{x}_failures" if x != "hook" else "hook_signals") for x in ("api", "tool", "process", "other", "hook")))
    return units.select("unit").join(e, "unit", "left").fillna(0, e.columns[1:])


def meter_units(units: DataFrame, turns: DataFrame, calls: DataFrame, errors: DataFrame) -> DataFrame:
    """What each unit's span of turns holds: turns and how many tell their conditions, calls by kind, tool time of timed calls only, failures by class.

    units: unit, agent, session_id, first, last (turns; null: to the end); turns: agent, session_id, idx, model, effort,
    cli_version; calls: agent, session_id, turn_idx, tool_kind, is_error, duration_ms; errors: agent, session_id, turn_idx, source.
    Each fact is summed by unit on its own and joined after, so nothing is counted twice.
    """
    told = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"turns_with_{c}")
    t = within_span(units, turns, "idx").groupBy("unit").agg(F.count("*").alias("turns"), *(told(c) for c in ("model", "effort", "cli_version")))
    timed = F.col("duration_ms") >= 0
    c = within_span(units, calls, "turn_idx").withColumn("kind", F.coalesce(F.nullif("tool_kind", F.lit("")), F.lit("unknown"))).groupBy("unit", "kind").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errored"), F.count_if(timed).alias("timed"), F.sum(F.when(timed, F.col("duration_ms"))).alias("ms"))
    c = c.groupBy("unit").agg(F.sum("n").alias("tool_calls"), F.sum("errored").alias("errored_calls"), F.sum("timed").alias("timed_calls"), F.sum("ms").alias("tool_ms"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("calls_by_kind"))
    got = units.select("unit").join(t, "unit", "left").join(c, "unit", "left").join(unit_failures(units, errors), "unit", "left")
    return got.fillna(0, [x for x in got.columns if x not in ("unit", "tool_ms", "calls_by_kind")]).fillna("", ["calls_by_kind"])


def root_span(runs: DataFrame, invocations: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of a run's root: its invocation's, from the first turn that begins at or after the run's start and up to the last that begins by its cutoff.

    runs: run_id, agent, session_id, idx (of the invocation, null: the whole session), at, cutoff; invocations: agent,
    session_id, idx, first, last (null: session end); turns: agent, session_id, idx, started_at, ended_at. A start within the
    invocation's own turn, or before it, narrows nothing. basis: session, invocation or started_at, with what bounds its end.
    """
    i = invocations.select("agent", "session_id", "idx", "first", "last", F.lit(True).alias("found"))
    spans = runs.join(i, ["agent", "session_id", "idx"], "left").withColumn("low", F.coalesce("first", F.lit(0)))
    t = turns.select("agent", "session_id", F.col("idx").alias("turn"), "started_at", "ended_at")
    both = spans.join(t, ["agent", "session_id"], "left").where(F.col("turn").isNull() | ((F.col("turn") >= F.col("low")) & (F.col("last").isNull() | (F.col("turn") <= F.col("last")))))
    own = F.col("turn") == F.col("low")
    late = F.max(F.when(own, (F.col("at") > F.col("started_at")) & (F.col("ended_at").isNull() | (F.col("at") > F.col("ended_at"))))).over(Window.partitionBy("run_id"))
    both = both.withColumn("narrowed", F.coalesce(F.col("found") & late, F.lit(False)))
    kept = (~F.col("narrowed") | (F.col("started_at") >= F.col("at"))) & (F.col("cutoff").isNull() | (F.col("started_at") <= F.col("cutoff")))
    got = both.groupBy("run_id").agg(F.min(F.when(kept, F.col("turn"))).alias("first_turn"), F.max(F.when(kept, F.col("turn"))).alias("last_turn"), F.bool_or("narrowed").alias("narrowed"), F.bool_or(F.coalesce("found", F.lit(False))).alias("found"), F.bool_or(F.col("last").isNotNull()).alias("bounded"))
    basis = F.when(F.col("narrowed"), "started_at").when(F.col("found"), "invocation").otherwise("session")
    bound = F.when(F.col("bounded"), "next invocation").otherwise("session end")
    return got.select("run_id", "first_turn", "last_turn", basis.alias("basis"), bound.alias("bound"))


def drift_gaps(unknown: DataFrame) -> DataFrame:
    """A journal session's records that are not understood, but for type ``usage``, as gaps. unknown: agent, session_id, type, subtype, count."""
    odd = unknown.where((F.col("agent") == "cursor-cli") & (F.col("type") != "usage"))
    return odd.select("session_id", F.concat(F.col("type"), F.lit(":"), F.col("subtype"), F.lit(" count="), F.col("count").cast("string")).alias("gap"))


def run_summaries(runs: DataFrame, scopes: DataFrame, failures: DataFrame) -> DataFrame:
    """A run's list row: its units by scope, children and failures in all. scopes: G5 rows; failures: run_id and the classes of G3."""
    wide = scopes.groupBy("run_id").agg(*(F.coalesce(F.max(F.when(F.col("scope") == s, F.col("units"))), F.lit(0)).alias(n) for s, n in (("total", "units"), ("descendants", "children"))))
    total = sum((F.col(f"{c}_failures") for c in ("api", "tool", "process", "other")), F.lit(0))
    return runs.join(wide, "run_id", "left").join(failures.select("run_id", total.alias("failures")), "run_id", "left")


def run_time(executions: DataFrame) -> DataFrame:
    """Wall time of a run from its first start to its end (or what was last observed), its basis, and the measured execution time."""
    ms = lambda a, b: F.floor((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000).cast("long")
    e = executions.withColumn("own_ms", F.when(F.col("ended_at") >= F.col("started_at"), ms("started_at", "ended_at")))
    got = e.groupBy("run_id").agg(F.min("started_at").alias("start"), F.max("ended_at").alias("end"), F.max("last_seen").alias("seen"), F.sum("own_ms").alias("execution_ms"), F.count("own_ms").alias("timed"), F.count("*").alias("executions"))
    got = got.withColumn("basis", F.when(F.col("end").isNotNull(), "ended").otherwise("observed")).withColumn("stop", F.coalesce("end", "seen"))
    return got.withColumn("wall_ms", F.when(F.col("stop") >= F.col("start"), ms("start", "stop"))).select("run_id", "wall_ms", "basis", "execution_ms", "timed", "executions")


def stage_groups(executions: DataFrame) -> DataFrame:
    """Attempts of each (stage, occurrence) of a run's executions of kind stage, in the order of the walk (``place``); an untold occurrence is 0, an untold stage
    empty; retries are those after the first."""
    at = F.array_sort(F.collect_list(F.struct("place", "execution_id")))
    got = executions.where("execution_kind = 'stage'").groupBy("run_id", F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("stage_occurrence", F.lit(0)).alias("occurrence")).agg(F.count("*").alias("attempts"), F.array_join(F.transform(at, lambda x: x["execution_id"]), ",").alias("order"))
    return got.withColumn("retries", F.col("attempts") - 1)


def ticket_index(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """The one ticket that spans place a session's time under; null if they name none or several.

    sessions: agent, session_id, at; spans: agent, session_id, started_at, until, ticket.
    """
    s = spans.select(F.col("agent").alias("s_agent"), F.col("session_id").alias("s_session"), F.col("started_at").alias("s_start"), F.col("until").alias("s_until"), "ticket")
    both = sessions.join(s, (F.col("agent") == F.col("s_agent")) & (F.col("session_id") == F.col("s_session")) & (F.col("at") >= F.col("s_start")) & (F.col("s_until").isNull() | (F.col("at") < F.col("s_until"))), "left")
    got = both.groupBy("agent", "session_id", "at").agg(F.count_distinct("ticket").alias("n"), F.min("ticket").alias("t"))
    return got.select("agent", "session_id", "at", F.when(F.col("n") == 1, F.col("t")).alias("ticket"))


def lens_groups(executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Lens executions with their attempts: by execution id, else by (run, lens, round, attempt); what is left on either side stays.

    executions: run_id, execution_id, lens, round, attempt; attempts: run_id, attempt_id, a_execution_id, lens, round, attempt.
    """
    by_id = executions.join(attempts.where("a_execution_id is not null").select("run_id", F.col("a_execution_id").alias("execution_id"), "attempt_id"), ["run_id", "execution_id"])
    by_id = written(by_id, "lens-by-id")
    e = executions.join(by_id.select("run_id", "execution_id"), ["run_id", "execution_id"], "left_anti")
    a = attempts.join(by_id.select("run_id", "attempt_id"), ["run_id", "attempt_id"], "left_anti")
    key = ["run_id", "lens", "round", "attempt"]
    rest = e.select(*key, "execution_id").join(a.select(*key, "attempt_id"), key, "full_outer")
    basis = F.when(F.col("execution_id").isNotNull() & F.col("attempt_id").isNotNull(), "transcript").when(F.col("execution_id").isNotNull(), "execution").otherwise("unknown")
    return by_id.select(*key, "execution_id", "attempt_id", F.lit("execution").alias("attribution")).union(rest.select(*key, "execution_id", "attempt_id", basis.alias("attribution")))


def telemetry_gaps(units: DataFrame) -> DataFrame:
    """The distinct gaps of a run in the order of its walk, and whether its telemetry is complete. units: run_id, place, gap."""
    from tracewright.functions.scalars import ordered_distinct

    got = units.groupBy("run_id").agg(ordered_distinct(F.col("place"), F.col("gap")).alias("gaps"))
    return got.withColumn("telemetry", F.when(F.size("gaps") == 0, "complete").otherwise("partial"))


def invocation_outcome(runs: DataFrame) -> DataFrame:
    """The recorded outcome, else running if it has not ended, else unknown."""
    return runs.withColumn("shown_outcome", F.coalesce("outcome", F.when(F.col("ended_at").isNull(), "running").otherwise("unknown")))
