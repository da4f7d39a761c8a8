"""Review compliance (H) and evaluation (M11-M13): classification, attempts, greedy matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.tables import dealt


def classify_run() -> Column:
    """H2: the class of a run by ordered tests of runtime, activity, readable, lines, evidence, tool_evidence and committed."""
    none = F.col("lines") == 0
    return (
        F.when(F.col("runtime") == "unknown", "unknown")
        .when(~F.col("activity"), "unknown")
        .when(~F.col("readable"), "unknown")
        .when(~none & F.col("evidence"), "compliant")
        .when(none & F.col("tool_evidence"), "compliant")
        .when(none & ~F.col("evidence") & F.col("committed"), "skipped_fan_out")
        .when(none & ~F.col("evidence") & ~F.col("committed"), "incomplete")
        .otherwise("unknown")
    )


def compliance_totals(classified: DataFrame) -> DataFrame:
    """H3: runs by class."""
    return classified.groupBy("class").agg(F.count("*").alias("runs"))


# The tool that moves a ticket's status, the status of a criterion nobody verified, the runtimes that review in their own context.
TICKET_EDIT, UNVERIFIED, INLINING = "ticket_edit", "unverified", ["codex", "cursor"]


def compliance_runs(runs: DataFrame, texts: DataFrame, calls: DataFrame, responses: DataFrame, attempts: DataFrame, committed: DataFrame) -> DataFrame:
    """H1: one row a run: review rounds, evidence of a fan-out, contamination reports, unverified criteria, time from open to done, class.

    runs: run_id, runtime, first_idx, last_idx; texts: run_id, turn_idx, text; calls: run_id, turn_idx, kind, key_arg, tool_name,
    started_at; responses: run_id, turn_idx, response_id, origin, lens, status, criteria (statuses; null: not readable);
    attempts: H6's without records; committed: run_id of E8's runs with a commit. Turns outside [first_idx, last_idx] do not
    count. Criteria are those of the last contract attempt that stands. Nothing measured is null, not 0: rounds without a
    commitment line, criteria without such an attempt, open to done with fewer than two edits. Each table is summed by run before
    it is joined.
    """
    span = runs.select("run_id", "first_idx", "last_idx")
    inside = lambda df: df.join(span, "run_id").where(F.col("turn_idx").between(F.col("first_idx"), F.col("last_idx")))
    heads = F.regexp_extract_all("text", F.lit(r"(?i)dispatching \(([^)\n]*)\)\s*:"), 1)
    rounds = F.transform(heads, lambda h: F.nullif(F.regexp_extract(h, r"(?i)round (\d+)", 1), F.lit("")).try_cast("bigint"))
    said = inside(texts).select("run_id", (F.regexp_replace("text", r"\s", "") != "").alias("spoken"), rounds.alias("rounds"))
    said = said.groupBy("run_id").agg(F.max("spoken").alias("spoken"), F.sum(F.size("rounds")).alias("lines"), F.max(F.array_max("rounds")).alias("round"), F.max(F.exists("rounds", lambda r: r.isNull())).alias("unreadable"))
    low = F.lower("key_arg")
    edit = F.when(F.col("tool_name").contains(TICKET_EDIT), F.col("started_at"))
    did = inside(calls).groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if((F.col("kind") == "task") & (low.contains("lens") | low.contains("review"))).alias("lens_agents"), F.count(edit).alias("edits"), F.min(edit).alias("opened"), F.max(edit).alias("done"))
    whole = (F.col("status") == "parsed") & F.col("origin").isin("assistant", "file_write")
    inlined = inside(responses).groupBy("run_id").agg(*(F.max(whole & (F.col("lens") == n)).alias(f"inlined_{n}") for n in ("contract", "quality")))
    parsed = F.col("status") == "parsed"
    stands = parsed & ~F.col("superseded") & (F.col("lens") == "contract")
    tried = attempts.groupBy("run_id").agg(
        F.count_distinct(F.when(parsed & F.col("contaminated"), F.coalesce("response_id", F.lit("")))).alias("contamination_reports"),
        F.count_if(parsed & F.col("routed") & (F.coalesce("provenance", F.lit("")) != "")).alias("lens_routers"),
        F.max_by("response_id", F.when(stands, F.col("place"))).alias("response_id"),
    )
    unverified = responses.groupBy("run_id", "response_id").agg(F.max(F.size(F.filter("criteria", lambda c: c == UNVERIFIED))).alias("criteria_unverified"))
    unverified = unverified.where("response_id <> ''").withColumn("criteria_unverified", F.when(F.col("criteria_unverified") >= 0, F.col("criteria_unverified")))
    landed = committed.select("run_id").distinct().withColumn("committed", F.lit(True))
    r = runs.select("run_id", "runtime").join(said, "run_id", "left").join(did, "run_id", "left").join(inlined, "run_id", "left").join(tried, "run_id", "left").join(unverified, ["run_id", "response_id"], "left").join(landed, "run_id", "left")
    zeros, flags = ["lines", "calls", "lens_agents", "edits", "lens_routers", "contamination_reports"], ["spoken", "unreadable", "inlined_contract", "inlined_quality", "committed"]
    r = r.fillna(0, zeros).fillna(False, flags)
    by_tool = F.when(F.col("runtime") == "claude", (F.col("lens_agents") >= 2) | ((F.col("lens_agents") >= 1) & (F.col("lens_routers") > 0))).when(F.col("runtime").isin(INLINING), F.col("lens_routers") > 0).otherwise(False)
    r = r.withColumn("tool_evidence", by_tool).withColumn("evidence", F.col("tool_evidence") | (F.col("runtime").isin(INLINING) & F.col("inlined_contract") & F.col("inlined_quality")))
    r = r.withColumn("activity", F.col("spoken") | (F.col("calls") > 0)).withColumn("readable", ~F.col("unreadable"))
    ms = F.unix_micros(F.col("done").cast("timestamp")) - F.unix_micros(F.col("opened").cast("timestamp"))
    return r.select("run_id", "runtime", F.when(F.col("lines") > 0, F.coalesce("round", F.lit(0).cast("long"))).alias("review_iterations"), F.col("evidence").alias("fan_out_dispatched"), "contamination_reports", F.col("criteria_unverified").cast("long").alias("criteria_unverified"), F.when(F.col("edits") >= 2, F.floor(ms / 1000)).alias("open_to_done_ms"), "committed", classify_run().alias("class"))


def attempt_responses(attempts: DataFrame, responses: DataFrame) -> DataFrame:
    """The whole text (raw; null: empty) of the response that each attempt paired with, by run, lens, round and attempt.

    Attempts without a response, or whose response is gone, have no row; of repeated responses one is taken.
    """
    raw = responses.where("response_id <> ''").groupBy("response_id").agg(F.coalesce(F.max("raw"), F.lit("")).alias("raw"))
    return attempts.where("response_id <> ''").select("run_id", "lens", "round", "attempt", "response_id").join(raw, "response_id").select("run_id", "lens", "round", "attempt", "raw")


def number_attempts(attempts: DataFrame) -> DataFrame:
    """H7: the number of each attempt of a lens in a round, whether a later one supersedes it, and its order in the run.

    attempts: run_id, lens, round, at, attempt_id.
    """
    w = Window.partitionBy("run_id", "lens", "round").orderBy("at", "attempt_id")
    rows = attempts.withColumn("attempt", F.row_number().over(w)).withColumn("superseded", F.lead("attempt_id").over(w).isNotNull())
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("round", "lens", "attempt"))
    return rows.withColumn("place", place)


def missing_attempts(committed: DataFrame, attempts: DataFrame) -> DataFrame:
    """H7: lenses that a run committed to (run_id, lens) and never attempted."""
    return committed.select("run_id", "lens").distinct().join(attempts, ["run_id", "lens"], "left_anti")


def truth_similarity() -> Column:
    """Of reference (r_) and candidate (c_) title words, claim words and evidence paths; 1 where the ids are equal."""
    jaccard = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    score = 0.4 * jaccard("r_title", "c_title") + 0.4 * jaccard("r_claim", "c_claim") + F.when(F.arrays_overlap("r_paths", "c_paths"), 0.2).otherwise(0.0)
    return F.when(F.col("r_id") == F.col("c_id"), 1.0).otherwise(F.least(score, F.lit(1.0)))


def greedy_match(pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """One-to-one matches of each session, best scores first (ties: reference order, then candidate order).

    pairs: session, ref, cand, score; rows: about how many, so that tasks don't grow with them. Of a session only the references
    and candidates that are taken are kept.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, refs, cands = None, set(), set()
        for batch in batches:
            some = []
            for k, (s, ref, cand) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if (s,) != session:
                    session, refs, cands = (s,), set(), set()
                if ref not in refs and cand not in cands:
                    refs.add(ref)
                    cands.add(cand)
                    some.append(k)
            yield batch.take(pa.array(some, pa.int64()))

    kinds = dict(pairs.dtypes)
    score = F.col("score").cast("double")
    best = F.desc_nulls_last(F.when(~F.isnan(score), score))
    ordered = dealt(pairs.select("session", "ref", "cand", score.alias("score")), rows, "session").sortWithinPartitions("session", best, "ref", "cand")
    return ordered.mapInArrow(match, f"session {kinds['session']}, ref {kinds['ref']}, cand {kinds['cand']}, score double")


def eval_matrix(results: DataFrame, configs: list[str]) -> DataFrame:
    """Mean score of each session (rows) under each configuration (columns)."""
    return results.groupBy("session").pivot("config", configs).agg(F.avg("score"))


def human_execution_faults(records: DataFrame) -> DataFrame:
    """records that break the rules of human executions: no agent or session of its own or so far, and a parent.

    A record that breaks a rule is not merged, so the rule for later ones depends on it: a fold in order within each execution.
    records: execution_id, seq, execution_kind, agent, session_id, parent_execution_id.
    """

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        have = {"execution_kind": "", "agent": "", "session_id": "", "parent_execution_id": ""}
        out = []
        for r in pdf.sort_values("seq").to_dict("records"):
            new = {k: (r[k] if isinstance(r[k], str) else "") for k in have}
            fault = None
            if (new["execution_kind"] or have["execution_kind"]) == "human":
                if new["agent"]:
                    fault = "agent"
                elif new["session_id"]:
                    fault = "session_id"
                elif have["agent"] or have["session_id"]:
                    fault = "execution_kind"
                elif not (new["parent_execution_id"] or have["parent_execution_id"]):
                    fault = "parent_execution_id"
            if fault:
                out.append((r["execution_id"], int(r["seq"]), fault))
            else:
                have = {k: new[k] or have[k] for k in have}
        return pd.DataFrame(out, columns=["execution_id", "seq", "fault"])

    return records.groupBy("execution_id").applyInPandas(check, "execution_id string, seq long, fault string")


def attach_subagents(spans: DataFrame, dispatches: DataFrame, recorded: DataFrame) -> DataFrame:
    """dispatches in an invocation's turns that no recorded execution has by dispatch id or transcript.

    spans: agent, session_id, idx, last_idx, run_id; dispatches: agent, session_id, turn_idx, tool_use_id, transcript.
    """
    inside = (F.col("turn_idx") >= F.col("idx")) & (F.col("last_idx").isNull() | (F.col("turn_idx") <= F.col("last_idx")))
    both = spans.join(dispatches, ["agent", "session_id"]).where(inside)
    free = both.join(recorded.where("dispatch_id is not null").select("run_id", F.col("dispatch_id").alias("tool_use_id")), ["run_id", "tool_use_id"], "left_anti")
    return free.join(recorded.where("transcript is not null").select("run_id", "transcript"), ["run_id", "transcript"], "left_anti").select("run_id", "tool_use_id", "turn_idx", "transcript")
