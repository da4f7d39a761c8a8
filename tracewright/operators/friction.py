"""Friction: recurring errors ranked by density (M1) and planning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import normalize_remote


def friction_rank(events: DataFrame, top: int | None = None) -> DataFrame:
    """M1: groups of (kind, signature) by events per active UTC day; an event without time counts to no day.

    ``events`` has session_id, ts, kind, signature.
    """
    got = events.groupBy("kind", "signature").agg(
        F.count("*").alias("events"),
        F.count_distinct(F.to_date("ts")).alias("active_days"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif("session_id", F.lit("")))).alias("sessions"),
    )
    got = got.withColumn("per_active_day", F.when(F.col("active_days") > 0, F.col("events") / F.col("active_days")).otherwise(F.lit(0.0)))
    got = got.orderBy(F.desc("per_active_day"), F.desc("events"), "signature", "kind")
    return got if top is None else got.limit(top)


def session_sources(sessions: DataFrame, since: Column) -> DataFrame:
    """M4: top-level sessions summarised since a time that have a source, newest first."""
    return sessions.where((F.col("start_time") >= since) & F.col("cwd").isNotNull() & F.col("parent_session_id").isNull()).select("agent", "session_id", "cwd", "start_time").orderBy(F.desc("start_time"), "agent", "session_id")


def plan_backfill(sessions: DataFrame, visited: DataFrame, scopes: DataFrame, least_turns: int, active_since: Column, agents: list[str], most: int) -> DataFrame:
    """M5: what becomes of each session in a backfill: the first gate that holds it back, or its place among the accepted.

    Gates in order: visited, agent, too few turns (an unknown count passes), unreadable, active, no scope, over the limit.
    """
    rows = sessions.join(visited.select("agent", "session_id").distinct().withColumn("seen", F.lit(True)), ["agent", "session_id"], "left").join(scopes.select("scope").distinct().withColumn("known", F.lit(True)), "scope", "left")
    reason = (
        F.when(F.col("seen"), "visited")
        .when(~F.col("agent").isin(agents), "agent")
        .when(F.col("turn_count") < least_turns, "min-turns")
        .when(F.col("cwd").isNull(), "unreadable")
        .when(F.col("start_time") >= active_since, "active")
        .when(F.col("scope").isNull() | F.col("known").isNull(), "no-scope")
    )
    rows = rows.withColumn("reason", reason)
    # the limit counts accepted sessions only; a task hands on its first ``most`` of them
    first = rows.where("reason is null").select("agent", "session_id", "start_time").orderBy(F.desc("start_time"), "agent", "session_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("start_time"), "agent", "session_id"))
    first = first.select("agent", "session_id", place.alias("place"))
    rows = rows.join(first, ["agent", "session_id"], "left")
    return rows.select("agent", "session_id", F.when(F.col("reason").isNull() & F.col("place").isNull(), "limit").otherwise(F.col("reason")).alias("reason"), "place")


def resolve_scope(sessions: DataFrame, markers: DataFrame, scopes: DataFrame) -> DataFrame:
    """M6: a session's scope: that of its directory's marker, else the last part of its remote; only if such a scope exists."""
    guess = F.regexp_extract(normalize_remote(F.coalesce("git_remote", F.lit(""))), "([^/]+)$", 1)
    got = sessions.join(markers.select("cwd", F.col("scope").alias("marked")), "cwd", "left").withColumn("guess", F.coalesce("marked", F.nullif(guess, F.lit(""))))
    return got.join(scopes.select(F.col("scope").alias("guess"), F.col("scope")), "guess", "left").drop("guess", "marked")


def scope_collisions(resolved: DataFrame) -> DataFrame:
    """M7: scopes that sessions of two or more remotes resolve to."""
    remote = F.nullif(normalize_remote(F.coalesce("git_remote", F.lit(""))), F.lit(""))
    return resolved.where("scope is not null").groupBy("scope").agg(F.count_distinct(remote).alias("remotes")).where("remotes > 1")


def stamp_asof(sessions: DataFrame, stamps: DataFrame) -> DataFrame:
    """M8: the newest stamp of a throwaway directory at or before the session's start (the newest of all if it has none).

    One row a session; a stamp without directory or time counts for none. Sessions and stamps are walked in order of time
    within a directory and day, beginning with the newest stamp of the days before. So no session meets all stamps, and
    the sessions of one directory are dealt over many tasks.
    """
    day = F.coalesce(F.to_date("at"), F.lit("9999-12-31").cast("date"))
    stamp = F.struct("stamped_at", "project_cwd").alias("stamp")
    told = stamps.where("work_root is not null and stamped_at is not null").select(F.col("work_root").alias("cwd"), F.col("stamped_at").alias("at"), stamp).withColumn("day", day)
    asked = sessions.select("agent", "session_id", "cwd", F.col("start_time").alias("at")).withColumn("day", day)
    days = told.select("cwd", "day", "stamp").unionByName(asked.select("cwd", "day").where("cwd is not null"), allowMissingColumns=True).groupBy("cwd", "day").agg(F.max("stamp").alias("newest"))
    earlier = Window.partitionBy("cwd").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("cwd", "day", F.max("newest").over(earlier).alias("before"))
    both = told.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True).join(before, ["cwd", "day"], "left")
    # a stamp comes before the sessions of its moment
    upto = Window.partitionBy("cwd", "day").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("last", F.coalesce(F.max("stamp").over(upto), "before")).where("asks")
    return both.select("agent", "session_id", "last.project_cwd", "last.stamped_at")


def liveness(commits: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Projects whose last commit is more than ``days`` days old are inert."""
    got = commits.where("git_remote <> ''").groupBy(normalize_remote(F.col("git_remote")).alias("project")).agg(F.max("committed_at").alias("last_commit"))
    return got.withColumn("inert", F.coalesce(F.datediff(now, F.to_date("last_commit")) > days, F.lit(True)))


def scope_status(scopes: DataFrame, resolved: DataFrame) -> DataFrame:
    """How many sessions resolve to each scope (0 for none), and how many remotes they have."""
    remote = F.nullif(normalize_remote(F.coalesce("git_remote", F.lit(""))), F.lit(""))
    n = resolved.where("scope is not null").groupBy("scope").agg(F.count("*").alias("sessions"), F.count_distinct(remote).alias("remotes"))
    return scopes.select("scope").distinct().join(n, "scope", "left").select("scope", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("remotes", F.lit(0)).alias("remotes"), F.coalesce(F.col("remotes") > 1, F.lit(False)).alias("collides"))


def evidence_missing(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence paths (id, path) that the file listing (path) does not have."""
    return evidence.join(files.select("path").distinct(), "path", "left_anti")


def route_destination(drafts: DataFrame) -> DataFrame:
    """M9: where a draft goes by its kind and sections, or why it is dropped."""
    truth = F.col("body").contains("## Claim") & F.col("body").contains("## How to verify")
    ticket = F.col("body").contains("## Problem") & F.col("ticket_type").isin("bug", "feature", "task", "chore")
    to = F.when(F.col("kind").isin("truth", "decision") & truth, F.col("kind")).when((F.col("kind") == "ticket") & ticket, F.lit("ticket"))
    why = F.when(to.isNotNull(), None).when(F.col("kind").isin("truth", "decision"), "sections missing").when(F.col("kind") == "ticket", "problem or type missing").otherwise("unknown kind")
    return drafts.withColumn("destination", to).withColumn("dropped", why)


def route_scope(drafts: DataFrame, scopes: DataFrame) -> DataFrame:
    """The declared scope if it exists, else the requested one with a note."""
    known = scopes.select(F.col("scope").alias("found")).distinct()
    got = drafts.join(known, F.col("declared") == F.col("found"), "left")
    return got.withColumn("scope", F.coalesce("found", "requested")).withColumn("note", F.when(F.col("declared").isNotNull() & F.col("found").isNull(), F.concat(F.lit("unknown scope "), F.col("declared")))).drop("found")
