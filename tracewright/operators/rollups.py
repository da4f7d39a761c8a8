"""Dashboard rollups (D) over sessions, tool calls, commits and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import first_non_empty, normalize_remote, split_worktree
from tracewright.functions.tables import placed

KEY = ["agent", "session_id"]


def project_metrics(sessions: DataFrame) -> DataFrame:
    """Sessions and their counters by project; a project without measured counters keeps nulls."""
    return sessions.where(F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("sessions"), F.sum("turn_count").alias("turns"), F.sum("tool_call_count").alias("tool_calls"), F.sum("error_count").alias("errors"))


def mean_ms(total: Column, timed: Column) -> Column:
    """Half-up integer mean; null when nothing was timed."""
    return F.when(timed > 0, F.floor((total + F.floor(timed / 2)) / timed).cast("long"))


def tool_stats(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls, errors and timing by project and tool kind."""
    named = sessions.where(F.col("project").isNotNull()).select(*KEY, "project")
    timed = F.col("duration_ms") >= 0
    got = calls.join(named, KEY).groupBy("project", F.coalesce("tool_kind", F.lit("other")).alias("tool_kind")).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.count_if(timed).alias("timed"), F.coalesce(F.sum(F.when(timed, F.col("duration_ms"))), F.lit(0)).alias("total_ms"))
    return got.withColumn("avg_ms", mean_ms(F.col("total_ms"), F.col("timed")))


def count_by_project(sessions: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """D3: rows of a child table by project."""
    return children.select(*KEY).join(sessions.where(F.col("project").isNotNull()).select(*KEY, "project"), KEY).groupBy("project").agg(F.count("*").alias(name))


def top_level(sessions: DataFrame) -> DataFrame:
    """Without the child sessions of agent A."""
    return sessions.where((F.col("agent") != "claude-code") | F.coalesce(F.col("parent_session_id"), F.lit("")).eqNullSafe(""))


def repo_of() -> Column:
    return first_non_empty(F.col("git_remote"), F.col("cwd_raw"), F.col("cwd"), F.col("project"))


def activity_sessions(sessions: DataFrame, since: Column) -> DataFrame:
    """Top-level sessions started at or after ``since``, newest first."""
    return top_level(sessions).where(F.col("start_time") >= since).select(*KEY, repo_of().alias("repo"), "start_time").orderBy(F.desc("start_time"), *KEY)


def activity_commits(commits: DataFrame, since: Column) -> DataFrame:
    """Commits at or after ``since``, newest first."""
    return commits.where(F.col("committed_at") >= since).select(*KEY, "commit_hash", "subject", first_non_empty(F.col("git_remote"), F.col("cwd")).alias("repo"), "committed_at").orderBy(F.desc("committed_at"), *KEY)


def activity_repos(sessions: DataFrame, commits: DataFrame, since: Column) -> DataFrame:
    """Sessions and commits by repository since ``since``."""
    name = F.coalesce("repo", F.lit("unknown"))
    s = activity_sessions(sessions, since).groupBy(name.alias("repo")).agg(F.count("*").alias("sessions"))
    c = activity_commits(commits, since).groupBy(name.alias("repo")).agg(F.count("*").alias("commits"))
    both = s.join(c, "repo", "full_outer").select("repo", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("commits", F.lit(0)).alias("commits"))
    return both.orderBy(F.desc("commits"), F.desc("sessions"), "repo")


def identity_key() -> Column:
    """The project that a session belongs to: its remote, else its directory, else its slug."""
    remote = F.nullif(normalize_remote(F.coalesce("git_remote", F.lit(""))), F.lit(""))
    slug, _ = split_worktree(F.col("project"))
    return F.coalesce(F.concat(F.lit("remote:"), remote), F.concat(F.lit("cwd:"), F.nullif(F.col("cwd_raw"), F.lit(""))), F.concat(F.lit("slug:"), slug))


def identity_rollup(sessions: DataFrame) -> DataFrame:
    """By identity: agents, slugs, worktrees, bytes and last activity."""
    slug, tree = split_worktree(F.col("project"))
    rows = sessions.withColumn("identity", identity_key()).withColumn("slug", slug).withColumn("worktree", F.nullif(tree, F.lit(""))).where(F.col("identity").isNotNull())
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("identity").agg(distinct("agent").alias("agents"), distinct("slug").alias("slugs"), distinct("worktree").alias("worktrees"), F.count("*").alias("sessions"), F.sum("source_size").alias("bytes"), F.max("start_time").alias("last_activity"))


def merge_tools(stats: DataFrame, slugs: DataFrame) -> DataFrame:
    """Tool statistics of an identity's slugs (identity, slug), merged from sums; most calls first."""
    got = stats.join(slugs, F.col("project") == F.col("slug")).groupBy("identity", "tool_kind").agg(*(F.sum(c).alias(c) for c in ("calls", "errors", "timed", "total_ms")))
    return got.withColumn("avg_ms", mean_ms(F.col("total_ms"), F.col("timed"))).orderBy("identity", F.desc("calls"), "tool_kind")


def top_tools(merged: DataFrame, most: int = 6) -> DataFrame:
    """The tools that an identity calls most."""
    rank = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("calls"), "tool_kind"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= most)


PROJECT_SORTS = {
    "sessions": ["sessions desc", "project"],
    "turns": ["turns desc nulls last", "project"],
    "tool_calls": ["tool_calls desc nulls last", "project"],
    "errors": ["errors desc nulls last", "project"],
    "name": ["project"],
    "activity": ["turns desc nulls last", "tool_calls desc nulls last", "project"],
}
IDENTITY_SORTS = {
    "agents": ["agents", "identity"],
    "size": ["bytes desc nulls last", "identity"],
    "seen": ["last_activity desc nulls last", "identity"],
}


def sort_columns(keys: list[str]) -> list[Column]:
    """Columns to sort by from keys such as ``x desc nulls last``."""
    out = []
    for k in keys:
        name, *way = k.split()
        c = F.col(name)
        out.append((c.desc_nulls_last() if "last" in way else c.desc()) if "desc" in way else (c.asc_nulls_last() if "last" in way else c.asc()))
    return out


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in that order."""
    return df.orderBy(*sort_columns(keys))


def ranked(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """The rows with their place in that order."""
    return placed(df, sort_columns(keys), name)


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """How many tickets by status, type and priority."""
    count = lambda c: tickets.groupBy(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("tickets"))
    return count("status").union(count("type")).union(count("priority"))


def next_tickets(tickets: DataFrame, most: int = 5) -> DataFrame:
    """The first open and ready tickets by priority and age."""
    rank = F.row_number().over(Window.partitionBy("status").orderBy("priority", "created", "id"))
    return tickets.where(F.col("status").isin("open", "ready")).withColumn("rank", rank).where(F.col("rank") <= most).select("status", "rank", "id", "priority")


def ticket_activity(tickets: DataFrame, since: Column) -> DataFrame:
    """Tickets created and closed since ``since``, newest first."""
    made = tickets.where(F.col("created") >= since).select("id", F.lit("created").alias("event"), F.col("created").alias("at"))
    done = tickets.where(F.col("closed") >= since).select("id", F.lit("closed").alias("event"), F.col("closed").alias("at"))
    return made.union(done).orderBy(F.desc("at"), "id", "event")


def display_cost(runs: DataFrame) -> DataFrame:
    """The total cost, else what is priced of it, flagged partial."""
    part = F.when(F.col("parent_cost").isNotNull() | (F.col("priced_children_cost") > 0), F.coalesce("parent_cost", F.lit(0.0)) + F.coalesce("priced_children_cost", F.lit(0.0)))
    return runs.withColumn("shown_cost", F.coalesce("total_cost", part)).withColumn("partial", F.col("total_cost").isNull() & F.col("shown_cost").isNotNull())
