"""Bug attribution (I) and project state (J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import split_namespaced, ticket_marker


def with_marker(commits: DataFrame) -> DataFrame:
    return commits.withColumn("marker", ticket_marker(F.col("subject")))


def fix_commits(commits: DataFrame, bugs: DataFrame) -> DataFrame:
    """Commits whose marker is a bug's qualified or bare id."""
    _, bare = split_namespaced(F.col("ticket"))
    ids = bugs.select("ticket", F.explode(F.array_distinct(F.array(F.col("ticket"), bare))).alias("marker"))
    return with_marker(commits).where("marker is not null").join(ids, "marker").select("ticket", "commit_hash", "session_id").distinct()


def resolve_short(short: DataFrame, full: DataFrame) -> DataFrame:
    """The one full hash that a short one (of seven characters or more) begins; null if there is none or several.

    An equality on the first seven characters, the rest as a residual test.
    """
    s = short.where(F.length("short_hash") >= 7).select("short_hash", F.substring("short_hash", 1, 7).alias("head")).distinct()
    f = full.select("hash", F.substring("hash", 1, 7).alias("head")).distinct()
    both = s.join(f, "head").where(F.startswith(F.col("hash"), F.col("short_hash"))).groupBy("short_hash").agg(F.count("*").alias("n"), F.min("hash").alias("hash"))
    return short.select("short_hash").distinct().join(both, "short_hash", "left").select("short_hash", F.when(F.col("n") == 1, F.col("hash")).alias("hash"))


def first_owner(commits: DataFrame, *also: str) -> DataFrame:
    """The session that owns a commit: the first row in time (nulls last), with columns ``also``."""
    n = F.row_number().over(Window.partitionBy("commit_hash").orderBy(F.asc_nulls_last("committed_at"), "agent", "session_id"))
    return commits.withColumn("n", n).where("n = 1").select("commit_hash", "agent", "session_id", "committed_at", *also)


def owner_parent(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """A child session's commits belong to its parent; a child whose parent is unknown drops."""
    s = sessions.select("agent", "session_id", "parent_session_id")
    got = commits.join(s, ["agent", "session_id"]).withColumn("owner", F.coalesce("parent_session_id", "session_id"))
    return got.join(sessions.select("agent", F.col("session_id").alias("owner")), ["agent", "owner"], "left_semi").select("agent", "owner", "commit_hash")


# Fixed value: where a repository keeps output rather than authored lines.
GENERATED = ["tests/golden/"]


def blame_rollup(blame: DataFrame, fixes: DataFrame, generated: list[str] = GENERATED) -> DataFrame:
    """I4: lines of each commit that a bug's fix touched, paths that begin with one of ``generated`` and the bug's own fixes left out; most lines first."""
    made = reduce(lambda x, y: x | y, (F.col("path").startswith(p) for p in generated), F.lit(False))
    kept = blame.where(~made).join(fixes.select("ticket", F.col("commit_hash").alias("introducing_hash")), ["ticket", "introducing_hash"], "left_anti")
    return kept.groupBy("ticket", "introducing_hash").agg(F.count("*").alias("lines")).orderBy("ticket", F.desc("lines"), "introducing_hash")


def attribute(bugs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Single, multi or unattributable, with the reason."""
    n = rollup.groupBy("ticket").agg(F.count("*").alias("commits"))
    got = bugs.select("ticket", "fixes").join(n, "ticket", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    cls = F.when(F.col("commits") == 1, "single").when(F.col("commits") > 1, "multi").otherwise("unattributable")
    why = F.when(F.col("commits") == 0, F.when(F.col("fixes") == 0, "no fix commit").otherwise("no blamed lines"))
    return got.select("ticket", "commits", cls.alias("class"), why.alias("reason"))


def class_counts(attributed: DataFrame) -> DataFrame:
    """I8: bugs by class and reason, most first."""
    return attributed.groupBy("class", "reason").agg(F.count("*").alias("bugs")).orderBy(F.desc("bugs"), "class", "reason")


SLICE = ["agent", "model", "cli_version"]


def credit_slices(rollup: DataFrame, attributed: DataFrame, owners: DataFrame) -> DataFrame:
    """By agent, model and version: commits, those that introduced a bug, the credit, of which each bug gives one in equal parts, and the share that introduced one."""
    share = rollup.join(attributed.select("ticket", F.col("commits").alias("n")), "ticket").withColumn("credit", F.lit(1.0) / F.col("n"))
    of = share.groupBy(F.col("introducing_hash").alias("commit_hash")).agg(F.sum("credit").alias("credit"))
    named = owners.select("commit_hash", *(F.coalesce(c, F.lit("")).alias(c) for c in SLICE)).distinct()
    got = named.join(of, "commit_hash", "left").groupBy(*SLICE).agg(F.count("*").alias("commits"), F.count("credit").alias("introducing"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"))
    return got.withColumn("rate", F.col("introducing") / F.col("commits"))


def precision(rollup: DataFrame, attributed: DataFrame, labels: DataFrame) -> DataFrame:
    """Of labelled bugs of the class single, the share whose commit is the labelled one."""
    single = attributed.where("class = 'single'").join(rollup, "ticket").join(labels, "ticket")
    return single.agg(F.count("*").alias("labelled"), F.count_if(F.array_contains("introducing", F.col("introducing_hash"))).alias("right")).withColumn("precision", F.col("right") / F.nullif(F.col("labelled"), F.lit(0)))


def sessions_for_tickets(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions with a commit that marks a wanted ticket, by the first such commit's time."""
    return with_marker(commits).join(wanted.select(F.col("ticket").alias("marker")).distinct(), "marker", "left_semi").groupBy("agent", "session_id").agg(F.min("committed_at").alias("first_commit")).orderBy(F.asc_nulls_first("first_commit"), "agent", "session_id")


def expand_epics(wanted: DataFrame, tickets: DataFrame) -> DataFrame:
    """A wanted ticket and its children."""
    child = tickets.join(wanted.select(F.col("ticket").alias("parent")), "parent").select(F.col("id").alias("ticket"))
    return wanted.select("ticket").union(child).distinct()


def project_state(scopes: DataFrame, commits: DataFrame, sessions: DataFrame, tickets: DataFrame, since: Column, until: Column) -> DataFrame:
    """Per scope what happened in [since, until): a commit counts for its marker's namespace, else its session's scope, and once per (scope, hash).

    commits: scope, commit_hash, committed_at; sessions: scope, start_time, end_time; tickets: scope, status, closed.
    """
    window = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    c = commits.groupBy("scope", "commit_hash").agg(F.min("committed_at").alias("committed_at")).groupBy("scope").agg(F.count_if(window("committed_at")).alias("commits_in_window"), F.max("committed_at").alias("last_commit_at"))
    overlap = (F.coalesce("end_time", "start_time") >= since) & (F.col("start_time") < until)
    s = sessions.groupBy("scope").agg(F.count_if(overlap).alias("sessions_in_window"), F.max(F.coalesce("end_time", "start_time")).alias("last_session_at"))
    t = tickets.groupBy("scope").agg(F.count_if(F.col("status") != "closed").alias("open_tickets"), F.count_if(window("closed")).alias("tickets_closed_in_window"), F.max("closed").alias("last_ticket_closed_at"))
    got = scopes.select("scope").distinct()
    for part in (c, s, t):
        got = got.join(part, "scope", "left")
    counts = ["commits_in_window", "sessions_in_window", "open_tickets", "tickets_closed_in_window"]
    got = got.select("scope", *(F.coalesce(x, F.lit(0)).alias(x) for x in counts), "last_commit_at", "last_session_at", "last_ticket_closed_at")
    return got.withColumn("dormant", (F.col("commits_in_window") == 0) & (F.col("sessions_in_window") == 0) & (F.col("tickets_closed_in_window") == 0))


def ticket_signals(tickets: DataFrame, since: Column, until: Column) -> DataFrame:
    """New, done (both can hold), or edited if neither holds."""
    window = lambda c: F.coalesce((F.col(c) >= since) & (F.col(c) < until), F.lit(False))
    new, done = window("created"), window("closed")
    signals = F.filter(F.array(F.when(new, "new"), F.when(done, "done"), F.when(~new & ~done & window("updated"), "edited")), lambda x: x.isNotNull())
    return tickets.select("id", signals.alias("signals")).where(F.size("signals") > 0)


def ticket_sessions(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Under each marked ticket its sessions, by start (nulls last) and id, each with its commits."""
    marked = with_marker(commits).where("marker is not null").groupBy("marker", "agent", "session_id").agg(F.array_sort(F.collect_set("commit_hash")).alias("commits"))
    rows = marked.join(sessions.select("agent", "session_id", "start_time"), ["agent", "session_id"])
    item = F.struct(F.col("start_time").isNull().alias("late"), "start_time", "agent", "session_id", "commits")
    return rows.groupBy(F.col("marker").alias("ticket")).agg(F.count("*").alias("sessions"), F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["session_id"], F.concat_ws("+", x["commits"]))).alias("order"))


def unticketed(sessions: DataFrame, commits: DataFrame, since: Column, until: Column) -> DataFrame:
    """Sessions active in [since, until) that have no marked commit."""
    overlap = (F.coalesce("end_time", "start_time") >= since) & (F.col("start_time") < until)
    marked = with_marker(commits).where("marker is not null").select("agent", "session_id")
    return sessions.where(overlap).join(marked, ["agent", "session_id"], "left_anti").select("agent", "session_id", "start_time")


def cwd_namespace(sessions: DataFrame, checkouts: DataFrame) -> DataFrame:
    """The namespace of the longest checkout that holds a session's directory.

    A directory has few ancestors: they are exploded and met by equality, so no prefix is compared with every checkout.
    """
    parts = F.split(F.col("cwd"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = sessions.where("cwd is not null").select("agent", "session_id", F.explode(up).alias("path"))
    got = rows.join(checkouts, "path").groupBy("agent", "session_id").agg(F.max_by("namespace", F.length("path")).alias("namespace"))
    return sessions.select("agent", "session_id").join(got, ["agent", "session_id"], "left")
