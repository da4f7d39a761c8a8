"""Execution registry (F): folding of records into runs and executions, and the run trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.tables import written


def last_known(column: str, order: Column) -> Column:
    """The last value of a column that is not null, in the given order."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(column)


def fold(records: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """one row per key: of each column the last non-null value."""
    return records.groupBy(key).agg(*(last_known(c, order) for c in columns), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"), F.count("*").alias("records"))


def freeze_run(records: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(records that agree with the run of their execution's first record, the others as identity conflicts)."""
    first = F.min_by("run_id", order).over(Window.partitionBy("execution_id"))
    marked = records.withColumn("first_run", first)
    return marked.where(F.col("run_id").eqNullSafe(F.col("first_run"))).drop("first_run"), marked.where(~F.col("run_id").eqNullSafe(F.col("first_run"))).select("execution_id", "run_id", F.lit("identity_conflict").alias("code"))


def validate(records: DataFrame, kinds: list[str], outcomes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid records, diagnostics with the first code that applies)."""
    code = F.when(F.col("v") != 1, "unsupported_version").when(F.coalesce("run_id", F.lit("")) == "", "missing_run_id").when(F.coalesce("execution_id", F.lit("")) == "", "missing_execution_id").when(~F.coalesce(F.col("execution_kind").isin(kinds), F.lit(False)), "unknown_execution_kind").when(F.col("outcome").isNotNull() & ~F.col("outcome").isin(outcomes), "unknown_outcome").when(F.col("ended_at") < F.col("started_at"), "ends_before_start")
    marked = records.withColumn("code", code)
    return marked.where("code is null").drop("code"), marked.where("code is not null").select("execution_id", "run_id", "code")


def unresolved(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """executions whose run is unknown, or whose parent is not in the same run."""
    no_run = executions.join(runs.select("run_id"), "run_id", "left_anti").select("execution_id", "run_id", F.lit("unresolved_run").alias("code"))
    parents = executions.select("run_id", F.col("execution_id").alias("parent_execution_id"))
    no_parent = executions.where("parent_execution_id is not null").join(parents, ["run_id", "parent_execution_id"], "left_anti").select("execution_id", "run_id", F.lit("unresolved_parent").alias("code"))
    return no_run.union(no_parent)


def grown(first: DataFrame, step: Callable[[DataFrame], DataFrame], deepest: int, name: str) -> DataFrame:
    """A first level and all levels that ``step`` makes one of the other, each written to the shared folder; one deeper than ``deepest`` fails."""
    levels = [written(first, name)]
    while not levels[-1].isEmpty():
        if len(levels) > deepest + 1:
            raise RuntimeError(f"{name}: deeper than {deepest} levels")
        levels.append(written(step(levels[-1]), name))
    return reduce(DataFrame.union, levels)


def build_tree(executions: DataFrame, deepest: int = 64, trail: tuple[str, ...] = ("path", "walk"), keep: tuple[str, ...] = ()) -> DataFrame:
    """each execution with its depth, path and walk under its run's root, or what keeps it out: second_root, orphan, cyclic or invalid_parent.

    executions: one row a run_id and execution_id. The root is the first parentless ``root`` by (started_at, execution_id). Executions are numbered
    and parents found once, on (run, parent); a level is one join on the parent's number. What
    hangs below a second root or below an execution whose parent is missing has the state of that topmost one; what no top
    reaches is in a cycle or below one. A human hangs under the root alone: under any other parent it and what is below it have an
    invalid_parent. ``walk``: the keys of the ancestors, by which siblings go in the order of their starts. Of path and walk only those that
    ``trail`` names are made; ``keep`` names columns of executions that are returned as well.
    """
    human = F.coalesce(F.col("execution_kind") == "human", F.lit(False)).alias("human")
    nodes = executions.select("run_id", "execution_id", "parent_execution_id", "execution_kind", "started_at", *(c for c in keep if c != "execution_kind"))
    nodes = written(nodes.withColumn("no", F.monotonically_increasing_id()), "tree-executions")
    first = F.min_by("no", F.struct(F.col("started_at").isNull(), "started_at", "execution_id"))
    roots = nodes.where("parent_execution_id is null and execution_kind = 'root' and run_id is not null").groupBy("run_id").agg(first.alias("no")).select("no", F.lit(True).alias("is_root"))
    of_trail = [*(["execution_id"] if trail else []), *(["started_at"] if "walk" in trail else [])]
    parents = nodes.select("run_id", F.col("execution_id").alias("parent_execution_id"), F.col("no").alias("above"))
    linked = nodes.select("run_id", "parent_execution_id", "no", human, *of_trail).join(parents, ["run_id", "parent_execution_id"], "left")
    linked = written(linked.select("no", "above", F.col("parent_execution_id").isNotNull().alias("has_parent"), "human", *of_trail), "tree-links")
    state = F.when(F.col("is_root"), "placed").when(~F.col("has_parent"), "second_root").otherwise("orphan")
    key = F.struct(F.col("started_at").isNull().alias("untimed"), F.col("started_at").alias("at"), F.col("execution_id").alias("id"))
    # a walk tells its path
    own = {"walk": F.array(key)} if "walk" in trail else {"path": F.col("execution_id")} if trail else {}
    longer = {"walk": F.concat("walk", F.array(key))} if "walk" in trail else {"path": F.concat_ws("/", "path", "execution_id")} if trail else {}
    barred = F.col("barred") | (F.col("human") & ~((F.col("depth") == 0) & (F.col("state") == "placed")))
    edges = linked.where("above is not null").drop("has_parent")

    def step(level: DataFrame) -> DataFrame:
        both = level.withColumnRenamed("no", "above").join(edges, "above")
        return both.select("no", "state", (F.col("depth") + 1).alias("depth"), barred.alias("barred"), *(c.alias(n) for n, c in longer.items()))

    tops = linked.where("above is null").join(roots, "no", "left")
    reached = grown(tops.select("no", state.alias("state"), F.lit(0).alias("depth"), F.lit(False).alias("barred"), *(c.alias(n) for n, c in own.items())), step, deepest, "tree")
    got = nodes.select("no", "run_id", "execution_id", "parent_execution_id", *keep).join(reached, "no", "left").withColumn("state", F.when(F.col("barred"), "invalid_parent").otherwise(F.coalesce("state", F.lit("cyclic"))))
    under = lambda c: F.when(F.col("state") == "placed", c)
    path = F.array_join(F.transform("walk", lambda k: k["id"]), "/") if "walk" in trail else F.col("path")
    shown = {"path": path, "walk": F.col("walk")}
    return got.select("run_id", "execution_id", "parent_execution_id", under(F.col("depth")).alias("depth"), *([under(shown["path"]).alias("path")] if "path" in trail else []), "state", *([under(shown["walk"]).alias("walk")] if "walk" in trail else []), *keep)


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (run_id, ``keys``, at): how many spans of its keys hold ``at``, and agent, session_id and idx of the one where it is one.

    A span holds [started_at, until); without ``until`` only a session's last (no last_idx) is open, another's end is unknown and
    holds nothing, like a span or point without start or key. Starts and ends are steps of a running sum, so spans of one
    key never meet its points pair by pair; sums of whole days are carried over, so that a hot key is dealt by days. The open
    spans' places are summed with them: where one is open, the sums are its own place.
    """
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    held = spans.where(known & F.expr("started_at is not null and (until > started_at or until is null and last_idx is null)"))
    columns = list(dict.fromkeys([*keys, "agent", "session_id", "idx", "started_at", "until"]))
    placed = held.select(*columns, day("started_at").alias("born")).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "born").orderBy("started_at", "session_id", "idx")).cast("long"))
    placed = written(placed, "spans")
    marks = placed.select(*keys, "born", "place", F.explode(F.array(F.struct(F.col("started_at").alias("at"), F.lit(1).cast("long").alias("open")), F.struct(F.col("until").alias("at"), F.lit(-1).cast("long").alias("open")))).alias("m")).where("m.at is not null")
    steps = marks.select(*keys, F.col("m.at").alias("at"), F.lit(None).cast("string").alias("run_id"), F.col("m.open").alias("open"), (F.col("m.open") * F.col("born")).alias("born"), (F.col("m.open") * F.col("place")).alias("place"))
    zero = F.lit(0).cast("long")
    asked = points.where(known & F.col("at").isNotNull()).select(*keys, "at", "run_id", zero.alias("open"), zero.alias("born"), zero.alias("place"))
    sums = ["open", "born", "place"]
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = steps.unionByName(asked).withColumn("day", day("at")).groupBy(*keys, "day").agg(*(F.sum(c).alias(c) for c in sums))
    days = days.select(*keys, "day", *(F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in sums))
    within = Window.partitionBy(*keys, "day").orderBy("at", F.col("run_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.unionByName(asked).withColumn("day", day("at")).select(*keys, "day", "run_id", *(F.sum(c).over(within).alias(c) for c in sums)).where("run_id is not null")
    run = run.join(days, [*keys, "day"]).select(*keys, "run_id", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in sums))
    one = placed.select(*keys, "born", "place", F.col("agent").alias("of_agent"), F.col("session_id").alias("of_session"), F.col("idx").alias("of_idx"), F.lit(1).cast("long").alias("open"))
    got = run.join(one, [*keys, "born", "place", "open"], "left").select("run_id", F.col("open").alias("matches"), F.col("of_agent").alias("agent"), F.col("of_session").alias("session_id"), F.col("of_idx").alias("idx"))
    return points.select("run_id").join(got, "run_id", "left").withColumn("matches", F.coalesce("matches", zero))


def spanning_invocation(runs: DataFrame, invocations: DataFrame) -> DataFrame:
    """F8: the invocation of a run: the only one of its session, else the one whose time span holds the run's start; else none."""
    only = invocations.groupBy("agent", "session_id").agg(F.count("*").alias("of_session"), F.min("idx").alias("only_idx")).where("of_session = 1")
    held = stabbed(runs.select("run_id", "agent", "session_id", F.col("started_at").alias("at")), invocations, ["agent", "session_id"]).select("run_id", "idx")
    got = runs.select("run_id", "agent", "session_id").join(only, ["agent", "session_id"], "left").join(held, "run_id")
    return got.select("run_id", F.coalesce("only_idx", "idx").alias("idx"))


def infer_invocation(runs: DataFrame, invocations: DataFrame) -> DataFrame:
    """for runs without a transcript: the one invocation of the same runtime (``agent``) and ticket, both named, whose span holds the start; several are ambiguous."""
    named = F.when(F.col("ticket") != "", F.col("ticket"))
    got = stabbed(runs.select("run_id", F.col("agent"), named.alias("ticket"), F.col("started_at").alias("at")), invocations, ["agent", "ticket"])
    return got.select("run_id", "matches", "session_id", "idx", F.when(F.col("matches") > 1, "ambiguous_transcript").alias("diagnostic"))


def declared_transcripts(runs: DataFrame, executions: DataFrame, invocations: DataFrame) -> DataFrame:
    """one row a run: its transcript, on what evidence it stands (basis), and the invocation it is read under.

    First what the run's record names (an agent or a session), then what its root names, both ``declared``. A run that names
    neither and says root_transcript ``none`` has basis ``none`` and joins nothing. Any other takes the one invocation of its
    runtime and ticket whose span holds its start (``invocation``), and so does its root; with several it stays without,
    as ambiguous_join. The root is the first parentless execution of kind root by (started_at, execution_id).
    Names that are null or empty are missing; a run without root has null root columns; no run is dropped.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    order = F.struct(F.col("started_at").isNull(), "started_at", "execution_id")
    top = executions.where("coalesce(parent_execution_id, '') = '' and execution_kind = 'root'")
    roots = top.groupBy("run_id").agg(F.min_by(F.struct("execution_id", text("agent").alias("agent"), text("session_id").alias("session_id")), order).alias("root"))
    r = runs.select("run_id", "runtime", "ticket", "root_transcript", "started_at", text("agent").alias("agent"), text("session_id").alias("session_id")).join(roots, "run_id", "left")
    own = F.col("agent").isNotNull() | F.col("session_id").isNotNull()
    by_root = F.col("root.agent").isNotNull() | F.col("root.session_id").isNotNull()
    said = F.when(own, F.struct("agent", "session_id")).when(by_root, F.struct("root.agent", "root.session_id"))
    r = written(r.select("run_id", "runtime", "ticket", "root_transcript", "started_at", "root", said.alias("said")), "run-evidence")
    spanning = spanning_invocation(r.where("said is not null").select("run_id", "said.agent", "said.session_id", "started_at"), invocations).select("run_id", F.col("idx").alias("said_idx"))
    open_runs = r.where("said is null and not root_transcript <=> 'none'").select("run_id", text("runtime").alias("agent"), "ticket", "started_at")
    inferred = infer_invocation(open_runs, invocations).select("run_id", "matches", "session_id", F.col("idx").alias("open_idx"))
    got = r.join(spanning, "run_id", "left").join(inferred, "run_id", "left")
    found = F.when(F.col("matches") == 1, F.struct(F.col("runtime").alias("agent"), "session_id"))
    basis = F.when(F.col("said").isNotNull(), "declared").when(F.expr("root_transcript <=> 'none'"), "none").when(found.isNotNull(), "invocation")
    of_root = F.when(F.col("root").isNotNull(), F.when(found.isNotNull(), found).otherwise(F.struct("root.agent", "root.session_id")))
    final = got.select("run_id", F.coalesce("said", found).alias("t"), basis.alias("basis"), F.coalesce("said_idx", "open_idx").alias("idx"), F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.col("root.execution_id").alias("root_execution_id"), of_root.alias("of_root"))
    return final.select("run_id", "t.agent", "t.session_id", "basis", "idx", "root_execution_id", F.col("of_root.agent").alias("root_agent"), F.col("of_root.session_id").alias("root_session_id"), F.when(F.col("matches") > 1, "ambiguous_join").alias("diagnostic"), F.when(F.col("matches") > 1, F.col("matches")).alias("invocations"))


def historical_runs(invocations: DataFrame, claimed: DataFrame) -> DataFrame:
    """a run for each invocation that no record claims."""
    rest = invocations.join(claimed.select("agent", "session_id", "idx").where("idx is not null"), ["agent", "session_id", "idx"], "left_anti")
    return rest.select(F.concat_ws(":", F.lit("transcript"), "agent", "session_id", "idx").alias("run_id"), "agent", "session_id", "idx", "ticket", "started_at")


def descendants(sessions: DataFrame, deepest: int = 32) -> DataFrame:
    """(root session, session, depth) over parent links, each path without repeats."""
    links = written(sessions.select("agent", "session_id", "parent_session_id"), "child-sessions")
    edges = links.select("agent", F.col("parent_session_id").alias("above"), F.col("session_id").alias("child"))

    def step(level: DataFrame) -> DataFrame:
        both = level.withColumnRenamed("session_id", "above").join(edges, ["agent", "above"]).where(~F.array_contains("path", F.col("child")))
        return both.select("agent", "root_id", F.col("child").alias("session_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path"))

    roots = links.where("parent_session_id is null").select("agent", F.col("session_id").alias("root_id"), "session_id", F.lit(0).alias("depth"), F.array("session_id").alias("path"))
    return grown(roots, step, deepest, "descendants").drop("path")
