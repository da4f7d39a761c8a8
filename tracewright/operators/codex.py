"""Result events of agent B's transcripts (B14, and its part of B7 and B9), parents and child sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import first_non_empty, truncate_bytes
from tracewright.functions.tables import dealt

KEY = ["agent", "session_id"]
#: What a call is called that only its end event tells of, by the event's kind: tool kind and tool name.
MADE = {"exec": ("bash", "shell"), "patch": ("patch_apply", "apply_patch"), "mcp": ("mcp", "mcp")}
#: The operation of a patch's change by its type; any other type is a patch.
CHANGE_OPS = {"add": "write", "update": "edit", "delete": "delete"}


def duration_ms(raw: Column) -> Column:
    """Milliseconds of ``{"secs":..,"nanos":..}`` or of a number of seconds; 0 for anything else."""
    parts = F.from_json(raw, "secs BIGINT, nanos BIGINT")
    whole = F.coalesce(parts["secs"], F.lit(0)) * 1000 + F.floor(F.coalesce(parts["nanos"], F.lit(0)) / 1_000_000)
    seconds = raw.try_cast("double")
    return F.when(F.startswith(F.trim(raw), F.lit("{")), whole).otherwise(F.coalesce((seconds * 1000).cast("long"), F.lit(0))).cast("long")


def picked(kind: Column, what: int) -> Column:
    out = F.lit(None).cast("string")
    for name, made in MADE.items():
        out = F.when(kind == name, made[what]).otherwise(out)
    return out


def shell_summary(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """What a shell call gave: its exit code and its outputs, each cut at 400 bytes, the whole at 800."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), truncate_bytes(F.nullif(c, F.lit("")), 400))
    return truncate_bytes(F.concat_ws("\n", F.concat(F.lit("exit="), exit_code.cast("string")), part("stdout", stdout), part("stderr", stderr)), 800)


def with_results(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """The calls of a session with the last end event of their id; an event without a call makes one, at its own line.

    calls: agent, session_id, line_no, turn, call_id, tool_kind, tool_name, key_arg; ends: agent, session_id, line_no, turn,
    kind (exec, patch, mcp), call_id, exit_code, success, stdout, stderr, duration, result, command, ts. A shell call's kind is
    bash unless it was known better; it failed if its exit code is not 0, a patch if it says so.
    """
    e = ends.groupBy(*KEY, "call_id").agg(F.max_by(F.struct("kind", "exit_code", "success", "stdout", "stderr", "duration", "result", "ts"), "line_no").alias("e"), F.min_by(F.struct("line_no", "turn", "command", "kind"), "line_no").alias("first"))
    both = calls.withColumn("known", F.lit(True)).join(e, [*KEY, "call_id"], "full_outer")
    kind = F.col("e.kind")
    success = F.coalesce("e.success", F.lit(False))
    summary = F.when(kind == "exec", shell_summary(F.col("e.exit_code"), F.col("e.stdout"), F.col("e.stderr"))).when(kind == "patch", truncate_bytes(F.when(success, F.col("e.stdout")).otherwise(F.col("e.stderr")), 400)).when(kind == "mcp", truncate_bytes(F.col("e.result"), 400))
    failed = F.when(kind == "exec", F.coalesce(F.col("e.exit_code") != 0, F.lit(False))).when(kind == "patch", ~success).otherwise(F.lit(False))
    own = F.nullif(F.nullif("tool_kind", F.lit("")), F.lit("function"))
    shown = F.when(kind == "exec", F.coalesce(own, F.lit("bash"))).when(kind.isNotNull(), picked(kind, 0)).otherwise(F.col("tool_kind"))
    line = F.coalesce("line_no", "first.line_no")
    seq = F.row_number().over(Window.partitionBy(*KEY).orderBy(line, "call_id")).cast("long") - 1
    return both.select(
        *KEY,
        seq.alias("seq"),
        "call_id",
        F.coalesce("turn", "first.turn").alias("turn"),
        shown.alias("tool_kind"),
        F.when(F.col("known"), F.col("tool_name")).otherwise(picked(F.col("first.kind"), 1)).alias("tool_name"),
        F.when(F.col("known"), F.col("key_arg")).otherwise(F.when(F.col("first.kind") == "exec", F.col("first.command"))).alias("key_arg"),
        F.when(kind == "exec", F.col("e.exit_code")).alias("exit_code"),
        failed.alias("is_error"),
        F.when(kind.isin("exec", "mcp"), duration_ms(F.col("e.duration"))).alias("duration_ms"),
        summary.alias("result_summary"),
    )


def errors(ends: DataFrame, aborted: DataFrame, others: DataFrame) -> DataFrame:
    """Every error source in line order: failed shell calls and patches, turns that were aborted, API errors and stop hooks.

    aborted and others: agent, session_id, line_no, turn, source, message.
    """
    failed = (F.col("kind") == "exec") & (F.col("exit_code") != 0) | (F.col("kind") == "patch") & ~F.coalesce("success", F.lit(False))
    text = F.when(F.col("kind") == "exec", shell_summary(F.col("exit_code"), F.col("stdout"), F.col("stderr"))).otherwise(truncate_bytes(F.col("stderr"), 400))
    own = ends.where(failed).select(*KEY, "line_no", "turn", F.concat("kind", F.lit("_error")).alias("source"), text.alias("message"))
    message = F.when(F.col("source") == "stop_hook", truncate_bytes(F.col("message"), 1000)).otherwise(F.col("message"))
    rest = aborted.union(others).select(*KEY, "line_no", "turn", "source", message.alias("message"))
    return own.union(rest).withColumn("seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("line_no", "source")).cast("long") - 1)


def files_touched(calls: DataFrame, ends: DataFrame, rows: int | None = None) -> DataFrame:
    """Paths and operations of patches, by the type of each change, and of calls with a path argument (exec for a shell call, else edit).

    calls: agent, session_id, tool_name, arguments (JSON); ends: agent, session_id, kind, changes (JSON of path to change); rows:
    about how many paths, so that tasks don't grow with them.
    """
    change = ends.where("kind = 'patch'").select(*KEY, F.explode(F.from_json("changes", "MAP<STRING, STRUCT<type: STRING>>")).alias("path", "change"))
    table = F.create_map(*(F.lit(x) for kv in CHANGE_OPS.items() for x in kv))
    patched = change.select(*KEY, "path", F.coalesce(F.try_element_at(table, F.col("change.type")), F.lit("patch")).alias("op"))
    path = first_non_empty(F.get_json_object("arguments", "$.file_path"), F.get_json_object("arguments", "$.path"))
    called = calls.select(*KEY, path.alias("path"), F.when(F.col("tool_name") == "shell", "exec").otherwise("edit").alias("op")).where("path is not null")
    touched = patched.union(called)
    touched = touched if rows is None else dealt(touched, rows, *KEY, "path", "op")
    return touched.groupBy(*KEY, "path", "op").agg(F.count("*").alias("count"))


def parent_spawn(source: Column, parent_thread_id: Column) -> tuple[Column, Column]:
    """(parent session, depth) of a session's source object, else of its parent thread; depth 1 if a parent has none, null without one."""
    spawn = F.from_json(F.when(F.startswith(source, F.lit("{")), source), "subagent STRUCT<thread_spawn: STRUCT<parent_thread_id: STRING, depth: INT>>")["subagent"]["thread_spawn"]
    named = F.nullif(spawn["parent_thread_id"], F.lit(""))
    parent = F.coalesce(named, F.nullif(parent_thread_id, F.lit("")))
    depth = F.when(named.isNotNull() & (spawn["depth"] > 0), spawn["depth"]).otherwise(F.lit(1))
    return parent, F.when(parent.isNotNull(), depth)


def child_sessions(children: DataFrame) -> DataFrame:
    """Each child transcript as a session of its own, one below its parent, with the call that started it.

    children: agent, parent_session_id, child_session_id, tool_use_id, line_no, ts, role, input_tokens, output_tokens. What is not
    understood in it and its friction stay the parent's, so they are counted once.
    """
    got = children.where(F.coalesce("child_session_id", F.lit("")) != "").groupBy("agent", F.col("child_session_id").alias("session_id")).agg(
        F.min("parent_session_id").alias("parent_session_id"),
        F.min("tool_use_id").alias("parent_tool_call_id"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count_if(F.col("role") == "user").alias("turn_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return got.withColumn("spawn_depth", F.lit(1))


def search_output(calls: DataFrame, literal: str, pattern: str, since: Column, until: Column, tickets: DataFrame) -> DataFrame:
    """Calls started in [since, until) whose argument holds a literal and whose whole output matches a pattern, with the one ticket of their session and time.

    calls: agent, session_id, seq, started_at, key_arg, output; tickets: agent, session_id, at, ticket (G8's rows).
    """
    hit = calls.where((F.col("started_at") >= since) & (F.col("started_at") < until) & F.contains(F.col("key_arg"), F.lit(literal)) & F.rlike(F.col("output"), F.lit(pattern)))
    named = tickets.select("agent", "session_id", F.col("at").alias("started_at"), "ticket")
    return hit.join(named, ["agent", "session_id", "started_at"], "left").orderBy("started_at", "agent", "session_id", "seq")
