"""Folding of raw transcript lines into turns, tool calls, usage and derived events (B, C).

``lines`` has agent, session_id, line_no, value (one JSON object a line). Everything is partitioned by
(agent, session_id) and ordered by line_no, the total order given at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import first_non_empty, parse_time, truncate_bytes

KEY = ["agent", "session_id"]
BLOCK = "type STRING, text STRING, id STRING, name STRING, input STRING, tool_use_id STRING, content STRING, is_error BOOLEAN"
USAGE = "input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT, cache_creation_input_tokens BIGINT, cache_creation STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>, speed STRING"
RECORD = f"type STRING, subtype STRING, uuid STRING, logicalParentUuid STRING, timestamp STRING, cwd STRING, version STRING, gitBranch STRING, promptId STRING, isSidechain BOOLEAN, isMeta BOOLEAN, effort STRING, perTurnEffort STRING, content STRING, toolUseID STRING, message STRUCT<id: STRING, role: STRING, model: STRING, stop_reason: STRING, content: STRING, usage: STRUCT<{USAGE}>>"
#: The record types that are understood, tool kinds by name, and the argument that tells a call apart.
TYPES = ["user", "assistant", "system", "attachment", "progress", "queue-operation", "file-history-snapshot", "permission-mode", "agent-name", "custom-title", "last-prompt", "pr-link"]
TOOL_KINDS = {"Bash": "bash", "Edit": "edit", "Write": "write", "Read": "read", "NotebookEdit": "read", "Grep": "grep", "Glob": "glob", "Task": "task", "Agent": "task", "WebFetch": "web_fetch", "WebSearch": "web_search", "ExitPlanMode": "plan", "EnterPlanMode": "plan"}
KEY_ARGS = {"Bash": ["command", "description"], "Edit": ["file_path"], "Write": ["file_path"], "Read": ["file_path"], "Grep": ["pattern"], "Glob": ["pattern"], "Task": ["description", "subagent_type"], "Agent": ["description", "subagent_type"], "WebFetch": ["url", "query", "prompt"], "WebSearch": ["url", "query", "prompt"]}
OTHER_KEY_ARGS = ["file_path", "command", "pattern", "query", "url", "description"]


def by_line() -> Window:
    return Window.partitionBy(*KEY).orderBy("line_no")


def route(lines: DataFrame) -> DataFrame:
    """B1: parsed records with a route: their type, ``__malformed__``, ``__unmodeled_payload__`` (a field of a wrong kind) or ``__unknown__``."""
    v = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    rows = lines.withColumn("r", F.from_json("value", RECORD)).withColumn("malformed", v.isNull())
    drift = F.coalesce(~kind("$.isSidechain").isin("BOOLEAN", "VOID"), F.lit(False)) | F.coalesce(F.col("r.type").isin("user", "assistant") & ~kind("$.message").startswith("OBJECT"), F.lit(False))
    return rows.withColumn("route", F.when(F.col("malformed"), "__malformed__").when(drift, "__unmodeled_payload__").when(F.col("r.type").isin(TYPES), F.col("r.type")).otherwise("__unknown__")).drop("malformed")


def unknown_records(routed: DataFrame) -> DataFrame:
    """Lines that are not understood, counted by type and subtype, with the first time."""
    odd = routed.where(F.col("route").startswith("__"))
    return odd.groupBy(*KEY, F.when(F.col("route") == "__unknown__", F.coalesce("r.type", F.lit(""))).otherwise(F.col("route")).alias("type"), F.coalesce("r.subtype", F.lit("")).alias("subtype")).agg(F.count("*").alias("count"), F.min(parse_time(F.col("r.timestamp"))).alias("first_seen"))


def blocks(record: Column) -> Column:
    """The content blocks of a message; a plain text is one text block."""
    return F.coalesce(F.from_json(record["message"]["content"], f"ARRAY<STRUCT<{BLOCK}>>"), F.array())


def with_turns(routed: DataFrame) -> DataFrame:
    """B2: user and assistant records with the turn they belong to.

    A user record that is no tool result, side chain or meta opens a turn at the first sight of its promptId, or if it has
    none and has text; an assistant record before any turn opens one; a repeated promptId goes back to its turn.
    """
    rows = routed.where(F.col("route").isin("user", "assistant")).withColumn("is_result", F.exists(blocks(F.col("r")), lambda b: b["type"] == "tool_result"))
    text = F.coalesce(F.col("r.message.content"), F.lit("")) != ""
    asks = (F.col("route") == "user") & ~F.col("is_result") & ~F.coalesce(F.col("r.isSidechain"), F.lit(False)) & ~F.coalesce(F.col("r.isMeta"), F.lit(False))
    prompt = F.when(asks, F.nullif(F.col("r.promptId"), F.lit("")))
    first = F.row_number().over(Window.partitionBy(*KEY, "prompt").orderBy("line_no")) == 1
    rows = rows.withColumn("prompt", prompt).withColumn("asks", asks)
    opens = F.when(F.col("prompt").isNotNull(), first).otherwise(F.col("asks") & text)
    rows = rows.withColumn("opens", opens)
    seen = F.max(F.col("opens").cast("int")).over(by_line())
    lead_in = (F.col("route") == "assistant") & (seen == 0)
    rows = rows.withColumn("opens", F.col("opens") | (lead_in & (F.row_number().over(Window.partitionBy(*KEY, lead_in).orderBy("line_no")) == 1)))
    return rows.withColumn("turn", F.sum(F.col("opens").cast("long")).over(by_line()) - 1)


def turn_conditions(turned: DataFrame) -> DataFrame:
    """The first model (never ``<synthetic>``), effort, version and speed of each turn, and whether they change within it."""
    model = F.nullif(F.nullif(F.col("r.message.model"), F.lit("")), F.lit("<synthetic>"))
    effort = first_non_empty(F.col("r.perTurnEffort"), F.col("r.effort"))
    speed = F.nullif(F.col("r.message.usage.speed"), F.lit(""))
    version = F.nullif(F.col("r.version"), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return turned.where("turn >= 0").groupBy(*KEY, "turn").agg(first(model).alias("model"), first(effort).alias("effort"), first(version).alias("cli_version"), first(speed).alias("speed"), ((F.count_distinct(model) > 1) | (F.count_distinct(speed) > 1)).alias("usage_mixed"))


def message_usage(turned: DataFrame) -> DataFrame:
    """Tokens by turn: a message's usage counts once, its last record wins and takes it to its turn; without an id each counts."""
    rows = turned.where((F.col("route") == "assistant") & F.col("r.message.usage").isNotNull())
    key = F.coalesce(F.nullif(F.col("r.message.id"), F.lit("")), F.concat(F.lit("line "), F.col("line_no").cast("string")))
    rows = rows.withColumn("message_key", key).withColumn("n", F.row_number().over(Window.partitionBy(*KEY, "message_key").orderBy(F.desc("line_no")))).where("n = 1")
    u = "r.message.usage"
    return rows.groupBy(*KEY, "turn").agg(F.count("*").alias("messages"), F.sum(f"{u}.input_tokens").alias("input_tokens"), F.sum(f"{u}.output_tokens").alias("output_tokens"), F.sum(f"{u}.cache_read_input_tokens").alias("cache_read_tokens"), F.sum(f"{u}.cache_creation_input_tokens").alias("cache_creation_tokens"), F.sum(f"{u}.cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h_tokens"))


def tool_kind(name: Column) -> Column:
    out = F.when(name.startswith("mcp__"), "mcp").otherwise("other")
    table = F.create_map(*(F.lit(x) for kv in TOOL_KINDS.items() for x in kv))
    return F.coalesce(F.get(F.array(F.try_element_at(table, name)), F.lit(0)), out)


def key_arg(name: Column, input_: Column) -> Column:
    """The argument that tells a call apart: at most 200 bytes of it, 2000 of a router command."""
    pick = lambda keys: first_non_empty(*(F.get_json_object(input_, f"$.{k}") for k in keys))
    out = pick(OTHER_KEY_ARGS)
    for n, keys in KEY_ARGS.items():
        out = F.when(name == n, pick(keys)).otherwise(out)
    return F.when((name == "Bash") & out.contains("codex-lens.sh"), truncate_bytes(out, 2000)).otherwise(truncate_bytes(out, 200))


def tool_calls(turned: DataFrame) -> DataFrame:
    """Calls of assistant records, each with its result (the last one for its id): error flag, summary and duration."""
    at = parse_time(F.col("r.timestamp"))
    each = turned.where("route = 'assistant'").select(*KEY, "turn", "line_no", at.alias("started_at"), F.posexplode(blocks(F.col("r"))).alias("pos", "b")).where("b.type = 'tool_use'")
    calls = each.select(*KEY, "turn", "line_no", "pos", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool_name"), tool_kind(F.col("b.name")).alias("tool_kind"), key_arg(F.col("b.name"), F.col("b.input")).alias("key_arg"), "started_at")
    results = turned.where("route = 'user' and is_result").select(*KEY, "line_no", at.alias("ended_at"), F.explode(blocks(F.col("r"))).alias("b")).where("b.type = 'tool_result'")
    results = results.groupBy(*KEY, F.col("b.tool_use_id").alias("call_id")).agg(F.max_by(F.struct(F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.col("b.content").alias("output"), F.col("ended_at")), F.col("line_no")).alias("x"))
    both = calls.join(results, [*KEY, "call_id"], "left")
    ms = F.floor((F.unix_micros("x.ended_at") - F.unix_micros("started_at")) / 1000).cast("long")
    got = both.select(*KEY, "turn", F.row_number().over(Window.partitionBy(*KEY).orderBy("line_no", "pos")).alias("seq"), "call_id", "tool_name", "tool_kind", "key_arg", "started_at", F.when(ms >= 0, ms).alias("duration_ms"), F.coalesce("x.is_error", F.lit(False)).alias("is_error"), truncate_bytes(F.col("x.output"), 800).alias("result_summary"))
    return got.withColumn("seq", F.col("seq").cast("long") - 1)


def files_touched(calls: DataFrame) -> DataFrame:
    """How often each path was read, edited or written."""
    return calls.where(F.col("tool_kind").isin("read", "edit", "write") & F.col("key_arg").isNotNull()).groupBy(*KEY, F.col("key_arg").alias("path"), F.col("tool_kind").alias("op")).agg(F.count("*").alias("count"))


def errors(turned: DataFrame, routed: DataFrame, calls: DataFrame) -> DataFrame:
    """API errors and failed calls, in line order."""
    api = routed.where("route = 'system' and r.subtype = 'api_error'").select(*KEY, F.lit("api_error").alias("source"), F.col("r.content").alias("message"), parse_time(F.col("r.timestamp")).alias("ts"))
    tool = calls.where("is_error").select(*KEY, F.lit("tool_error").alias("source"), F.col("result_summary").alias("message"), F.col("started_at").alias("ts"))
    return api.union(tool).withColumn("seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("ts", "source", "message")).cast("long") - 1)


def compactions(routed: DataFrame) -> DataFrame:
    """The places where a transcript was compacted, anchored at the record that each logically follows."""
    rows = routed.where("route = 'system' and r.subtype = 'compact_boundary'")
    return rows.select(*KEY, (F.row_number().over(by_line()).cast("long") - 1).alias("seq"), parse_time(F.col("r.timestamp")).alias("ts"), F.col("r.logicalParentUuid").alias("anchor"))


def session_header(routed: DataFrame, turned: DataFrame, calls: DataFrame) -> DataFrame:
    """First directory, branch and version, time span, and counters of each session."""
    at = parse_time(F.col("r.timestamp"))
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line_no")))
    head = routed.groupBy(*KEY).agg(first("r.cwd").alias("cwd"), first("r.gitBranch").alias("git_branch"), first("r.version").alias("cli_version"), F.min(at).alias("start_time"), F.max(at).alias("end_time"), F.coalesce(F.bool_or((F.col("route") == "system") & (F.col("r.subtype") == "compact_boundary")), F.lit(False)).alias("compacted"))
    turns = turned.groupBy(*KEY).agg((F.max("turn") + 1).alias("turn_count"))
    n = calls.groupBy(*KEY).agg(F.count("*").alias("tool_call_count"), F.count_if("is_error").alias("error_count"))
    got = head.join(turns, KEY, "left").join(n, KEY, "left")
    ms = F.floor((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000).cast("long")
    return got.withColumn("duration_ms", F.coalesce(ms, F.lit(0))).fillna(0, ["turn_count", "tool_call_count", "error_count"])


def token_deltas(counts: DataFrame) -> DataFrame:
    """Usage of each sample of a cumulative counter: its advance, or the sample's own last usage where there is no sample before or a counter fell.

    counts: agent, session_id, seq, total_input, total_cached, total_output, total_reasoning and last_ of each.
    """
    w = Window.partitionBy(*KEY).orderBy("seq")
    names = ["input", "cached", "output", "reasoning"]
    going = F.lit(True)
    for n in names:
        going = going & (F.col(f"total_{n}") >= F.lag(f"total_{n}").over(w))
    going = F.coalesce(going, F.lit(False))
    return counts.select(*KEY, "seq", *(F.when(going, F.col(f"total_{n}") - F.lag(f"total_{n}").over(w)).otherwise(F.col(f"last_{n}")).alias(n) for n in names))


def codex_turns(records: DataFrame) -> DataFrame:
    """The turn of each record: a context opens one at the first sight of its turn_id and goes back to it on repeats; a message before any opens one.

    records: agent, session_id, line_no, kind (context or message), turn_id.
    """
    context = F.col("kind") == "context"
    fresh = context & (F.row_number().over(Window.partitionBy(*KEY, "kind", "turn_id").orderBy("line_no")) == 1)
    rows = records.withColumn("fresh", fresh).withColumn("any", F.max(context.cast("int")).over(by_line()))
    implied = ~context & (F.col("any") == 0) & (F.row_number().over(Window.partitionBy(*KEY, "any").orderBy("line_no")) == 1)
    rows = rows.withColumn("fresh", F.col("fresh") | implied)
    rows = rows.withColumn("opened", F.when(F.col("fresh"), F.sum(F.col("fresh").cast("long")).over(by_line()) - 1))
    own = F.first("opened", ignorenulls=True).over(Window.partitionBy(*KEY, "kind", "turn_id").orderBy("line_no"))
    rows = rows.withColumn("cursor", F.when(context, own).otherwise(F.when(F.col("fresh"), F.col("opened"))))
    return rows.withColumn("turn", F.last("cursor", ignorenulls=True).over(by_line())).select(*KEY, "line_no", "kind", "turn_id", "turn")


COMMIT_LINE = r"^\[(.+) ([0-9a-f]{7,40})\] (.+)$"
STAT = r"(\d+) files? changed"
#: What a pattern's \s stands for.
SPACE = " \t\n\x0b\f\r"
ONE_LINE = r"^([0-9a-f]{7,40}) (.+)$"
RUNS_COMMIT = r"\bgit(?:\s+(?:-[Cc]\s+\S+|--\S+))*\s+commit(?:\s|$)"


def extract_commits(calls: DataFrame) -> DataFrame:
    """Commits that results of shell calls confirm, several a call; files changed from the first statistics line before the next commit.

    calls: agent, session_id, seq, tool_kind, result_summary, started_at, session_start. A result is read where its row is.
    """
    trimmed = F.transform(F.split("result_summary", "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    rows = calls.where(F.col("tool_kind").isin("bash", "custom")).select(*KEY, "seq", F.coalesce("started_at", "session_start").alias("committed_at"), trimmed.alias("lines"))
    places = F.transform("lines", lambda x, i: F.when(x.startswith("[") & x.rlike(COMMIT_LINE), i))
    rows = rows.withColumn("places", F.filter(places, lambda i: i.isNotNull()))

    def commit(at: Column, k: Column) -> Column:
        """Commit ``k`` of a call, at line ``at``: its line and what follows up to the next one's."""
        end = F.coalesce(F.get("places", k + 1), F.size("lines"))
        own = F.slice("lines", at + 2, end - at - 1)
        return F.struct((k + 1).cast("long").alias("part"), F.get("lines", at).alias("text"), F.get(F.filter(own, lambda x: x.rlike(STAT)), F.lit(0)).alias("stat"))

    got = rows.select(*KEY, "seq", "committed_at", F.inline(F.transform("places", commit)))
    return got.select(*KEY, "seq", "part", "committed_at", F.regexp_extract("text", COMMIT_LINE, 1).alias("branch"), F.regexp_extract("text", COMMIT_LINE, 2).alias("commit_hash"), F.regexp_extract("text", COMMIT_LINE, 3).alias("subject"), F.regexp_extract("stat", STAT, 1).cast("long").alias("files_changed"))


def quiet_commits(calls: DataFrame) -> DataFrame:
    """Where no line confirms a commit and the command runs one: the first ``hash subject`` line, if the command wrote that subject.

    A command cut at its end counts if it breaks off within the subject, after twenty characters of it or more.
    """
    rows = calls.where(F.col("tool_kind").isin("bash", "custom") & F.col("key_arg").rlike(RUNS_COMMIT)).withColumn("lines", F.transform(F.split("result_summary", "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")))
    rows = rows.where(~F.exists("lines", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "").rlike(COMMIT_LINE)))
    rows = rows.withColumn("line", F.get(F.filter("lines", lambda x: x.rlike(ONE_LINE)), 0)).where("line is not null")
    rows = rows.withColumn("commit_hash", F.regexp_extract("line", ONE_LINE, 1)).withColumn("subject", F.regexp_extract("line", ONE_LINE, 2))
    bare, cmd = F.regexp_replace("subject", "…$", ""), F.regexp_replace("key_arg", "…$", "")
    head = F.substring(bare, 1, 20)
    tail = F.call_function("substring_index", cmd, head, F.lit(-1))
    cut = F.col("key_arg").endswith("…") & (F.octet_length(bare) >= 20) & cmd.contains(head) & F.startswith(bare, F.concat(head, tail))
    return rows.where((bare != "") & (F.contains(F.col("key_arg"), bare) | cut)).select(*KEY, "seq", F.coalesce("started_at", "session_start").alias("committed_at"), "commit_hash", "subject")


def message_turns(lines: DataFrame) -> DataFrame:
    """The turns of each session, from its raw lines."""
    return with_turns(route(lines)).groupBy(*KEY).agg((F.max("turn") + 1).alias("turns"))


def source_tickets(commits: DataFrame, most: int = 32) -> DataFrame:
    """C17: the tickets that a session's confirmed commits mark, in the order of their first sight, at most ``most`` of them.

    commits: agent, session_id, seq, part, subject.
    """
    from tracewright.functions.scalars import ticket_marker

    marked = commits.withColumn("ticket", ticket_marker(F.col("subject"))).where("ticket is not null")
    first = marked.groupBy(*KEY, "ticket").agg(F.min(F.struct("seq", "part")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("at", "ticket"))).where(F.col("n") <= most)
    return ranked.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ticket"))), lambda x: x["ticket"]).alias("tickets"))


def subagent_rollup(dispatches: DataFrame, children: DataFrame) -> DataFrame:
    """One row per dispatch: its child transcript's measures, or nulls where none was shipped; children that no dispatch claims stay too.

    dispatches: agent, session_id, seq, tool_use_id, agent_type, started_at; children: agent, parent_session_id, tool_use_id,
    line_no, ts, role, text, model, input_tokens, output_tokens. A span needs two stamps; models that differ read ``mixed``.
    """
    tokens = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    text = lambda role: F.when((F.col("role") == role) & (F.col("text") != ""), F.col("line_no"))
    c = children.groupBy("agent", F.col("parent_session_id").alias("session_id"), "tool_use_id").agg(
        F.count("ts").alias("stamps"),
        F.min("ts").alias("child_start"),
        F.max("ts").alias("child_end"),
        F.min_by("text", text("user")).alias("prompt"),
        F.max_by("text", text("assistant")).alias("result"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min_by("model", F.when(tokens & F.col("model").isNotNull(), F.col("line_no"))).alias("first_model"),
        F.count_distinct(F.when(tokens, F.col("model"))).alias("models"),
    )
    both = dispatches.join(c, [*KEY, "tool_use_id"], "full_outer")
    ms = F.floor((F.unix_micros(F.col("child_end").cast("timestamp")) - F.unix_micros(F.col("child_start").cast("timestamp"))) / 1000).cast("long")
    start = F.coalesce("child_start", "started_at")
    order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("began"), "tool_use_id", F.asc_nulls_last("seq"))
    got = both.withColumn("began", start).withColumn("n", F.row_number().over(order).cast("long") - 1)
    return got.select(*KEY, F.col("n").alias("seq"), "tool_use_id", "agent_type", "began", F.when(F.col("stamps") >= 2, ms).alias("duration_ms"), "prompt", F.col("result").alias("result_summary"), F.when(F.col("models") > 1, "mixed").otherwise(F.col("first_model")).alias("model"), "input_tokens", "output_tokens")
