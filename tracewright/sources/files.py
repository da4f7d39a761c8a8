"""Scans and sinks (A): transcripts, sidecars, registries, host samples, notes and rate tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.scalars import parse_time
from tracewright.sources.ranges import numbered, scan

LONG_LINE = 1 << 20


def with_path_keys(df: DataFrame, root: str) -> DataFrame:
    """agent, project and session of a file below ``root``: <root>/<agent>/<project>/<session>.<anything>."""
    inner = F.regexp_replace("path", "^.*" + root.rstrip("/").replace("\\", "\\\\") + "/", "")
    parts = F.split(inner, "/")
    return df.select("*", F.get(parts, 0).alias("agent"), F.get(parts, 1).alias("project"), F.regexp_replace(F.element_at(parts, -1), r"\.(meta\.json|subagent\.json|jsonl)$", "").alias("session_id"), inner.contains("/subagents/").alias("is_subagent"))


def scan_lines(spark: SparkSession, root: str, suffix: str = ".jsonl") -> DataFrame:
    """Lines of files with a number that is their order in the file: path, line_no (from 1), value, size, mtime. Blank lines are dropped, numbers stay.

    Large files are read by ranges of bytes, so no file has to be one string or one task.
    """
    return numbered(scan(spark, root, suffix))


def scan_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """A1: transcript lines by (agent, project, session); files below ``subagents/`` are no sessions of their own."""
    return with_path_keys(scan_lines(spark, root), root)


def identity_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """A2: git_remote and cwd of each session's ``.meta.json``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("git_remote", "cwd", "root_slug")])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m"))
    return with_path_keys(rows, root).select("agent", "session_id", F.coalesce("m.git_remote", F.lit("")).alias("git_remote"), F.coalesce("m.cwd", F.lit("")).alias("cwd_raw"))


def with_identity(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """A2: sessions with their identity; empty where there is no sidecar."""
    return sessions.join(sidecars, ["agent", "session_id"], "left").fillna("", ["git_remote", "cwd_raw"])


def subagent_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """A3: parent session, agent type and dispatching call of each child transcript."""
    schema = "parent_session_id STRING, agent_type STRING, description STRING, tool_use_id STRING, spawn_depth BIGINT"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.subagent.json").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m"))
    return with_path_keys(rows, root).select("agent", "session_id", "m.*")


def imported_copies(lines: DataFrame) -> DataFrame:
    """A4: agent B sessions whose second record starts a turn that was imported from elsewhere."""
    second = F.row_number().over(Window.partitionBy("agent", "session_id").orderBy("line_no")) == 2
    rows = lines.where("agent = 'codex-cli'").withColumn("second", second).where("second")
    turn = F.get_json_object("value", "$.payload.turn_id")
    return rows.where((F.get_json_object("value", "$.type") == "event_msg") & (F.get_json_object("value", "$.payload.type") == "task_started") & turn.startswith("external-import-turn-")).select("agent", "session_id")


def registry_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records as text, diagnostics): lines over a mebibyte or that are no JSON objects are told, not read."""
    size = F.octet_length("value")
    bad = (size > LONG_LINE) | F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    detail = F.when(size > LONG_LINE, F.concat(F.lit("bytes>"), F.lit(LONG_LINE).cast("string")))
    return lines.where(~bad), lines.where(bad).select("path", "line_no", F.lit("malformed_json").alias("code"), detail.alias("detail"))


SAMPLE = "v BIGINT, ts STRING, host STRING, cpu STRUCT<user_pct: DOUBLE, sys_pct: DOUBLE>, gpu STRUCT<device_pct: DOUBLE>, memory STRUCT<pressure_level: BIGINT>, budget STRUCT<wired_mib: BIGINT>, disk STRUCT<avail_bytes: BIGINT>, tailnet STRUCT<path: STRING, latency_ms: DOUBLE>, updates STRUCT<restart_required: BOOLEAN>"


def host_samples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, malformed lines by file). A sample of an unknown version keeps its text, its fields are null."""
    rows = lines.withColumn("s", F.from_json("value", SAMPLE)).withColumn("at", parse_time(F.col("s.ts")))
    bad = F.try_parse_json("value").isNull() | F.col("at").isNull() | (F.coalesce("s.host", F.lit("")) == "")
    known = lambda c: F.when(F.col("s.v") == 1, F.col(f"s.{c}"))
    fields = {"cpu_user_pct": "cpu.user_pct", "cpu_sys_pct": "cpu.sys_pct", "gpu_device_pct": "gpu.device_pct", "memory_pressure_level": "memory.pressure_level", "budget_wired_mib": "budget.wired_mib", "disk_avail_bytes": "disk.avail_bytes", "tailnet_path": "tailnet.path", "tailnet_latency_ms": "tailnet.latency_ms", "updates_restart_required": "updates.restart_required"}
    good = rows.where(~bad).select(F.col("s.host").alias("host"), F.col("at").alias("ts"), F.col("s.v").alias("v"), *(known(c).alias(n) for n, c in fields.items()), F.col("value").alias("sample"), "path", "line_no")
    return good, rows.where(bad).groupBy("path").agg(F.count("*").alias("malformed"))


def complete_lines(text: Column) -> Column:
    """The lines of a text up to its last line feed, blank ones dropped."""
    return F.filter(F.split(F.regexp_extract(text, r"(?s)^(.*)\n", 1), "\n"), lambda x: F.trim(x) != "")


def frontmatter(text: Column, key: str) -> Column:
    """K1: a key of a note's head; the last of repeated ones wins."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    found = F.regexp_extract_all(head, F.lit(rf"(?m)^{key}:[ \t]*(.*)$"), 1)
    return F.nullif(F.trim(F.regexp_replace(F.get(found, F.size(found) - 1), "^[\"']|[\"']$", "")), F.lit(""))


def list_value(text: Column, key: str) -> Column:
    """K1: a list of a note's head, inline (``[a, b]``) or as a block of dashes."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    inline = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|$))*)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*)$"), 1))
    return F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """A10, K1: Markdown notes below <root>/<status>/<type>/<scope>/; names that open with ``_`` and READMEs are left out, as are notes without id."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return parse_artifacts(files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value"), root)


def parse_artifacts(files: DataFrame, root: str) -> DataFrame:
    """A10, K1: the notes that files (path, modified, value) below ``root`` hold."""
    parts = F.split(F.regexp_replace("path", "^.*" + root.rstrip("/") + "/", ""), "/")
    rows = files.withColumn("p", parts).where((F.size("p") == 4) & ~F.get("p", 2).startswith("_") & ~F.get("p", 3).startswith("_") & (F.get("p", 3) != "README.md"))
    claim = F.regexp_replace(F.regexp_extract("value", r"(?s)\n## Claim\n(.*?)(?:\n## |\z)", 1), r"^\s+|\s+$", "")
    return rows.select(frontmatter(F.col("value"), "id").alias("id"), frontmatter(F.col("value"), "title").alias("title"), F.get("p", 2).alias("scope"), F.get("p", 1).alias("type"), F.coalesce(frontmatter(F.col("value"), "status"), F.get("p", 0)).alias("status"), list_value(F.col("value"), "evidence").alias("evidence"), list_value(F.col("value"), "contradicts").alias("contradicts"), claim.alias("claim"), frontmatter(F.col("value"), "first_noticed").alias("first_noticed"), "modified", "path").where("id is not null")


def artifact_age(notes: DataFrame) -> DataFrame:
    """K2: since when a note is known; candidates first, then the oldest."""
    return notes.withColumn("since", F.coalesce(F.try_to_timestamp("first_noticed"), "modified")).orderBy(F.col("status") != "candidate", "since", "id")


def link_contradictions(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: (links a -> b between known notes, warnings for ids that no note has)."""
    links = notes.select(F.col("id").alias("a"), F.explode("contradicts").alias("b"))
    known = notes.select(F.col("id").alias("b")).distinct()
    return links.join(known, "b", "left_semi").select("a", "b"), links.join(known, "b", "left_anti").select("a", "b")


def artifact_index(notes: DataFrame) -> DataFrame:
    """Notes by type and scope, ``universal`` last."""
    got = notes.groupBy("type", "scope").agg(F.count("*").alias("notes"), F.array_sort(F.collect_list("id")).alias("ids"))
    return got.orderBy("type", F.col("scope") == "universal", "scope")


RATE = "model STRING, effective STRING, input DOUBLE, output DOUBLE, cache_write_5m DOUBLE, cache_write_1h DOUBLE, cache_read DOUBLE, fast_input DOUBLE, fast_output DOUBLE, source STRING, checked STRING"
REQUIRED = ["input", "output", "cache_write_5m", "cache_write_1h", "cache_read"]


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """A rate table, refused whole if an entry lacks a rate, has a negative one, one fast rate only, no date, or repeats a (model, effective)."""
    table = spark.read.schema(f"currency STRING, source STRING, checked STRING, rates ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in RATE.split(', '))}>>").json(path, multiLine=True)
    rows = table.select("currency", F.col("source").alias("of_table"), F.col("checked").alias("checked_table"), F.explode("rates").alias("r")).select("currency", "of_table", "checked_table", "r.*").withColumn("at", F.try_to_timestamp("effective"))
    odd = F.lit(False)
    for c in REQUIRED:
        odd = odd | F.col(c).isNull() | (F.col(c) < 0)
    odd = odd | (F.col("fast_input").isNull() != F.col("fast_output").isNull()) | F.col("at").isNull() | F.coalesce(F.col("model") == "", F.lit(True))
    faults = rows.where(odd).select("model", "effective").union(rows.groupBy("model", "at").agg(F.count("*").alias("n"), F.min("effective").alias("effective")).where("n > 1").select("model", "effective")).limit(5).collect()
    if faults:
        raise ValueError(f"rate table refused: {[(r.model, r.effective) for r in faults]}")
    return rows.select("model", F.col("at").alias("effective"), *(F.col(c).alias(f"{c}_rate") for c in REQUIRED), "fast_input", "fast_output", F.coalesce("source", "of_table").alias("source"), F.coalesce("checked", "checked_table").alias("checked"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled introducing commits."""
    return spark.read.schema("ticket STRING, fix ARRAY<STRING>, introducing ARRAY<STRING>, unattributable STRING, note STRING").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON record a line."""
    df.write.mode("overwrite").json(path)


def replace_state(df: DataFrame, path: str, version: int) -> None:
    """``df`` takes the place of the whole table at ``path``. Versions ascend; a version written again replaces itself.

    A version is listed only when it is written whole, so a reader never meets half of one, and an empty state replaces a full one.
    """
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/listed")


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that is listed."""
    version = spark.read.parquet(f"{path}/listed").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A table from before the columns that a reader needs is refused rather than read as empty."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"the table lacks {', '.join(gone)}; rebuild it from the raw transcripts")
    return df
