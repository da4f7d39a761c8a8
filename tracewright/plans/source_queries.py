"""Queries of scans, sinks and notes. Their lines and texts are built from the tables, so the oracle tells what was put into each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.tables import new_path, written
from tracewright.operators.knowledge import path_tokens
from tracewright.plans.adapters import AGENT, cte, table
from tracewright.plans.registry import query
from tracewright.sources import files as a
from tracewright.sources import ranges
from tracewright.streaming import streams


def read(spark, sf, name, *columns):
    return spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*columns)


@query("a2_join_identity_sidecar", f"{cte('sessions')} SELECT agent, session_id, CASE WHEN turn_count % 4 = 1 THEN '' ELSE coalesce(git_remote, '') END AS git_remote, CASE WHEN turn_count % 4 = 1 THEN '' ELSE coalesce(cwd_raw, '') END AS cwd_raw FROM sessions WHERE turn_count IS NOT NULL")
def a2(spark, sf):
    s = table(spark, sf, "sessions").where("turn_count is not null")
    return a.with_identity(s.select("agent", "session_id"), s.where("turn_count % 4 <> 1").select("agent", "session_id", "git_remote", "cwd_raw"))


@query("a4_exclude_imported_copies", f"WITH t AS (SELECT {AGENT.format(k='conv_id')} AS agent, 'c' || CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn FROM conversations) SELECT agent, session_id, count(*) AS lines FROM t GROUP BY agent, session_id, conv_id HAVING NOT (agent = 'codex-cli' AND conv_id % 4 = 0 AND count(*) > 1)")
def a4(spark, sf):
    turn_id = "CASE WHEN conv_id % 4 = 0 THEN 'external-import-turn-' ELSE 'turn-' END || CAST(turn AS STRING)"
    lines = read(spark, sf, "conversations", AGENT.format(k="conv_id") + " AS agent", "'c' || CAST(conv_id AS STRING) AS session_id", "turn AS line_no", f"to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'task_started', 'turn_id', {turn_id}))) AS value")
    return lines.join(a.imported_copies(lines), ["agent", "session_id"], "left_anti").groupBy("agent", "session_id").agg(F.count("*").alias("lines"))


@query("a8_registry_diagnostics", "SELECT user_id AS path, event_id AS line_no, 'malformed_json' AS code, CASE WHEN event_id % 997 = 4 THEN 'bytes>1048576' END AS detail FROM events WHERE event_id % 997 = 4 OR event_id % 5 IN (1, 2)")
def a8(spark, sf):
    value = "CASE WHEN event_id % 997 = 4 THEN '{\"x\": \"' || repeat('x', 1048576) || '\"}' WHEN event_id % 5 = 1 THEN substring(props, 1, 4) WHEN event_id % 5 = 2 THEN '[' || props || ']' WHEN event_id % 5 = 3 THEN '  ' || props ELSE props END AS value"
    return a.registry_lines(read(spark, sf, "events", "user_id AS path", "event_id AS line_no", value))[1]


def sample_lines(spark, sf):
    at = "'2024-01-01T00:00:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || 'Z'"
    sample = f"'{{\"v\": ' || CAST(1 + CAST(event_id % 7 = 3 AS INT) AS STRING) || ', \"ts\": \"' || {at} || '\", \"host\": \"h' || CAST(user_id % 9 AS STRING) || '\", \"cpu\": {{\"user_pct\": ' || CAST(event_id % 100 AS STRING) || '.5}}, \"memory\": {{\"pressure_level\": ' || CAST(event_id % 4 AS STRING) || '}}}}'"
    value = f"CASE event_id % 7 WHEN 0 THEN '{{\"v\": 1, ' WHEN 1 THEN '{{\"v\": 1, \"ts\": \"yesterday\", \"host\": \"h1\"}}' WHEN 2 THEN '{{\"v\": 1, \"ts\": \"2024-01-01T00:00:00Z\"}}' ELSE {sample} END AS value"
    return read(spark, sf, "events", "user_id AS path", "event_id AS line_no", value)


@query("a9_host_samples", "SELECT event_id AS line_no, 'h' || CAST(user_id % 9 AS VARCHAR) AS host, 1704067200 + event_id % 60 AS at, CAST(CASE WHEN event_id % 7 = 3 THEN 2 ELSE 1 END AS BIGINT) AS v, CASE WHEN event_id % 7 <> 3 THEN event_id % 100 + 0.5::DOUBLE END AS cpu_user_pct, CASE WHEN event_id % 7 <> 3 THEN event_id % 4 END AS memory_pressure_level FROM events WHERE event_id % 7 > 2")
def a9(spark, sf):
    return a.host_samples(sample_lines(spark, sf))[0].select("line_no", "host", F.unix_timestamp("ts").alias("at"), "v", "cpu_user_pct", "memory_pressure_level")


@query("a9_malformed_samples", "SELECT user_id AS path, count(*) AS malformed FROM events WHERE event_id % 7 <= 2 GROUP BY user_id")
def a9_malformed(spark, sf):
    return a.host_samples(sample_lines(spark, sf))[1]


@query("a12_load_labels", "SELECT 'tk-' || CAST(o_orderkey AS VARCHAR) AS ticket, md5(CAST(o_orderkey AS VARCHAR)) AS fix, CASE WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_custkey AS VARCHAR)) END AS introducing, CASE WHEN o_orderkey % 3 = 0 THEN 'before the record' END AS unattributable FROM orders")
def a12(spark, sf):
    path = new_path(spark, "labels")
    labels = read(spark, sf, "orders", "'tk-' || CAST(o_orderkey AS STRING) AS ticket", "array(md5(CAST(o_orderkey AS STRING))) AS fix", "CASE WHEN o_orderkey % 3 <> 0 THEN array(md5(CAST(o_custkey AS STRING))) END AS introducing", "CASE WHEN o_orderkey % 3 = 0 THEN 'before the record' END AS unattributable")
    a.write_report(labels, path)
    return a.load_labels(spark, path).select("ticket", F.get("fix", 0).alias("fix"), F.get("introducing", 0).alias("introducing"), "unattributable")


@query("a15_complete_line_delta", r"WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^\n]*$', ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l)::INT AS n_lines, array_to_string(l, '|') AS lines FROM t")
def a15(spark, sf):
    rows = read(spark, sf, "documents", "doc_id", "text").where("text is not null").withColumn("l", a.complete_lines(F.col("text")))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.array_join("l", "|").alias("lines"))


#: notes in files, one a part: a repeated id (the last holds), a quoted title, lists inline and by dashes, a note without id
NOTES = "SELECT p_partkey, p_partkey % 10 <> 9 AS known, 'n' || CAST(p_partkey AS {s}) AS id, p_name AS title, CASE p_size % 3 WHEN 0 THEN 'universal' WHEN 1 THEN 'web' ELSE 'core' END AS scope, CASE p_size % 2 WHEN 0 THEN 'gotcha' ELSE 'decision' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'candidate' ELSE 'accepted' END AS status, 'n' || CAST(p_partkey + 7 AS {s}) AS other, '2024-01-0' || CAST(1 + p_size % 9 AS {s}) AS noticed FROM {t}"
NOTE_TEXT = r"'---\nid: first\ntitle: \"' || title || '\"\nevidence: [/src/' || id || '.py, \"tk-' || CAST(p_partkey AS STRING) || '\"]\ncontradicts:\n  - ' || other || '\n' || CASE WHEN p_partkey % 3 = 0 THEN 'first_noticed: ' || noticed || '\n' ELSE '' END || CASE WHEN known THEN 'id: ' || id ELSE 'id:' END || '\n---\nSome words.\n## Claim\n\nThat ' || title || ' holds.\n\n## More\nno'"


def artifacts(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("artifact_parts")
    # a small file of many short rows is read by few tasks; its notes are made and parsed by all
    notes = spark.sql(NOTES.format(s="STRING", t="artifact_parts")).repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    path = "'file:/kb/' || status || '/' || type || '/' || CASE WHEN p_partkey % 17 = 5 THEN '_draft' ELSE scope END || '/' || CASE WHEN p_partkey % 19 = 5 THEN 'README' ELSE id END || '.md' AS path"
    return a.parse_artifacts(notes.selectExpr(path, "TIMESTAMP '2024-02-01 00:00:00' AS modified", f"{NOTE_TEXT} AS value"), "/kb")


SQL_NOTES = f"n AS (SELECT * FROM ({NOTES.format(s='VARCHAR', t='part')}) WHERE known AND p_partkey % 17 <> 5 AND p_partkey % 19 <> 5)"


@query("k1_parse_artifact", f"WITH {SQL_NOTES} SELECT id, title, scope, type, status, '/src/' || id || '.py|tk-' || CAST(p_partkey AS VARCHAR) AS evidence, other AS contradicts, 'That ' || title || ' holds.' AS claim FROM n")
def k1(spark, sf):
    return artifacts(spark, sf).select("id", "title", "scope", "type", "status", F.array_join("evidence", "|").alias("evidence"), F.array_join("contradicts", "|").alias("contradicts"), "claim")


@query("k2_artifact_age", f"WITH {SQL_NOTES} SELECT id, status, CASE WHEN p_partkey % 3 = 0 THEN noticed ELSE '2024-02-01' END AS since FROM n")
def k2(spark, sf):
    return a.artifact_age(artifacts(spark, sf)).select("id", "status", F.date_format("since", "yyyy-MM-dd").alias("since"))


@query("k3_link_contradictions", f"WITH {SQL_NOTES} SELECT id AS a, other AS b, other IN (SELECT id FROM n) AS known FROM n")
def k3(spark, sf):
    links, unknown = a.link_contradictions(artifacts(spark, sf))
    return links.withColumn("known", F.lit(True)).union(unknown.withColumn("known", F.lit(False)))


@query("a14_artifact_index", f"WITH {SQL_NOTES} SELECT type, scope, count(*) AS notes, string_agg(id, ' ' ORDER BY id) AS ids FROM n GROUP BY type, scope")
def a14(spark, sf):
    return a.artifact_index(artifacts(spark, sf)).withColumn("ids", F.array_join("ids", " "))


@query("k11_path_tokens", f"WITH {SQL_NOTES} SELECT id, '/src/' || id || '.py|lib/' || type || '.go|README.md' AS paths FROM n")
def k11(spark, sf):
    text = F.concat(F.lit("see /src/"), "id", F.lit(".py, (lib/"), "type", F.lit(".go) or README.md and README.md: "), "title")
    return artifacts(spark, sf).select("id", F.array_join(path_tokens(text), "|").alias("paths"))


def text_files(df, path: str, *columns: str) -> None:
    """Rows as lines of JSON in files of a folder."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("append").text(path)


# lines that Spark wrote are read by ranges of 20,000 bytes; the numbers of a file's lines are without gaps
@query("a1_scan_transcripts", "SELECT CASE WHEN conv_id % 2 = 0 THEN 'claude-code' ELSE 'codex-cli' END AS agent, 'p' || CAST(conv_id % 2 AS VARCHAR) AS project, conv_id, turn, true AS dense FROM conversations")
def a1(spark, sf):
    root, rows = new_path(spark, "a1"), spark.read.parquet(f"{sf}/conversations.parquet")
    for k, agent in enumerate(("claude-code", "codex-cli")):
        text_files(rows.where(F.col("conv_id") % 2 == k), f"{root}/{agent}/p{k}", "conv_id", "turn", "role", "text")
    lines = a.with_path_keys(ranges.numbered(ranges.scan(spark, root, ".txt", 20_000)), root)
    parsed = F.from_json("value", "conv_id LONG, turn LONG")
    kinds = dict(rows.dtypes)
    # the lines are counted and shown from one reading
    lines = written(lines.select("path", "line_no", "agent", "project", *(parsed[c].cast(kinds[c]).alias(c) for c in ("conv_id", "turn"))), "a1-lines")
    per = lines.groupBy("path").agg((F.count("*") == F.max("line_no")).alias("dense"))
    return lines.join(per, "path").select("agent", "project", "conv_id", "turn", "dense")


# even events are in the files at the first scan, odd ones have come by the second, which reads their bytes alone
@query("a15_incremental_scan", "SELECT event_id, event_id % 2 + 1 AS run FROM events")
def a15_incremental(spark, sf):
    root, rows = new_path(spark, "a15"), spark.read.parquet(f"{sf}/events.parquet")
    at, found = {}, None
    for k in (0, 1):
        text_files(rows.where(F.col("event_id") % 2 == k), root, "event_id", "ts")
        lines = written(ranges.scan(spark, root, ".txt", 50_000, offsets=at), "a15-run")
        at = ranges.advanced(lines, at)
        run = lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.lit(k + 1).cast("long").alias("run"))
        found = run if found is None else found.union(run)
    return found


@query("a9_stream_host_samples", "SELECT 'h' || CAST(user_id AS VARCHAR) AS host, event_id AS line, value FROM events")
def a9_stream(spark, sf):
    root = new_path(spark, "a9")
    text_files(spark.read.parquet(f"{sf}/events.parquet").withColumn("host", F.concat(F.lit("h"), F.col("user_id").cast("string"))), root, "host", "event_id", "value")
    parsed = F.from_json("value", "host STRING, event_id LONG, value DOUBLE")
    lines = ranges.stream(spark, root, ".txt", 50_000).select(parsed.alias("s"))
    return streams.kept_rows(lines.select("s.host", F.col("s.event_id").alias("line"), "s.value"), "a9-lines", None)
