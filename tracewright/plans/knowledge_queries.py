"""Queries of knowledge notes, text, change logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.scalars import friction_signature
from tracewright.functions.tables import new_path, shared_dir
from tracewright.operators import journal as j
from tracewright.operators import knowledge as k
from tracewright.operators import text as x
from tracewright.plans.adapters import cte
from tracewright.plans.friction_queries import SIGNATURE
from tracewright.plans.registry import query
from tracewright.sources import versions
from tracewright.streaming import streams as p

STOP = ", ".join(f"'{w}'" for w in k.STOP_WORDS)
#: The items share few words, so their pairs are taken from a lower similarity on.
LEAST = 0.06
WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({STOP})))"


def notes(spark, sf):
    """Benchmark items as notes, two files a node."""
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.floor(F.col("item_id") / 2).alias("node"), F.col("item_id").alias("file"), k.keyword_set(F.col("text")).alias("words"))


@query("k4_dupe_key", "SELECT page_id, regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '--20240102-030405' ELSE '' END, '--\\d{8}-\\d{6}$', '') AS key FROM pages")
def k4(spark, sf):
    stamped = F.concat("url", F.when(F.col("page_id") % 2 == 0, "--20240102-030405").otherwise(""))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", k.dupe_key(stamped).alias("key"))


@query("k5_same_id_groups", "SELECT key, count(*) AS files, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT p_name AS key, p_name || '--' || CAST(20240000 + p_size AS VARCHAR) || '-000000' AS id FROM part) GROUP BY key HAVING count(*) > 1")
def k5(spark, sf):
    return k.same_id_groups(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_name || '--' || CAST(20240000 + p_size AS STRING) || '-000000' AS id"))


@query("k6_keyword_set", f"SELECT doc_id, len({WORDS}) AS words, array_to_string(list_sort({WORDS}), ' ') AS keywords FROM documents")
def k6(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", k.keyword_set(F.col("text")).alias("k"))
    return docs.select("doc_id", F.size("k").cast("long").alias("words"), F.array_join(F.array_sort("k"), " ").alias("keywords"))


PAIRS = f"""WITH s AS (SELECT item_id // 2 AS node, item_id AS file, {WORDS} AS words FROM benchmark), t AS (SELECT node, file, len(words) AS n, unnest(words) AS word FROM s),
e AS (SELECT a.node AS a, b.node AS b, count(*) / (a.n + b.n - count(*)) AS score FROM t a JOIN t b ON a.word = b.word AND a.node < b.node GROUP BY a.node, a.file, a.n, b.node, b.file, b.n),
pairs AS (SELECT a, b, max(score) AS score FROM e GROUP BY a, b HAVING max(score) >= {LEAST})"""


@query("k7_jaccard_pairs", f"{PAIRS} SELECT a, b, round(score, 9) AS score FROM pairs")
def k7(spark, sf):
    return k.jaccard_pairs(notes(spark, sf), LEAST).withColumn("score", F.round("score", 9))


@query("k8_clusters")
def k8(spark, sf):
    shared_dir(spark)
    members = notes(spark, sf).select("node").distinct()
    return k.clusters(members, k.jaccard_pairs(notes(spark, sf), LEAST), LEAST)


@query("k9_partition_faults", "WITH g AS (SELECT CASE WHEN c_custkey = 3 THEN 4 WHEN c_custkey = 9 THEN 99999999 ELSE c_custkey END AS node FROM customer), n AS (SELECT node, count(*) AS c FROM g GROUP BY node) SELECT coalesce(m.c_custkey, n.node) AS node, CASE WHEN m.c_custkey IS NULL THEN 'foreign' WHEN n.node IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM customer m FULL JOIN n ON m.c_custkey = n.node WHERE m.c_custkey IS NULL OR n.node IS NULL OR c > 1")
def k9(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    groups = customer.selectExpr("c_nationkey AS g", "CASE WHEN c_custkey = 3 THEN 4 WHEN c_custkey = 9 THEN 99999999 ELSE c_custkey END AS node")
    return k.partition_faults(customer.select(F.col("c_custkey").alias("node")), groups)


NOTE_WORDS = WORDS.replace("text", "p_name")
RELEVANT = f"""WITH t AS (SELECT s_suppkey AS ticket, ['tk-' || CAST(s_suppkey AS VARCHAR)] AS cites, ['/src/m' || CAST(s_suppkey % 50 AS VARCHAR) || '.py'] AS paths, {NOTE_WORDS} AS words FROM supplier JOIN part ON s_suppkey = p_partkey),
n AS (SELECT p_partkey AS note, ['tk-' || CAST(p_partkey AS VARCHAR)] AS cited, ['/src/m' || CAST(p_partkey % 50 AS VARCHAR) || '.py'] AS evidence, {NOTE_WORDS} AS words FROM part),
c AS (SELECT ticket, note, len(list_intersect(cites, cited)) AS c, len(list_intersect(paths, evidence)) AS f, len(list_intersect(t.words, n.words)) AS w FROM t, n),
s AS (SELECT ticket, note, CASE WHEN c > 0 THEN 2 WHEN f > 0 THEN 1 ELSE 0 END AS tier, CASE WHEN c > 0 THEN 100 ELSE 0 END + 10 * f + CASE WHEN w >= 2 THEN w ELSE 0 END AS score FROM c)
SELECT ticket, note, tier, score, row_number() OVER (PARTITION BY ticket ORDER BY tier DESC, score DESC, note)::INT AS rank FROM s WHERE score > 0"""


@query("k10_rank_relevant", RELEVANT)
def k10(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    words = k.keyword_set(F.col("p_name"))
    tickets = spark.read.parquet(f"{sf}/supplier.parquet").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("ticket"), F.array(F.concat(F.lit("tk-"), F.col("s_suppkey").cast("string"))).alias("cites"), F.array(F.concat(F.lit("/src/m"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".py"))).alias("paths"), words.alias("words"))
    n = part.select(F.col("p_partkey").alias("note"), F.array(F.concat(F.lit("tk-"), F.col("p_partkey").cast("string"))).alias("cited"), F.array(F.concat(F.lit("/src/m"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py"))).alias("evidence"), words.alias("note_words"))
    return k.rank_relevant(tickets, n)


@query("k12_citation_ids", f"{cte('tickets')} SELECT id, array_to_string(list_filter([id, CASE WHEN contains(id, '/') THEN regexp_replace(id, '^[^/]*/', '') END, parent], lambda x: x IS NOT NULL), ',') AS cites FROM tickets")
def k12(spark, sf):
    from tracewright.plans.adapters import table

    return table(spark, sf, "tickets").select("id", F.array_join(k.citation_ids(F.col("id"), F.col("parent")), ",").alias("cites"))


@query("l1_redact")
def l1(spark, sf):
    return x.redacted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


@query("l2_redaction_counts")
def l2(spark, sf):
    got = x.redacted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return got.agg(*(F.sum(c).alias(c) for c in got.columns if c.startswith("n_")))


JOURNAL = "SELECT user_id AS key, event_id AS line_no, {v} AS value, event_type = 'signup' AS deleted FROM events"


def journal(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS key", "event_id AS line_no", "props AS value", "event_type = 'signup' AS deleted")


@query("a17_journal_latest", f"WITH j AS ({JOURNAL.format(v='props')}) SELECT * FROM (SELECT key, max(line_no) AS line_no, arg_max(value, line_no) AS value, arg_max(deleted, line_no) AS deleted FROM j GROUP BY key) WHERE NOT deleted")
def a17(spark, sf):
    return j.journal_latest(journal(spark, sf), ["key"])


@query("a16_snapshot_delta", f"""WITH j AS ({JOURNAL.format(v='props')}), l AS (SELECT * FROM (SELECT key, arg_max(value, line_no) AS value, arg_max(deleted, line_no) AS deleted FROM j GROUP BY key) WHERE NOT deleted),
s AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN v ELSE c_name END AS value FROM customer LEFT JOIN (SELECT key, value AS v FROM l) ON c_custkey = key WHERE c_custkey % 2 = 0)
SELECT coalesce(l.key, s.key) AS key, s.value, s.key IS NULL AS deleted FROM l FULL JOIN s ON l.key = s.key WHERE l.key IS NULL OR s.key IS NULL OR l.value IS DISTINCT FROM s.value""")
def a16(spark, sf):
    latest = j.journal_latest(journal(spark, sf), ["key"])
    c = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), "c_name")
    snap = c.join(latest.select("key", F.col("value").alias("v")), "key", "left").select("key", F.when(F.col("key") % 3 == 0, F.col("v")).otherwise(F.col("c_name")).alias("value"))
    return j.snapshot_delta(latest, snap)


@query("a5_changed_sessions", "WITH f AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderkey % 4 = 0 THEN greatest(o_orderdate, o_orderdate + INTERVAL 1 DAY) ELSE o_orderdate END AS mtime FROM orders), m AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size, o_orderdate AS mtime FROM orders WHERE o_orderkey % 9 <> 0) SELECT f.* FROM f LEFT JOIN m USING (path) WHERE f.size IS DISTINCT FROM m.size OR f.mtime IS DISTINCT FROM m.mtime")
def a5(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    files = o.selectExpr("o_orderkey AS path", "CAST(floor(o_totalprice) AS BIGINT) AS size", "o_orderdate AS mtime", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS child_mtime")
    manifest = o.where("o_orderkey % 9 <> 0").selectExpr("o_orderkey AS path", "CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size", "o_orderdate AS mtime")
    return j.changed_sessions(files, manifest)


@query("a7_path_collisions", "SELECT 'a' AS agent, l_orderkey AS session_id, arg_max(l_partkey, (l_shipdate, l_partkey)) AS path, count(DISTINCT l_partkey)::INT AS paths FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 1")
def a7(spark, sf):
    folds = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.lit("a").alias("agent"), F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("path"), F.struct("l_shipdate", "l_partkey").alias("fold_order"))
    return j.path_collisions(folds)


BATCHES = "SELECT CAST(user_id AS {s}) AS session_id, event_id AS arrival, CAST(5 * (event_id % 3) AS BIGINT) AS from_offset, CAST(5 * (event_id % 3) + 5 - 7 * CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS to_offset FROM {t}"
FOLD = f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM ({BATCHES.format(s='VARCHAR', t='events')})),
v AS (SELECT session_id, 0::BIGINT AS n, 0::BIGINT AS nxt, NULL::BIGINT AS arrival, NULL::VARCHAR AS verdict FROM b GROUP BY session_id
 UNION ALL SELECT b.session_id, b.n, CASE WHEN to_offset >= from_offset AND from_offset = nxt THEN to_offset ELSE nxt END, b.arrival, CASE WHEN to_offset < from_offset THEN 'bad' WHEN from_offset = nxt THEN 'append' WHEN to_offset <= nxt THEN 'replay' ELSE 'conflict' END FROM v JOIN b ON b.session_id = v.session_id AND b.n = v.n + 1)"""


@query("a18_reconcile_batches", f"{FOLD} SELECT session_id, arrival, verdict, max(nxt) OVER (PARTITION BY session_id) AS next_offset FROM v WHERE n > 0")
def a18(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("batch_events")
    return j.classify_batches(spark.sql(BATCHES.format(s="STRING", t="batch_events")))


@query("p2_stream_offsets", f"{FOLD} SELECT session_id, arrival, verdict FROM v WHERE n > 0")
def p2(spark, sf):
    return p.offsets(p.events_stream(spark, sf).selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS arrival", "CAST(5 * (event_id % 3) AS BIGINT) AS from_offset", "CAST(5 * (event_id % 3) + 5 - 7 * CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS to_offset"))


SESSION_EVENTS = ["'events' AS agent", "'u' || CAST(user_id AS STRING) AS session_id", "event_id", "ts", "value"]


@query("p1_stream_sessions", "SELECT 'events' AS agent, 'u' || CAST(user_id AS VARCHAR) AS session_id, count(*) AS records, min(event_id) AS first_id, max(ts) AS last_ts FROM events GROUP BY user_id")
def p1(spark, sf):
    table = new_path(spark, "p1")
    whole = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*SESSION_EVENTS)
    fold = lambda rows: rows.groupBy("agent", "session_id").agg(F.count("*").alias("records"), F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"))
    p.sessions(p.events_stream(spark, sf).selectExpr(*SESSION_EVENTS), fold, lambda touched: whole.join(touched, ["agent", "session_id"], "left_semi"), table)
    return versions.current(spark, table)


# all sessions first; then every third is read again, of which only the calls above the first are left, and every sixth has none
@query("a6_upsert_session", "SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS session_id, l_linenumber AS seq, count(*) AS rows FROM lineitem WHERE l_orderkey % 3 <> 0 OR (l_orderkey % 6 <> 0 AND l_linenumber > 1) GROUP BY ALL")
def a6(spark, sf):
    table = new_path(spark, "a6")
    calls = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("session_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq")).agg(F.count("*").alias("rows"))
    versions.upsert(table, ["session_id"], calls.select("session_id"), lambda: calls.drop("k"))
    again = calls.where("k % 3 = 0")
    versions.upsert(table, ["session_id"], again.select("session_id"), lambda: again.where("k % 6 <> 0 AND seq > 1").drop("k"))
    return versions.current(spark, table)


@query("p3_stream_host_samples", "SELECT 'h' || CAST(user_id AS VARCHAR) AS host, date_trunc('hour', ts) AS ts, max(event_id) AS line, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def p3(spark, sf):
    return p.host_samples(p.events_stream(spark, sf).selectExpr("'h' || CAST(user_id AS STRING) AS host", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS ts", "event_id AS line", "value"))


@query("m3_host_samples_range", "SELECT 'h' || CAST(user_id AS VARCHAR) AS host, ts, event_id AS line FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:01' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def m3(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("'h' || CAST(user_id AS STRING) AS host", "ts", "event_id AS line")
    return p.sample_range(rows, "2024-01-10 00:00:00.5", "2024-01-20 00:00:00")


DENSITY = f"{cte('friction')} SELECT date_trunc('day', ts)::TIMESTAMP AS day, kind, {SIGNATURE} AS signature, count(*) AS events FROM friction WHERE ts IS NOT NULL GROUP BY ALL"


@query("p4_stream_friction_density", DENSITY)
def p4(spark, sf):
    from tracewright.plans.adapters import TABLES

    _, columns, where = TABLES["friction"]
    rows = p.events_stream(spark, sf).where(where).selectExpr(*columns).where("ts is not null")
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "kind", friction_signature(F.col("message")).alias("signature"))
    return p.friction_density(rows).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("p6_stream_token_deltas", "WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, event_id % 1000 AS total, CAST(floor(value) AS BIGINT) AS last, lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM events) SELECT session_id, seq, CASE WHEN base IS NOT NULL AND total >= base THEN total - base ELSE last END AS used FROM e")
def p6(spark, sf):
    return p.token_deltas(p.events_stream(spark, sf).selectExpr("'u' || CAST(user_id AS STRING) AS session_id", "event_id AS seq", "event_id % 1000 AS total", "CAST(floor(value) AS BIGINT) AS last"))
