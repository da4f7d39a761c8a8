"""Small inputs of many rows or ranges go to a number of tasks that fits them."""

import re

from tracewright.functions import tables
from tracewright.plans import registry
from tracewright.plans import source_queries as q


def test_notes_of_a_small_table_go_to_all_tasks(spark):
    assert q.artifacts(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_small_ranges_share_tasks():
    from tracewright.sources import ranges as r

    found = r.ranges("/f", 0, 40_000_000, 40_000_000, 0.0, 20_000) + r.ranges("/g", 0, 30, 30, 0.0, 20_000)
    tasks = r.packed(found)
    assert [x for t in tasks for x in t.ranges] == found and len(found) == 2001 and 96 <= len(tasks) <= 110
    assert [len(t.ranges) for t in r.packed(r.ranges("/f", 0, 4 * r.RANGE_BYTES, 0, 0.0, r.RANGE_BYTES))] == [1] * 4
    assert [t.ranges for t in r.packed([])] == [[]]


def dealings(df):
    return re.findall(r"hashpartitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_of_a_larger_table_go_to_more_tasks(spark, monkeypatch):
    """Lines, orders and pairs are each dealt to tasks of about TASK_ROWS rows, and nothing is dealt by the setting."""
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.queries()["m12_greedy_match"](spark, d).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500)
    got = registry.queries()["m12_greedy_match"](spark, d)
    assert tasks > 4 and dealings(got) == [str(tasks)] * 3
    assert sorted(map(tuple, got.collect())) == want


def test_commits_are_read_where_their_call_is(spark):
    """No line of a result is dealt or sorted; two calls of one number don't mix, and a statistics line counts for the commit before it only."""
    from tracewright.operators import transcripts as t

    text = "9 files changed\n\t[main abcdef1] one \r\nnoise\n 1 file changed\n2 files changed\n[main abcdef2] two\n[x (root-commit) abcdef3] 5 files changed\n[no] 7\n \x0b3 files changed"
    rows = [("s", 0, "bash", text), ("s", 0, "custom", "[dev 1234567] three"), ("s", 1, "bash", None), ("s", 2, "bash", "4 files changed"), ("s", 3, "read", text), ("s", 4, "bash", "")]
    calls = spark.createDataFrame(rows, "session_id string, seq long, tool_kind string, result_summary string").selectExpr("'a' AS agent", "*", "timestamp_ntz'2024-01-01' AS started_at", "timestamp_ntz'2024-01-01' AS session_start")
    got = t.extract_commits(calls)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(tuple(r) for r in got.select("seq", "part", "branch", "commit_hash", "subject", "files_changed").collect()) == [(0, 1, "dev", "1234567", "three", None), (0, 1, "main", "abcdef1", "one", 1), (0, 2, "main", "abcdef2", "two", None), (0, 3, "x (root-commit)", "abcdef3", "5 files changed", 3)]


def test_paths_of_a_larger_table_go_to_more_tasks(spark, monkeypatch):
    """Calls and events (grouped to one a line, twice) and their paths are each dealt to tasks of about TASK_ROWS rows, and nothing is dealt by the setting."""
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.queries()["b9_codex_files"](spark, d).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500)
    got = registry.queries()["b9_codex_files"](spark, d)
    assert tasks > 4 and dealings(got) == [str(tasks)] * 3
    assert sorted(map(tuple, got.collect())) == want
