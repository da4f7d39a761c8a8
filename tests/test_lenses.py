"""The command grammar of lens calls, case by case."""

import pytest

from tracewright.operators import lenses as ln
from tracewright.plans import registry

CALL = "~/.codex/codex-lens.sh --lens security --payload /tmp/c.md"
ALONE = {
    CALL: True, f"bash -lc {CALL}": True, f"S=/tmp/s {CALL}": True, f"{CALL} 2> /tmp/e": True, f"{CALL} 2>/dev/null": True,
    f"{CALL} > /tmp/v": False, f"{CALL} >> /tmp/v": False, f"{CALL} 2>&1": False, f"{CALL}; cat R": False, f"{CALL} && cat R": False, f"{CALL} || cat R": False, f"{CALL} | tee /tmp/v": False, f"{CALL}\ncat R": False, f"cat R; {CALL}": False, f"{CALL}…": False, "": False,
}
REDIRECT = {
    f"{CALL} > /tmp/v": "/tmp/v", f"{CALL} >/tmp/v": "/tmp/v", f'{CALL} > "/tmp/v"': "/tmp/v", f"sh -c {CALL} > /tmp/v": "/tmp/v", f"{CALL} > /tmp/v 2> /tmp/e": "/tmp/v", f"{CALL} 2> /tmp/e > /tmp/v": "/tmp/v",
    f"{CALL} >> /tmp/v": None, CALL: None, f"{CALL}; cat R > /tmp/n": None, f"{CALL} > /tmp/v; cat R": None, f"{CALL} > /tmp/v > /tmp/o": None, f"{CALL} > /tmp/v 2>&1": None, f"{CALL} > /tmp/v…": None, f"{CALL} > /tmp/v\ncat /tmp/v": None,
}
CUT = {
    "/x/codex-lens.sh --runt…": True, "S=/tmp/s\nmkdir -p $S\n/x/codex-lens.sh --runt…": True, "cd /tmp && /x/codex-lens.sh --payload /tm…": True, "/x/codex-lens.sh 2> /tmp/e --payload /…": True, "/x/codex-lens.sh --lens sec…": True, "/x/codex-lens.sh --lens …": True,
    "/x/codex-lens.sh --lens bogus --at…": False, "/x/codex-lens.sh --runtime a": False, "/x/codex-lens.sh --runtime a; cat /t…": False, "/x/codex-lens.sh --runtime a | tee /t…": False, "echo codex-lens.sh is at /x…": False, "cat R…": False,
}
READS = {"cat /tmp/v": "/tmp/v", "cat -- /tmp/v": "/tmp/v", 'cat "/tmp/v"': "/tmp/v", "/bin/cat /tmp/v": "/tmp/v", "bash -lc cat /tmp/v": "/tmp/v", "cat -n /tmp/v": None, "cat R /tmp/v": None, "rg --passthru /tmp/v": None, "cat /tmp/v; cat R": None, "": None}


@pytest.mark.parametrize("column,cases", [("alone", ALONE), ("redirect", REDIRECT), ("cut", CUT), ("reads", READS)])
def test_command_grammar(spark, column, cases):
    got = ln.lens_calls(spark.createDataFrame([("bash", k) for k in cases], "kind string, key_arg string"))
    assert {r.key_arg: r[column] for r in got.collect()} == cases


def test_calls_without_argument(spark):
    got = ln.lens_calls(spark.createDataFrame([("bash", None), (None, None), ("task", CALL)], "kind string, key_arg string")).collect()
    assert [(r.lens, r.cut, r.redirect, r.reads) for r in got] == [(None, False, None, None)] * 2 + [("security", False, None, None)]


def test_a_record_without_an_end_in_the_call_s_time(spark):
    at = "2024-01-01 00:00:{:02d}".format
    calls = spark.createDataFrame([("r", 0, 1, "c1", "bash", "security", False, at(10), 0), ("r", 0, 2, "c2", "bash", "security", False, at(12), 3000), ("r", 0, 3, "c3", "task", "security", False, at(12), 0)], "run_id string, turn_idx long, seq long, call_id string, kind string, lens string, cut boolean, started_at string, duration_ms long")
    records = spark.createDataFrame([("r", "late", None, "security", at(50)), ("r", "soon", None, "security", at(19)), ("r", "early", None, "security", at(4)), ("r", "named", "c3", "quality", None)], "run_id string, record_id string, dispatch_id string, r_lens string, r_started string")
    got = ln.join_records(calls.withColumn("started_at", calls.started_at.cast("timestamp")), records.withColumn("r_started", records.r_started.cast("timestamp")))
    assert sorted(tuple(r) for r in got.collect()) == [("r", "c1", "soon", "time"), ("r", "c3", "named", "dispatch")]


def test_child_verdicts_of_order_keys_beyond_an_int(spark, tmp_path):
    keys = [13 * k + 8 for k in (1, 2, 3)]
    spark.createDataFrame([(k + 13 * 10**9, k % 3, None) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp").selectExpr("o_orderkey", "o_custkey", "timestamp '1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            got = registry.queries()["h8_child_lens_verdict"](spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert sorted(r.run_id for r in got) == sorted(f"r{k + 13 * 10**9}" for k in keys)


def test_records_are_joined_once_for_all_events(spark):
    from tracewright.plans import lens_queries as q

    t = q.run_tables(spark, "/root/testdata/sf0.001")
    events = ln.lens_events(t["runs"], t["texts"], t["calls"], t["responses"], t["records"], ln.join_records(t["calls"], t["records"]))
    # the walk of records would run again for each kind of event
    assert "MapInArrow" not in events._jdf.queryExecution().optimizedPlan().toString()


def test_executions_are_folded_once_for_all_groups(spark):
    got = registry.queries()["g10_lens_groups"](spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_calls_and_records_of_a_run_meet_where_both_come_from_joins_on_it(spark):
    """Without a broadcast both sides of the union are dealt by run already, and adaptive execution reads each in its own number of tasks."""
    runs = [f"r{k}" for k in range(400)]
    of = lambda rows, names: spark.createDataFrame(rows, names).join(spark.createDataFrame([(r,) for r in runs], "run_id string"), "run_id", "left_semi")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        calls = of([(r, 0, 1, "c", "task", "security", False, None, 0) for r in runs], "run_id string, turn_idx long, seq long, call_id string, kind string, lens string, cut boolean, started_at timestamp, duration_ms long")
        records = of([(r, f"e{k}", "c" if k == 7 else f"{k}{r * 9}", "security", None) for r in runs for k in range(20)], "run_id string, record_id string, dispatch_id string, r_lens string, r_started timestamp")
        got = ln.join_records(calls, records).collect()
        assert sorted(tuple(r) for r in got) == sorted((r, "c", "e7", "dispatch") for r in runs)
    finally:
        for name in settings:
            spark.conf.unset(name)
