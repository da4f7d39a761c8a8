"""Run trees (F7) carry numbers from level to level, and the queries on them fold executions once."""

from tracewright.operators import registry_runs as f

RUNS = [("r", "a", None, "root", 1), ("r", "b", "a", "subagent", 3), ("r", "c", "a", "human", 2), ("r", "d", "c", "subagent", None), ("r", "e", "b", "human", 4), ("r", "x", "gone", "subagent", 1), ("r", "y", "y", "subagent", 1), ("q", "b", "a", "subagent", 1), ("q", "z", None, "root", None), ("q", "w", None, "root", None)]


def test_only_what_is_asked_is_carried(spark, monkeypatch):
    runs = spark.createDataFrame(RUNS, "run_id string, execution_id string, parent_execution_id string, execution_kind string, started_at long")
    columns, written = {}, f.written
    monkeypatch.setattr(f, "written", lambda df, name: columns.setdefault(name, df.columns) and written(df, name))
    got = f.build_tree(runs, trail=(), keep=("execution_kind",))
    assert got.columns == ["run_id", "execution_id", "parent_execution_id", "depth", "state", "execution_kind"]
    assert columns["tree"] == ["no", "state", "depth", "barred"] and columns["tree-links"] == ["no", "above", "has_parent", "human"]
    whole = f.build_tree(runs).drop("walk").collect()
    at = {(r.run_id, r.execution_id): (r.depth, r.state) for r in whole}
    assert {(r.run_id, r.execution_id): (r.depth, r.state) for r in got.collect()} == at and len(at) == len(RUNS)
    assert at["r", "d"] == (2, "placed") and at["r", "e"][1] == "invalid_parent" and at["r", "y"][1] == "cyclic" and at["q", "b"][1] == "orphan" and at["q", "z"][1] == "second_root"
    assert sorted(map(str, f.build_tree(runs, trail=("path",)).collect())) == sorted(map(str, whole))
    assert {r.path for r in whole if r.path} == {"a", "a/b", "a/c", "a/c/d", "w"}


def test_run_summaries_fold_executions_once(spark, monkeypatch):
    from tracewright.plans import attribution_queries as q

    calls, executions = [], q.executions
    monkeypatch.setattr(q, "executions", lambda *a: calls.append(1) or executions(*a))
    assert q.g11(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
