import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import transcripts as t
from tracewright.sources import files as s
from tracewright.sources import versions
from tracewright.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def user(k, text="hi", **more):
    return json.dumps({"type": "user", "timestamp": f"2024-01-01T00:00:{k:02d}Z", "message": {"role": "user", "content": text}, **more})


def test_transcripts_and_sidecars(spark, tmp_path):
    root = tmp_path / "received"
    put(root / "claude-code/p1/s1.jsonl", user(1) + "\n\n" + user(2) + "\n" + '{"type": "user", "cut')
    put(root / "claude-code/p1/s1/subagents/x.jsonl", user(3))
    put(root / "claude-code/p1/s1.meta.json", '{"git_remote": "git@h:o/r.git", "cwd": "/w"}')
    put(root / "claude-code/p1/child.subagent.json", '{"parent_session_id": "s1", "agent_type": "explorer", "tool_use_id": "t1"}')
    put(root / "codex-cli/p2/s2.jsonl", '{"type": "session_meta"}\n' + json.dumps({"type": "event_msg", "payload": {"type": "task_started", "turn_id": "external-import-turn-1"}}))
    lines = s.scan_transcripts(spark, str(root))
    own = lines.where("not is_subagent")
    assert [(r.session_id, r.line_no) for r in own.where("agent = 'claude-code'").orderBy("line_no").collect()] == [("s1", 1), ("s1", 3), ("s1", 4)]
    assert [tuple(r) for r in s.imported_copies(own).collect()] == [("codex-cli", "s2")]
    known = s.with_identity(own.select("agent", "session_id").distinct(), s.identity_sidecars(spark, str(root)))
    assert {r.session_id: r.git_remote for r in known.collect()} == {"s1": "git@h:o/r.git", "s2": ""}
    child = s.subagent_sidecars(spark, str(root)).collect()[0]
    assert (child.session_id, child.parent_session_id, child.agent_type, child.tool_use_id) == ("child", "s1", "explorer", "t1")


def test_registry_and_host_samples(spark, tmp_path):
    put(tmp_path / "r/a.jsonl", '{"v": 1}\nnot json\n' + '{"x": "' + "y" * (1 << 20) + '"}\n')
    good, bad = s.registry_lines(s.scan_lines(spark, str(tmp_path / "r")))
    assert good.count() == 1 and sorted((r.line_no, r.detail) for r in bad.collect()) == [(2, None), (3, "bytes>1048576")]
    put(tmp_path / "h/a.jsonl", '{"v": 1, "ts": "2024-01-01T00:00:00Z", "host": "a", "cpu": {"user_pct": 1.5}}\n{"v": 9, "ts": "2024-01-01T00:00:01Z", "host": "a", "cpu": {"user_pct": 2}}\n{"v": 1, "ts": "yesterday", "host": "a"}\n{"v"')
    good, bad = s.host_samples(s.scan_lines(spark, str(tmp_path / "h")))
    assert sorted((r.v, r.cpu_user_pct) for r in good.collect()) == [(1, 1.5), (9, None)] and bad.collect()[0].malformed == 2


def test_only_complete_lines(spark):
    df = spark.createDataFrame([("a\n\nb\nc",), ("x",), ("y\n",)], "t string")
    assert [r[0] for r in df.select(s.complete_lines(F.col("t"))).collect()] == [["a", "b"], [], ["y"]]


NOTE = "---\nid: {id}\ntitle: T\nstatus: kept\nstatus: {status}\nevidence: [a.py, 'b/c.py']\ncontradicts:\n  - n2\n  - nowhere\nfirst_noticed: 2024-02-0{d}\n---\n## Claim\nIt is so.\n\n## How to verify\nrun\n"


def test_notes(spark, tmp_path):
    root = tmp_path / "notes"
    put(root / "candidate/truth/p1/n1.md", NOTE.format(id="n1", status="candidate", d=3))
    put(root / "kept/truth/universal/n2.md", NOTE.format(id="n2", status="kept", d=2))
    put(root / "kept/truth/_hidden/n3.md", NOTE.format(id="n3", status="kept", d=1))
    put(root / "kept/truth/p1/README.md", NOTE.format(id="n4", status="kept", d=1))
    put(root / "kept/truth/p1/n5.md", "no head")
    notes = s.scan_artifacts(spark, str(root))
    got = {r.id: r for r in notes.collect()}
    assert set(got) == {"n1", "n2"} and got["n1"].status == "candidate" and got["n1"].evidence == ["a.py", "b/c.py"] and got["n1"].contradicts == ["n2", "nowhere"] and got["n1"].claim == "It is so."
    links, warnings = s.link_contradictions(notes)
    assert sorted(map(tuple, links.collect())) == [("n1", "n2"), ("n2", "n2")] and {r.b for r in warnings.collect()} == {"nowhere"}
    assert [r.id for r in s.artifact_age(notes).collect()] == ["n1", "n2"]
    assert [(r.scope, r.ids) for r in s.artifact_index(notes).collect()] == [("p1", ["n1"]), ("universal", ["n2"])]


def rates(**odd):
    entry = {"model": "m", "effective": "2024-01-01", "input": 1, "output": 2, "cache_write_5m": 1, "cache_write_1h": 2, "cache_read": 0.1}
    return json.dumps({"currency": "USD", "source": "list", "checked": "2024-01-02", "rates": [{"model": "n", **{k: v for k, v in entry.items() if k != "model"}}, {**entry, **odd}]})


def test_rates(spark, tmp_path):
    put(tmp_path / "ok.json", rates(source="own"))
    got = {r.model: r for r in s.load_rates(spark, str(tmp_path / "ok.json")).collect()}
    assert got["m"].source == "own" and got["n"].source == "list" and got["m"].input_rate == 1.0
    for k, odd in enumerate(({"input": None}, {"output": -1}, {"fast_input": 3}, {"effective": "soon"}, {"model": "n"})):
        put(tmp_path / f"bad{k}.json", rates(**odd))
        with pytest.raises(ValueError, match="refused"):
            s.load_rates(spark, str(tmp_path / f"bad{k}.json"))


def test_tables_without_needed_columns_are_refused(spark):
    with pytest.raises(ValueError, match="rebuild"):
        s.require_columns(spark.range(1), ["id", "speed"])


def test_stream_of_sessions_equals_the_batch(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "table")
    fold = lambda lines: t.message_turns(lines)
    reread = lambda touched: s.scan_transcripts(spark, str(root)).select("agent", "session_id", "line_no", "value").join(touched, ["agent", "session_id"], "left_semi")

    def run():
        stream = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(str(root)).withColumn("path", F.col("_metadata.file_path"))
        streams.sessions(s.with_path_keys(stream, str(root)), fold, reread, table)
        return sorted((r.session_id, r.turns) for r in versions.current(spark, table).collect())

    put(root / "claude-code/p/a.jsonl", user(1, promptId="p1") + "\n" + user(2, promptId="p2"))
    put(root / "claude-code/p/b.jsonl", user(1, promptId="p1"))
    assert run() == [("a", 2), ("b", 1)]
    put(root / "claude-code/p/c.jsonl", user(1, promptId="p1"))
    assert run() == [("a", 2), ("b", 1), ("c", 1)]


def test_a_state_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    s.replace_state(spark.range(3), path, 0)
    s.replace_state(spark.range(7, 9), path, 1)
    s.replace_state(spark.range(5, 6), path, 1)
    assert [r.id for r in s.current_state(spark, path).collect()] == [5]
    s.replace_state(spark.range(0), path, 2)
    assert s.current_state(spark, path).collect() == []


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "session_id string, n int")
    shown = lambda: sorted(map(tuple, versions.current(spark, table).collect()))
    put_ = lambda r, batch=None, keys=None: versions.upsert(table, ["session_id"], keys or r.select("session_id"), lambda: r, batch)
    with pytest.raises(ValueError, match="no version"):
        shown()
    put_(rows(("a", 1), ("a", 2), ("b", 1)), 0)
    broken = rows(("a", 9), ("b", 9)).withColumn("n", F.when(F.col("session_id") == "b", F.raise_error("torn").cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="torn"):
        put_(broken, 1)
    assert shown() == [("a", 1), ("a", 2), ("b", 1)]
    # a rewrite drops a session's old rows; a batch that runs again changes nothing
    assert put_(rows(("a", 3)), 1) == 1 and put_(rows(("a", 4)), 1) == 1
    assert shown() == [("a", 3), ("b", 1)]
    put_(rows(("c", 1)).limit(0), 2, rows(("b", 0)).select("session_id"))
    assert shown() == [("a", 3)]


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    table, real, raced = str(tmp_path / "t"), versions.publish, []
    rows = lambda *r: spark.createDataFrame(r, "session_id string, n int")

    def publish(session, where, version):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(versions, "publish", real)
            versions.upsert(table, ["session_id"], rows(("b", 1)).select("session_id"), lambda: rows(("b", 1)))
        real(session, where, version)

    monkeypatch.setattr(versions, "publish", publish)
    assert versions.upsert(table, ["session_id"], rows(("a", 1)).select("session_id"), lambda: rows(("a", 1))) == 1
    assert sorted(map(tuple, versions.current(spark, table).collect())) == [("a", 1), ("b", 1)]
    for k in range(5):
        versions.upsert(table, ["session_id"], rows(("a", 1)).select("session_id"), lambda k=k: rows(("a", k)))
    assert len(list((tmp_path / "t/versions").glob("[0-9]*.json"))) == versions.KEPT + 0 and sorted(map(tuple, versions.current(spark, table).collect())) == [("a", 4), ("b", 1)]


def test_a_stream_goes_on_after_a_restart_with_its_state(spark, tmp_path):
    schema = "session_id string, arrival long, from_offset long, to_offset long"
    at = str(tmp_path / "stream")

    def arrive(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={k}")
        return {tuple(r) for r in streams.offsets(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), at).collect()}

    (tmp_path / "in").mkdir()
    first = arrive(0, [("s", 0, 0, 5), ("t", 0, 0, 3)])
    assert first == {("s", 0, "append"), ("t", 0, "append")}
    # what comes late, with an earlier arrival, is judged by the offset that is accepted by then
    second = arrive(1, [("s", 2, 5, 9), ("s", 1, 0, 5), ("u", 0, 1, 2)])
    assert second - first == {("s", 1, "replay"), ("s", 2, "append"), ("u", 0, "conflict")}
    third = arrive(2, [("t", 1, 3, 4)])
    assert third - second == {("t", 1, "append")}
    # a batch writes its own rows only
    assert spark.read.parquet(f"{at}/table/part=2").count() == 1
