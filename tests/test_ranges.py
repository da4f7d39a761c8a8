"""Lines by byte ranges and offsets, against a plain reading of the files."""

import random

import pytest

from tracewright.sources import ranges as rg
from tracewright.streaming import streams


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_each_line_belongs_to_one_range(tmp_path, monkeypatch, block):
    monkeypatch.setattr(rg, "BLOCK", block)
    rng = random.Random(2)
    for n in range(40):
        data = b"".join(bytes(rng.choice(b"ab\xc3") for _ in range(rng.choice([0, 0, 1, 3, 30]))) + b"\n" for _ in range(rng.randrange(12)))
        data += rng.choice([b"", b"torn"])
        path = tmp_path / f"{n}.jsonl"
        path.write_bytes(data)
        for size in (1, 2, 5, 1000):
            got = [x for r in rg.ranges(str(path), 0, len(data), len(data), 0, size) for x in rg.lines_of(r)]
            want = data.split(b"\n")
            want = want if want[-1] else want[:-1]
            assert [x for _, _, x in got] == want
            assert all(data[a : a + len(x)] == x for a, _, x in got)
        assert rg.last_line_end(str(path), len(data)) == data.rfind(b"\n") + 1


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/big.jsonl").write_text("".join(f"line {k}\n" if k % 5 else "\n" for k in range(1, 3001)) + "last\r\n")
    (tmp_path / "a/small.jsonl").write_text("one")
    (tmp_path / "a/.hidden.jsonl").write_text("x\n")
    (tmp_path / "a/other.txt").write_text("x\n")
    scan = rg.scan(spark, str(tmp_path), range_bytes=1000)
    assert scan.rdd.getNumPartitions() > 10
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in rg.numbered(scan).collect())
    assert got == sorted([("big.jsonl", k, f"line {k}") for k in range(1, 3001) if k % 5] + [("big.jsonl", 3001, "last"), ("small.jsonl", 1, "one")])
    assert rg.scan(spark, str(tmp_path / "nowhere")).collect() == []


def test_a_second_run_reads_the_new_bytes(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("1\n2\nto")
    b.write_text("x\ny\n")

    def run(offsets):
        lines = rg.scan(spark, str(tmp_path), offsets=offsets, range_bytes=3)
        return sorted(r.value for r in lines.collect()), rg.advanced(lines, offsets)

    got, at = run({})
    assert got == ["1", "2", "x", "y"] and at == {str(a): 4, str(b): 4}
    assert run(at) == ([], at)
    a.write_text("1\n2\ntorn\n3\n")
    b.write_text("z\n")
    got, at = run(at)
    assert got == ["3", "torn", "z"] and at == {str(a): 11, str(b): 2}


def test_a_stream_reads_what_files_grow_by(spark, tmp_path):
    root, at, f = tmp_path / "in", str(tmp_path / "at"), tmp_path / "in/a.jsonl"
    root.mkdir()

    def run():
        return sorted(r.value for r in streams.kept_rows(rg.stream(spark, str(root), range_bytes=5).select("value"), "lines", at).collect())

    f.write_text("1\n2\nto")
    assert run() == ["1", "2"]
    f.write_text("1\n2\ntorn\n")
    (root / "b.jsonl").write_text("new\n")
    assert run() == ["1", "2", "new", "torn"]
    # a shorter file begins again
    f.write_text("9\n")
    assert run() == ["1", "2", "9", "new", "torn"]
