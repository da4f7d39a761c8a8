import random

import pyarrow as pa

from tracewright.llm.common import chunks, components, sampled


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(7, 7), (60, 3), (3, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chunks_hold_whole_texts():
    texts = ["a" * 10, None, "", "é" * 40, "b"]
    got = [(c.rows.tolist(), [c.data[x:y].tobytes().decode() for x, y in zip(c.at[:-1], c.at[1:])]) for c in chunks(pa.array(texts), 20)]
    assert [r for rs, _ in got for r in rs] == [0, 1, 2, 3, 4] and [t for _, ts in got for t in ts] == ["a" * 10, "", "", "é" * 40, "b"]
    assert list(chunks(pa.array([], pa.string()), 5)) == []


def test_a_sample_is_whole_where_keys_repeat_or_are_missing(spark):
    one = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "concat('text ', id) AS text")
    many = one.crossJoin(spark.range(40)).drop("id")
    for rows in (one, many):
        for most in (10, 400, 5000):
            got = sampled(rows, ["doc_id"], most, ["text"]).collect()
            assert len(got) == len(set(got)) == min(most, 3000)
            assert most < 400 or sum(r.doc_id is None for r in got) > len(got) / 5
    assert sorted(sampled(one, ["doc_id"], 400, ["text"]).collect(), key=str) == sorted(sampled(many, ["doc_id"], 400, ["text"]).collect(), key=str)
    assert sampled(one.limit(0), ["doc_id"], 5).collect() == []
