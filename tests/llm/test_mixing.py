import numpy as np

from tracewright.llm import mixing

SCHEMA = "doc_id long, text string, source string, number string, given int"


def rows():
    rng = np.random.default_rng(5)
    out = []
    for source, n in (("a", 300), ("b", 60), ("é", 40), ("Z", 10), (None, 30)):
        for _ in range(n):
            k = len(out)
            out.append((k, " ".join(f"w{k}_{i}" for i in range(int(rng.integers(1, 150)))), source, None, k))
    out += [(1000, None, "a", None, 1), (1001, "", "c", None, 1), (1002, " \n\t", None, None, 1), (1003, "x " * 5000, "b", None, 1), (7, out[7][1], "a", None, 7), (None, "no id", "a", None, 0)]
    return out


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 100]) == [200.0, 450 * 0 + (450 - 200) * 1 / 3, (450 - 200) * 2 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    got = mixing.targets([10, 5, 1000, 3])
    assert all(g <= 2 * s for g, s in zip(got, [10, 5, 1000, 3])) and abs(sum(got) - 1.5 * 1018) < 1e-6


def test_permutation_and_draws():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        got = mixing.permuted(np.arange(n), n, 4)
        assert sorted(got.tolist()) == list(range(n)) and got[::3].tolist() == mixing.permuted(np.arange(0, n, 3), n, 4).tolist()
    steps = np.diff(mixing.permuted(np.arange(4097), 4097, 4))
    assert len(set(steps.tolist())) > 2000
    for slots, shards in ((50, 10), (3, 10), (0, 4), (7, 1), (100_000, 40)):
        at, n = mixing.draw(slots, shards, [1, 2])
        assert n.sum() == slots and (n > 0).all() and len(set(at.tolist())) == len(at) and all(0 <= x < shards for x in at)
    assert abs(n - 2500).max() < 300


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    again = mixing.mix(docs.repartition(7)).collect()
    strip = lambda rs: sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rs if r.doc_id is not None), key=str)
    assert strip(got) == strip(again)
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, size(t)) for i, t, *_ in rows() if i is not None)
    of = {}
    for i, t, s, *_ in rows():
        of[s] = of.get(s, 0) + size(t)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([of[s] for s in names])))
    source = {i: s for i, _, s, *_ in rows()}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == of[s] and abs(r.target - goal[s]) < 1e-9 and 0 <= r.taken <= 2 * r.size
        assert sum(g.words for g in r.given) == r.taken
        taken[s] = taken.get(s, 0) + r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2 * 64, (s, taken[s], goal[s])
    assert sorted(got, key=key) is not None


def test_slots_and_spans_meet_by_index(spark):
    m = mixing.Mix(spark.createDataFrame(rows(), SCHEMA))
    slots, spans = m.slots().collect(), m.spans().where("words > 0").collect()
    assert len({(s.number, s.block, s.epoch) for s in slots}) == len(slots)
    fill = {}
    for s in spans:
        fill[s.number, s.block] = fill.get((s.number, s.block), 0) + s.words
    for number in {n for n, _ in fill}:
        blocks = sorted(b for n, b in fill if n == number)
        assert blocks == list(range(len(blocks))) and all(fill[number, b] == 64 for b in blocks[:-1])


def test_slots_are_not_broadcast(spark):
    plan = mixing.Mix(spark.createDataFrame(rows(), SCHEMA)).taken()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [number" in plan


def test_mixed_documents_have_the_words_taken(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] < 1000], SCHEMA).dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got, texts = {}, {r.doc_id: r.text for r in docs.collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert got == want


def test_column_names_with_dots_and_clashes(spark):
    docs = spark.createDataFrame([(k, f"some words of number {k} " * 20, "s", 1, 2, 3) for k in range(30)], "doc_id long, text string, source string, `a.b` int, rest int, mix_id int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {r[3:] for r in got.collect()} == {(1, 2, 3)}


def test_no_documents(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
