import random
import re
from collections import Counter

import pytest

from tracewright.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, id long, sig string, key string"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and None not in (rows[i][0], rows[j][0]) and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), None if d is None else least[find(i)], d is None or least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for size in (4, 8, 30, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(copies):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(size)] = word()
                out.append(" ".join(copy))
    rng.shuffle(out)
    out += [out[0].upper(), out[3], None, "", "  \n", "One two", "one\ttwo", "é É é É é", "é É é É é x"]
    return list(enumerate(out))


@pytest.mark.parametrize("seed,copies", [(1, 2), (2, 12)])
def test_matches_brute_force(spark, seed, copies):
    rows = corpus(seed, copies) + [(None, "nothing at all is linked here"), (None, None)]
    got = nd.link(spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)).drop("class_id").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_rows_that_share_an_id_join_their_links(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (5, a), (5, b), (3, b), (9, "alone in this small world of words")]
    got = nd.link(spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)).collect()
    assert {r.component_id for r in got if r.doc_id < 9} == {1}
    kept = nd.one_of_each(spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA))
    assert kept.columns == SCHEMA_COLUMNS and sorted(r.doc_id for r in kept.collect()) == [1, 9]


SCHEMA_COLUMNS = ["doc_id", "text", "id", "sig", "key"]


def test_column_names_with_dots_and_clashes(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 1, 2, 3), (None, text, 1, 2, 3)], "doc_id long, text string, gone int, `a.b` int, row int")
    got = nd.one_of_each(docs)
    assert got.columns == docs.columns and sorted((r[0] or 0, *r[2:]) for r in got.collect()) == [(0, 1, 2, 3), (1, 1, 2, 3)]


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["ab", "cde", "fg", "hij"]) + str(rng.randrange(999)) for _ in range(400_000))
    rows = [(1, long), (2, long + " and a little more"), (3, "short text of a few words only")]
    got = nd.link(spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)).drop("class_id").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    rows = []
    for k in range(3000):
        words = [f"p{k}w{j}" for j in range(200)]
        at = 20 + k % 150
        other = words[:at] + [f"q{k}w{j}" for j in range(24)] + words[at + 24 :]  # 168 of 224 shingles in both
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = nd.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sum(r.component_id != r.doc_id for r in got)
    assert all(r.component_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got) and linked >= 2999


def test_a_group_costs_a_few_comparisons_a_copy(spark):
    rows = corpus(4, 80)
    docs = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)
    got = nd.link(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_empty_table(spark):
    assert nd.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_large_bucket_is_compared_in_bounded_places(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    members = [(7, i, 0 if i < 300 else i) for i in range(400)] + [(8, 1, 1), (8, 2, 2)]
    got = nd.places(spark.createDataFrame(members, "key long, id long, component long")).collect()
    at = {}
    for r in got:
        at.setdefault((r.key, r.x, r.y), []).append(r)
    assert len(at) > 100 and max(map(len, at.values())) < 100
    met = Counter((r.key, v.id, r.id) for rows in at.values() for v in rows if v.visits for r in rows if r.lives)
    assert met == Counter({(7, v, i): 1 for v in range(300, 400) for i in range(400)} | {(8, 1, 1): 1, (8, 1, 2): 1})


def test_the_pairs_of_a_class_are_dealt_to_bounded_slots(spark, monkeypatch):
    monkeypatch.setattr(nd, "SLOT", 16)
    pairs = [(0, i) for i in range(1, 400)] + [(500, 501)]
    got = nd.slotted(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.a, r.b) for r in got) == pairs and max(Counter((r.a, r.slot) for r in got).values()) < 50


def test_small_places_and_slots_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "SLOT", 2)
    rows = corpus(2, 12)
    got = nd.link(spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)).drop("class_id").collect()
    assert Counter(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("hubs", [{9: [1, 2, 3]}, {1: [9], 2: [9], 3: [9]}])
def test_pairs_already_tried_do_not_take_the_place_of_the_closest(spark, hubs):
    sig, sketch = bytes(2 * nd.VALUES), bytes(nd.SKETCH)
    key = int(nd.index_key(nd.np.zeros((1, nd.CHUNKS, nd.WIDTH), "<u2"), 0, 0)[0])
    rows = [(key, i, 9 if i == 9 else 1, sketch, sig, hubs.get(i)) for i in (1, 2, 3, 4, 9)]
    got = nd.meetings(spark.createDataFrame(rows, "key long, id long, component long, sketch binary, sig binary, hubs array<long>"), nd.CLOSEST)
    assert [tuple(r) for r in got.collect()] == [(4, 9)]
