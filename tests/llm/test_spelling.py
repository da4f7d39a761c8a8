import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import spelling as sp


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, shortest=7, least=2, factor=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if near(v, w))
        form = others[0][1] if others and -others[0][0] >= factor * n else None
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w, row in out.items():
        last = w
        while out[last][0]:
            last = out[last][0]
        row[1] = last
    return {w: tuple(r) for w, r in out.items()}


def texts(seed=5, n=300):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß÷") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaab", "ÀBCDEFG", "àbcdefg"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (1 + 400 // (k + 1))
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéß")
            words += [rng.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]])] * rng.randrange(1, 5)
    words += ["chainaaa"] * 3 + ["chainaab"] * 60 + ["chainabb"] * 900
    rng.shuffle(words)
    return [(k, " ".join(words[k::n]).upper() if k % 7 == 0 else "-".join(words[k::n])) for k in range(n)]


@pytest.mark.parametrize("filter_bytes", [sp.FILTER_BYTES, 128])
def test_matches_brute_force(spark, filter_bytes):
    rows = texts() + [(None, "missing missing missin"), (None, None), (900, ""), (901, "missing 1 missing, short x"), (901, "missing 1 missing, short x"), (5, "z" * 300 + " " + "z" * 299 + " " + "z" * 300 + "\n" + "z" * 299), (902, "日本語missing日本語ŁmissingŁ")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.variants(docs, filter_bytes=filter_bytes).collect()}
    want = brute(rows)
    assert got == want
    assert sum(r[0] is not None for r in want.values()) > 20 and any(r[1] != (r[0] or w) for w, r in want.items())


def test_nothing_to_compare(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sp.variants(spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")).collect() == []
    got = sp.variants(spark.createDataFrame([(1, "loneword loneword")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [("loneword", None, "loneword", 2, 0, None)]


def test_edits_have_the_hashes_of_their_words():
    rng = np.random.default_rng(1)
    alphabet = np.frombuffer(b"abcd\xe9", np.uint8)
    letters = alphabet[rng.integers(0, 5, (20, 8))]
    made = Counter()
    for kind, rows, places, letter, h in sp.edits(letters, alphabet):
        for r, p, x in zip(rows, places, h):
            w = letters[r].tobytes()
            v = w[:p] + w[p + 1 :] if kind == "deleted" else w[:p] + bytes([letter]) + w[p + 1 :]
            assert sp.mixed(sp.hashes(np.frombuffer(v, np.uint8)[None])) == x
            made[r, v] += 1
    assert set(made.values()) == {1}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "alphabet betaword " * 50
    want = [dict(zip(*(c.to_pylist() for c in b.columns))) for b in sp.counted([pa.record_batch([["1"], [text]], names=["key", "text"])], 7)]
    monkeypatch.setattr(sp, "PIECE", 13)
    monkeypatch.setattr(sp, "COUNTED", 1)
    got = Counter()
    for b in sp.counted([pa.record_batch([["1"], [text]], names=["key", "text"])], 7):
        got.update(dict(zip(*(c.to_pylist() for c in b.columns))))
    assert got == want[0] and sum(got.values()) in (100, 50, 0)


def test_filters_are_parted_by_size():
    plan, passes = sp.planned({7: 1000, 8: 10, 64: 1}, 1024)
    assert plan[8] == (1, 1) and plan[7][0] == 2 and sorted(x for p in passes for x in p) == [(7, 0), (7, 1), (8, 0), (64, 0)]
    assert all(sum(plan[s][1] for s, _ in p) * 64 <= 1024 for p in passes)
