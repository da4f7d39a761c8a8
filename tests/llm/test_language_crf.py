from itertools import product

import numpy as np
import pytest

from tracewright.llm import language_crf as crf
from tracewright.llm.common import documents

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment", [128, 2])
def test_chain_is_exact(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    sizes, labels = np.array([5, 0, 1, 7, 2]), 3
    e, tie = rng.random((15, labels)) + 0.01, rng.random((labels, labels)) + 0.01
    gamma, moves = crf.chain(e, sizes, tie)
    want, want_moves, at = np.zeros_like(gamma), np.zeros((labels, labels)), 0
    for n in sizes:
        if not n:
            continue
        total, g, mv = 0.0, np.zeros((n, labels)), np.zeros((labels, labels))
        for path in product(range(labels), repeat=n + 1):
            p = 1 / labels * np.prod([tie[path[k], path[k + 1]] * e[at + k, path[k + 1]] for k in range(n)])
            total += p
            for k in range(n):
                g[k, path[k + 1]] += p
                mv[path[k], path[k + 1]] += p
        want[at : at + n], want_moves, at = g / total, want_moves + mv / total, at + n
    assert np.allclose(gamma, want) and np.allclose(moves, want_moves)


def test_features_are_the_word_s_own():
    grams, start, lexicon, letters = crf.word_features([b"ab", b"12", b"ab", b"c"])
    size = np.diff(np.append(start, grams.shape[1]))
    of = [grams[:, s : s + n] for s, n in zip(start, size)]
    assert (of[0] == of[2]).all() and lexicon[0] == lexicon[2] != lexicon[1] and letters.tolist() == [True, False, True, True]


def test_held_out_accuracy(spark):
    docs = documents(spark, SF)
    got = {r.doc_id: r for r in crf.labelled(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert np.mean([lang == g.lang_pred for lang, g in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_code_switched_text_is_labelled_word_by_word():
    rng = np.random.default_rng(1)
    word = {"x": lambda: "".join(rng.choice(list("abcd"), 5)), "y": lambda: "".join(rng.choice(list("wxyz"), 5))}
    m = crf.learn([(" ".join(word[k]() for _ in range(50)), k) for _ in range(100) for k in "xy"])
    text = " ".join([word["x"]() for _ in range(10)] + [word["y"]() for _ in range(10)])
    assert [k for _, k in m.words(text)] == ["x"] * 10 + ["y"] * 10
    assert m.tie[0, 0] > m.tie[0, 1]


def test_a_long_text_in_pieces_is_as_in_one(monkeypatch):
    rng = np.random.default_rng(3)
    word = {"x": lambda: "".join(rng.choice(list("abcde"), 4)), "y": lambda: "".join(rng.choice(list("defgh"), 4))}
    m = crf.learn([(" ".join(word[k]() for _ in range(50)), k) for _ in range(60) for k in "xy"])
    text = "\n".join(" ".join(word[k]() for _ in range(40)) for k in "xyxxyx") + "  12 "
    split = [text.lower().encode().split()]
    whole = m.sums(split)[0]
    for size in (30, 200, 400):
        monkeypatch.setattr(crf, "PIECE_CHARS", size)
        assert np.allclose(m.long_sums(text), whole)
    monkeypatch.setattr(crf, "PIECE_CHARS", 100)
    assert m.texts([text, None, "w" * 950, " " * 500]) == (["x", "und", m.texts(["w" * 950])[0][0], "und"], [m.texts([text])[1][0], 0.0, m.texts(["w" * 950])[1][0], 0.0])


def test_a_very_long_text_takes_bounded_memory():
    import resource

    m = crf.learn([("abc abd " * 30, "x"), ("xyz xyy " * 30, "y")] * 20)
    m.texts(["abc " * 300_000])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert m.texts(["abc abd " * 2_500_000])[0] == ["x"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB; 78 bytes a byte would be 1.5 GB


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(k, "der die das und nicht " * 9, "de", 1) for k in range(9)] + [(k, "the of and that with " * 9, "en", 1) for k in range(20, 29)]
    odd = [(50, None, "de", 1), (51, "", None, 1), (52, "123 !!", "en", 1), (None, "the of and", None, 1), (20, "the the", None, 1), (53, "die " * 40_000, None, 1)]
    got = crf.labelled(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3 and by[53].lang_pred == "de" and by[None].lang_pred == "en"
    assert crf.labelled(spark.createDataFrame([], schema)).collect() == []
    assert {r.lang_pred for r in crf.labelled(spark.createDataFrame(odd[:2], schema)).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    docs = documents(spark, SF).select("doc_id", "text", "lang").limit(60)
    odd = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(["²", "½ Ⅷ", "①②", "١٢", "_ — 🙂"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in crf.labelled(docs.union(odd)).collect()}
    assert {got[10**6 + k] for k in range(5)} == {"und"}


def test_a_table_that_repeats_teaches_as_much(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    many = docs.crossJoin(spark.range(50)).drop("id")
    plain, repeated = crf.fit(docs), crf.fit(many)
    assert plain.languages == repeated.languages and np.array_equal(plain.grams, repeated.grams)
