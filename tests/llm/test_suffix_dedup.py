import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, source string, spans string, tk int"


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1))
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed=3, near=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["er", "tion", "é", "an", "ß", "th"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(300).split(" ")
    out = [prose(rng.randint(1, 200)) for _ in range(30)]
    out += [out[0], out[1], None, "", "x" * 199, "x" * 200, "y" * 700, "ab" * 400, prose(90) + "z" * 450]
    out += [f"{prose(20)} {passage} {prose(20)}" for _ in range(near)]
    for _ in range(near):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("limit,block", [(2000, 1 << 20), (5, 1 << 20), (2000, 4000), (5, 3000)])
def test_matches_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    rows = [(i, t, "s", None, 1) for i, t in enumerate(texts())]
    rows.append((None, rows[3][1], None, None, None))  # a null id, and a text found before
    rows.append((5, rows[5][1], None, None, None))  # a repeated row
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), limit).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want


def test_texts_beyond_the_piece_size(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    rows = [(i, t, "s", None, 1) for i, t in enumerate(texts(5, 12))]
    rows += [(900 + k, " ".join(t for _, t, *_ in rows[k : k + 12] if t), "s", None, 1) for k in range(0, 24, 6)]
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want


def test_one_passage_in_many_contexts_stays_about_one_row_a_snippet(spark, monkeypatch):
    tables = {}
    kept = sd.written

    def counted(df, name):
        out = kept(df, name)
        tables[name] = tables.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(sd, "written", counted)
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    rows = [(i, f"{prose(30)} {passage} {prose(30)}", "s", None, 1) for i in range(600)]
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), 20).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want
    assert tables["op3-compared"] < 2.5 * tables["op3-snips"]


def test_blocks_are_merged_by_binary_search(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 900)
    rng = np.random.default_rng(0)
    body = rng.integers(97, 110, 290).astype(np.uint8).tobytes()
    snips = [body[:k] + b"#" + body[k + 1 :] for k in (2, 280, 150, 5, 285)] + [body]
    rows = [(7, k, 1, 91, s) for k, s in enumerate(snips)]
    seen = Counter(s[i : i + 200] for s in snips for i in range(91))
    got = {k: {i for a, b in runs for i in range(a, b)} for _, k, runs in sd.shard_blocks(rows)}
    assert got == {k: {i for i in range(91) if seen[s[i : i + 200]] > 1} for k, s in enumerate(snips)}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 4, 500), np.ones(300, int), np.tile([1, 2], 150), np.array([5])):
        text = text.astype(np.uint16)
        sa, rank = sd.suffix_array(text)
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert sa.tolist() == want and rank[sa].tolist() == list(range(len(text)))
        lcp = sd.common_prefixes(text, sa, rank, np.array([0, len(text) // 2]) if len(text) > 1 else np.array([0]), 200)
        for r in range(1, len(text)):
            a, b = text[sa[r - 1] :].tolist(), text[sa[r] :].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[r] == min(same, 200)


def test_text_is_cut_and_other_columns_stay(spark):
    passage = "é" * 150
    rows = [(1, "a" + passage + "b", "s", "q", 3), (2, "c" + passage + "d", "s", "q", 3), (3, None, None, None, None)]
    got = {r.doc_id: r for r in sd.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "ab" and got[2].text == "cd" and got[3].text is None and got[2].spans == "q" and got[2].tk == 3


def test_column_names_with_dots_and_clashes(spark):
    rows = [(1, "a" + "é" * 150, 1, 2, 3, 4), (2, "c" + "é" * 150, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, rest int, `q``r` int, spans int")
    got = sd.deduplicated(docs)
    assert got.columns == docs.columns and [r[2:] for r in got.collect()] == [(1, 2, 3, 4)] * 2


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_identical_rows_take_linear_time(spark):
    text = texts()[-1] * 3
    other = "something else " * 5 + text[300:900]
    rows = [(i % 3 or None, text) for i in range(1_500)] + [(7, other), (8, None)]
    want = {t: w for t, w in zip((text, other, None), brute([text, text, other, None])[1:])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sd.repeated_spans(docs).selectExpr("max(size(spans)) AS most").first().most
    assert spans < 500
    got = sd.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    assert sorted((r.doc_id or 0, r["count"], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted([(0, 500, *want[text]), (1, 500, *want[text]), (2, 500, *want[text]), (7, 1, *want[other]), (8, 1, *want[None])])
