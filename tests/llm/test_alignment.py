import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tracewright.llm import alignment as al
from tracewright.llm.tokens import byte_characters

A = Tokenizer.from_file(public_tokenizers.path(al.A_VOCABULARY))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(al.B_VOCABULARY))


def spans(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + sizes(i), i))
        at += sizes(i)
    return out


def brute(rows):
    """Whole texts by the libraries, token by token."""
    byte_of = {c: k for k, c in enumerate(byte_characters())}
    a_bytes = lambda i: bytes(byte_of[c] for c in A.id_to_token(i))
    b_bytes = lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            data = (" " + text).encode()
            a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
            if b"".join(map(a_bytes, a)) != data or b"".join(map(b_bytes, b)) != data:
                a, b = [], []
            sa, sb = spans(a, lambda i: len(a_bytes(i))), spans(b, lambda i: len(b_bytes(i)))
            ends = sorted({y for _, y, _ in sa} & {y for _, y, _ in sb})
            low = 0
            for end in ends:
                groups.append(",".join(str(i) for x, y, i in sa if low <= x < end) + "|" + ",".join(str(i) for x, y, i in sb if low <= x < end))
                low = end
            links = [(i, j) for x, y, i in sa for u, v, j in sb if x < v and u < y]
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(((i, len(a), len(b), len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in docs), key=str)


def texts():
    rng = random.Random(8)
    words = ["the", "alignment", "of", "Straße", "naïve", "日本語", "x1y2", "don't", "🙂", "½", "ﬁne", "<|endoftext|>", "</s>", "<0x41>", "\x1c", "a b", "\t", "é", "unbelievably", "12345"]
    out = []
    for k in range(60):
        seps = [" "] * 8 + ["\n"] * 2 + (["  ", "\n\n", " \n", "\n ", "\t", "   ", "　"] if k % 2 else [])
        out.append("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(1, 40))).rstrip() + rng.choice(["", "", " ", "\n"]))
    return out


ROWS = [(k, t) for k, t in enumerate(texts())] + [(100, None), (101, ""), (102, "a▁b one"), (103, " "), (104, "  two"), (105, "\n"), (3, "again again again"), (3, "again again again"), (None, "no id"), (106, "y" * 700), (107, "\r\nx\r\n y")]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in ROWS], "doc_id long, text string, code string, n int").repartition(5)
    got = al.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_pieces_salts_and_full_caches_change_nothing(spark, monkeypatch):
    want = brute(ROWS)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    first, looked, pieced = al.aligned, al.looked_up, {}

    def small(batches, *args):
        al.CHARS, al.CACHED = 40, 5
        al.Counts.__init__.__defaults__ = (3,)
        return first(batches, *args)

    monkeypatch.setattr(al, "aligned", small)
    monkeypatch.setattr(al, "BUCKET_BYTES", 20)
    monkeypatch.setattr(al, "looked_up", looked)
    assert sorted((tuple(r) for r in al.align(docs).collect()), key=str) == want and not pieced


def test_long_text_in_pieces():
    known = al.Aligner()
    text = "some words, again\nand again " * 90_000
    assert len(text) > 2 * al.CHARS and known.cuts
    parts = list(known.read(text))
    assert len(parts) == 3
    numbers = sum(p[0] for p in parts)
    assert numbers[0] == len(A.encode(" " + text, add_special_tokens=False).ids) and numbers[1] == len(B.encode(text))
    assert list(known.read(text + "▁")) == []


def test_nothing(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in al.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
