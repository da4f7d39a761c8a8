import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import packing, tokens

ENCODER = tokens.Encoder()
DIRECT = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
HARD = ["Straße Éa ΣΑΣ x", "İstanbul don't WE'LL it'S", "<|endoftext|> a<|startoftext|>", "a b\u0085c\x1cd", "é ́x ﬁ", "１２3 ²³ ªº", "😀👍🏽", "\0\t\r\n", "a" * 500, "漢字かな", "soft­hyphen ǅ ŉ"]


def same(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == DIRECT.encode(text, add_special_tokens=False).ids, repr(text)


def test_hard_texts_are_encoded_as_the_library_does():
    for t in HARD:
        same(t)
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n's"))))
def test_any_text(text):
    same(text)


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join("word" if x else "of" for x in rng.integers(0, 2, n)) for n in [*rng.integers(1, 900, 150), 0, 9000, 8191, 4095, 4096]]
    rows = [(k, t, "q") for k, t in enumerate([*texts, None, ""])] + [(3, texts[3], None), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.best_fit(docs, shard_pieces=60).collect()
    want = []
    for k, t, _ in rows:
        ids = np.array([*DIRECT.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((k, piece, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=key) == sorted(want, key=key)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    least = sum(g.length for g in got) / 4096
    assert len(by) <= least + len({g.sequence_id >> 32 for g in got}) * 2 + 1


def test_patterns_are_as_good_as_best_fit():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(513, 4096, 3000), rng.integers(1, 4097, 3000), np.full(900, 2049), np.full(900, 1365), np.array([4096, 1]), np.array([3000]), np.array([600, 900, 2500, 3000]), np.array([], int)):
        where, offset = packing.pack(lengths)
        load = np.bincount(where, lengths)
        assert load.max(initial=0) <= 4096 and (where >= 0).all()
        plain = packing.pack(lengths, groups=0)[0].max(initial=-1) + 1  # best fit decreasing alone
        assert where.max(initial=-1) + 1 <= 1.01 * plain + 2


def test_no_documents(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string")).collect() == []
