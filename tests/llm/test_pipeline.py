import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_suffix_dedup import brute as passages
from tracewright.llm import mixing, tokens
from tracewright.llm.common import documents, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF), []
    for name, stage in cp.STAGES:
        out.append(docs := written(stage(spark, docs, SF), f"test-{name}"))
    return out


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()))


def test_stages_give_back_the_columns_of_documents(spark, stages):
    want = documents(spark, SF).schema
    for s in stages[:-1]:
        assert [(f.name, f.dataType) for f in s.schema] == [(f.name, f.dataType) for f in want] and s.count() > 0


def test_near_duplicates_keep_one_of_each_group(stages):
    before = rows(stages[0])
    kept = {d for d, _, _, k in near_groups(before) if k}
    assert rows(stages[1]) == [r for r in before if r[0] in kept]


def test_repeated_passages_are_cut(stages):
    before, after = rows(stages[1]), dict(rows(stages[2]))
    for (d, t), (n, gone, _, _) in zip(before, passages([t for _, t in before])):
        assert 0 <= n - gone - len(after[d].encode()) <= 8  # characters of which a byte went
        assert gone or after[d] == t


def test_mixture_takes_what_the_operator_says(stages):
    want = {r.doc_id: r.taken for r in mixing.mix(stages[2]).collect() if r.taken}
    got = {}
    for d, t in rows(stages[3]):
        got[d] = got.get(d, 0) + len(t.split())
    assert got == want


def test_sequences_hold_all_pieces(stages):
    encoder, want = tokens.Encoder(), []
    for d, t in rows(stages[3]):
        ids = encoder.encode([t])[0] + np.array([1], "<u4").tobytes()
        want += [(d, p, zlib.crc32(ids[at : at + 16384])) for p, at in enumerate(range(0, len(ids), 16384))]
    got = stages[4].collect()
    assert sorted((g.doc_id, g.piece, g.ids_crc32) for g in got) == sorted(want)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(stages[4])
