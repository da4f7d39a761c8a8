from collections import Counter

import numpy as np
import pytest

from tracewright.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, rid int, component int"


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if k else None for (_, v), k in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, n[i], least.get(find(i)), d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block,leaf", [(4096, 256), (50, 16)])
def test_matches_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(ed, "LEAF", leaf)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    v = [base[k % 60] + rng.normal(size=12) * 0.14 for k in range(300)]
    v += [base[0] + rng.normal(size=12) * 0.01 for _ in range(80)] + [base[1] * s for s in (1, 3, 1e-3)]
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v)]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, []), (906, [1.0, 0.0]), (907, [2.0, 0.1]), (3, v[5].tolist()), (None, v[0].tolist())]
    got = ed.link(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA), block=block).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_nothing_to_link(spark):
    assert ed.link(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in ed.link(spark.createDataFrame([(1, None, 1, 1, 1)], SCHEMA)).collect()] == [(1, 0, 1, True)]
