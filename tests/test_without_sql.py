"""The queries that SQL doesn't express, over their whole tables against brute force. ``test_oracle`` asks for a test here of each."""

import duckdb
import pyarrow.parquet as pq
import regex

from tests.test_operators import brute_clusters
from tracewright.operators import text as x
from tracewright.plans import knowledge_queries, registry

SF = "/root/testdata/sf0.001"


def plain_redaction(text):
    """The text and its counts, a pattern at a time."""
    counts = dict.fromkeys(x.KINDS, 0)
    if text is None:
        return None, dict.fromkeys(x.KINDS)
    text = regex.sub(f"[{x.OPEN}{x.CLOSE}]", "", text).replace("[REDACTED:", "[REDACTED\\:")
    for kind, pattern in x.PATTERNS:
        text, n = regex.subn(pattern, lambda m: f"{m[1]}{x.OPEN}{kind}{x.CLOSE}{m[3] or ''}", text)
        counts[kind] += n
    return regex.sub(f"{x.OPEN}([a-z-]+){x.CLOSE}", r"[REDACTED:\1]", text), counts


def plain_documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: plain_redaction(r["text"]) for r in t}


def test_l1_redact(spark):
    got = {r.doc_id: r for r in registry.queries()["l1_redact"](spark, SF).collect()}
    want = plain_documents()
    assert got.keys() == want.keys()
    for doc_id, (text, counts) in want.items():
        assert got[doc_id].text == text
        assert {k: got[doc_id]["n_" + k.replace("-", "_")] for k in x.KINDS} == counts


def test_l2_redaction_counts(spark):
    got = registry.queries()["l2_redaction_counts"](spark, SF).first().asDict()
    want = {"n_" + k.replace("-", "_"): sum(c[k] or 0 for _, c in plain_documents().values()) for k in x.KINDS}
    assert got == want


def test_k8_clusters(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    edges = {(a, b): s for a, b, s in con.execute(f"{knowledge_queries.PAIRS} SELECT a, b, score FROM pairs").fetchall()}
    nodes = {v for (v,) in con.execute("SELECT DISTINCT item_id // 2 FROM benchmark").fetchall()}
    rows = registry.queries()["k8_clusters"](spark, SF).collect()
    groups = {}
    for r in rows:
        if not r.shed:
            groups.setdefault(r.cluster, []).append(r.node)
    want, shed = brute_clusters(nodes, edges, knowledge_queries.LEAST)
    assert sorted(sorted(g) for g in groups.values()) == want
    assert sorted(r.node for r in rows if r.shed) == shed
    assert edges
