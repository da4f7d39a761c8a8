import numpy as np

from tracewright.llm import quality_model as qm
from tracewright.llm.common import documents

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in qm.predict(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    s, y = np.array(held).T
    assert auc(s, y) > 0.8 and np.mean((s >= 0.3) == y) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_additive_model_learns_tables_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = qm.learn(x[:3000], y[:3000])
    assert (0, 1) == m.pairs[0] and np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    y = (x[:, 2] > 0.3).astype(float)
    assert np.mean((qm.learn(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_odd_rows(spark):
    schema = "doc_id long, text string, y int, x int, score int"
    rows = [(1, None, 1, 1, 1), (1, "", 1, 1, 1), (None, "words here", 1, 1, 1), (2, "é" * 100_000, 1, 1, 1), (3, " \n\n", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qm.predict(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in qm.predict(docs, labels).collect())
    kept = qm.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    empty = spark.createDataFrame([], schema)
    assert qm.predict(empty, none).collect() == [] and qm.accepted(empty, none).collect() == []


def test_column_names_with_dots_and_clashes(spark):
    rows = [(k, "plain words in a line " * 8 if k % 2 else "# $ | % & <> " * 8, 1, 2, 3) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, rest int, y int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = qm.accepted(docs, labels)
    assert got.columns == docs.columns and {r[2:] for r in got.collect()} == {(1, 2, 3)}


def test_repeated_documents_and_labels_teach_as_plain_ones(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    twice = lambda df: df.crossJoin(spark.range(5)).drop("id")
    score = lambda a, b: {r.doc_id: r.score for r in qm.scored(docs, qm.fit(a, b)).collect()}
    assert score(docs, labels) == score(twice(docs), twice(labels))
