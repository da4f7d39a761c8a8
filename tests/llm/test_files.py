import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracewright.llm import token_store, tokens, warc


def test_token_store_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), " ".join(rng.choice(["alpha", "Beta,", "é", "ß!"], int(rng.integers(0, 80)))), "x") for k in rng.permutation(400)]
    rows += [(500, None, "x"), (501, "", None), (3, "again", "x"), (None, "no id", "x"), (502, "long " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    uri, manifest = token_store.write(docs)
    direct = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    got = token_store.read(spark, uri).collect()
    assert len(got) == len(rows) == sum(m["documents"] for m in manifest)
    want = {}
    for i, t, _ in rows:
        ids = np.array([*direct.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert (g.n_tokens, g.ids_crc32) in want[g.doc_id] and g.start == at
        at += g.n_tokens
    order = [-1 if g.doc_id is None else g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert order == sorted(order)
    fs, root = token_store.file_system(uri)
    words = next(x for x in fs.get_file_info(token_store.pafs.FileSelector(root)) if "dictionary" in x.path)
    with fs.open_input_stream(words.path) as f:
        words = f.read()
    with fs.open_input_file(f"{root}/{manifest[0]['name']}") as f:
        reader = token_store.FileReader(f, words)
        assert np.frombuffer(reader.document(reader.n - 1), "<u4")[-1] == 2
        assert [reader.document(k) for k in range(reader.n)] == list(reader.documents())
    assert not [x.path for x in fs.get_file_info(token_store.pafs.FileSelector(root)) if x.path.endswith(".tmp")]


def test_token_store_without_documents(spark):
    uri, manifest = token_store.write(spark.createDataFrame([], "doc_id long, text string"))
    assert manifest == [] and token_store.read(spark, uri).collect() == []


PAGES = [(k, f"http://h/{k}?q=é x", f"<p>{k % 7}é</p>" if k % 3 else f"<b>{k}</b>") for k in range(60)] + [(100, None, None), (101, "a\r\nX: y", ""), (102, "u", "z" * 300_000), (5, "again", "<p>5é</p>"), (None, "n", "<b>0</b>"), (None, "m", "only")]


def test_warc_round_trip_and_rerun(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    uri, manifest = warc.write(pages, shard_bytes=16000, file_bytes=600)
    again = warc.write(pages.repartition(5), shard_bytes=16000, file_bytes=600)[1]
    assert manifest == again and len(manifest) > 3
    last = {}
    for i, _, h in PAGES:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        to = last.get(h or "")
        to = None if to is None or to == i else to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    assert sorted(map(tuple, warc.read(spark, uri).collect()), key=str) == sorted(want, key=str)


def test_warc_shards_are_cut_by_bytes_also_within_one_page_id():
    ids, k = np.array([1, 5, 5, 5, 9]), np.array([0, -7, 0, 4, 2])
    page, h = np.array([0, 1, 4, 5, 5, 5, 5, 9, 9, 10, 1]), np.array([3, 0, 9, -8, -7, 3, 4, 1, 2, 0, -1])
    want = [sum((a, b) <= (p, x) for a, b in zip(ids, k)) for p, x in zip(page, h)]
    assert warc.shard_number(page, h, ids, k).tolist() == want


def test_warc_deals_a_hot_page_id_over_shards(spark):
    pages = spark.createDataFrame([(None if k % 2 else k, "u", f"page {k} " * 20) for k in range(200)], "page_id long, url string, html string")
    uri, manifest = warc.write(pages, shard_bytes=10_000)
    assert len(manifest) > 10 and max(m["records"] for m in manifest) < 40
    assert warc.read(spark, uri).count() == 200


def test_warc_without_pages(spark):
    uri, manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest == [] and warc.read(spark, uri).collect() == []


def test_token_store_deals_a_hot_doc_id_over_tasks(spark):
    docs = spark.createDataFrame([(None if k % 2 else 5, f"text {k} " * 30) for k in range(400)], "doc_id long, text string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        uri, manifest = token_store.write(docs)
    finally:
        spark.conf.unset(coalesce)
    assert max(m["documents"] for m in manifest) < 200
    ids = [r.doc_id for r in sorted(token_store.read(spark, uri).collect(), key=lambda r: r.start)]
    assert ids == [None] * 200 + [5] * 200
