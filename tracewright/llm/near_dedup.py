"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds the 64-bit hashes of its five-word shingles. Equal sets are one class, which one
document stands for. The signature of a class has CHUNKS * WIDTH values of 16 bits, the low bits of as
many least hashes. By pigeonhole two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 values
have a chunk that differs in at most ERRORS of its values, so each chunk is entered in the index once
for each way to leave ERRORS values out: all pairs under that distance meet in a bucket. At the linked
similarity of 0.75 and above fewer than one pair in 10**5 differs so much that no bucket is shared.

In a bucket each class is first compared with one class of the bucket only, the one that comes first in
an order that differs between thirds of the chunks. Links are confirmed on full sets. Then each class outside a
bucket's largest component is compared with the few members of other components that its signature is
closest to, and last, what a bucket still has in two or more components is compared across components,
whole. A pair's sets are fetched only if SKETCH further values of eight bits agree well enough. So no
link between different texts that a bucket holds is lost, and a group of copies costs a few comparisons
a copy. Components are connected after each step. However large a bucket is, it is compared in places of
about BLOCK by BLOCK members, and the pairs of one class are confirmed about SLOT at a time.

Null or wordless texts have no shingle and are linked with nothing, as are rows without doc_id. Rows
that share a doc_id are one document with several texts: their links join. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import chunks, components, quoted, written

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 10, 4, 1
VALUES = CHUNKS * WIDTH
PERCENT = 75
#: Values of eight bits by which pairs are sifted, and how many must agree: at 0.75 fewer than one pair in 10**5 agrees so little.
SKETCH, LEAST_AGREED = 512, 343
CHUNK_BYTES = 2 << 20
#: Orders by which a bucket's first class is found; with few of them the classes of a group mostly meet the same ones.
ORDERS = 3
#: Closest members that a class is compared with before all are.
CLOSEST = 3
#: Members of a bucket that are residents, or visitors, of one place, and pairs of a class that are confirmed in one: about so many.
BLOCK, SLOT = 1024, 1024

_rng = np.random.default_rng(75)
TABLE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
MUL_A = _rng.integers(0, 1 << 31, SKETCH, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
MUL_B = _rng.integers(0, 1 << 31, SKETCH, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = int(base)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of the documents of a chunk."""

    def __init__(self):
        self.up, self.down = np.ones(0, np.uint64), np.ones(0, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; no word crosses a document as the caller puts a space between."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(BASE, 2 * n + 1), _powers(BASE_INVERSE, 2 * n + 1)
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[LOWER[data]] * self.up[:n], out=sums[1:])
        return start, mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD[0])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b" ".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        start, h = self.words(np.frombuffer(joined, np.uint8))
        cut = np.searchsorted(start, at)
        out = []
        if len(h) >= SHINGLE:
            n = len(h) - SHINGLE + 1
            s = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                s += h[k : k + n] * ODD[k]
            s = mixed(s)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(s[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mixed((short + h[k : k + 1]) * ODD[1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """The index values (16 bits of the first VALUES hashes) and the sketch (8 bits of all SKETCH)."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        x = low[at : at + 512, None] * MUL_A
        x += high[at : at + 512, None] * MUL_B
        least = np.minimum(least, x.min(0))
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least[:VALUES] >> np.uint32(16)).astype("<u2").tobytes(), (least >> np.uint32(12)).astype("u1").tobytes()


def batches_of_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    shingler = Shingler()
    for c in chunks(column, CHUNK_BYTES):
        raw = c.data.tobytes()
        yield c.rows, shingler.sets([raw[a:b] for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist())])


SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, sketch binary"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, sets in batches_of_sets(b.column("text")):
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            sig = [signature(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *(pa.array([x[k] for x in sig], pa.binary()) for k in (0, 1))], names=["doc_id", "n_shingles", "s1", "s2", "sig", "sketch"])


WILD = [tuple(k for k in range(WIDTH) if k not in out) for out in combinations(range(WIDTH), ERRORS)]


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, chunk) of each class: a key for each chunk and each choice of values left out."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH)
        for c in range(CHUNKS):
            for w in range(len(WILD)):
                yield pa.RecordBatch.from_arrays([pa.array(index_key(sig, c, w)), b.column("id"), pa.array(np.full(len(sig), c, np.int32))], names=["key", "id", "chunk"])


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, sets in batches_of_sets(b.column("text")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, slot, b, shingles) sorted by a and slot with a's own set first (b null): the pairs whose sets are similar enough."""
    now, sets = None, []
    for batch in batches:
        out = []
        for a, slot, b, shingles in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (a, slot) != now:
                now, sets = (a, slot), []
            got = np.frombuffer(shingles, np.uint64)
            if b is None:
                sets.append(got)
            elif any(100 * (n := len(np.intersect1d(x, got, assume_unique=True))) >= PERCENT * (len(x) + len(got) - n) and n for x in sets):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def slotted(pairs: DataFrame) -> DataFrame:
    """(a, b, slot): the pairs of an a with more than SLOT of them dealt by b to slots of about SLOT pairs."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SLOT).select("a", F.ceil(F.col("n") / SLOT).alias("slots"))
    return pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("slots", F.lit(1).cast("long"))).alias("slot"))


def sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the documents with the ids ``wanted``, whose texts move once for all confirmations.

    Tables of texts, sets and sketches are joined by a merge at every size of the other side, so that the plan does not
    change as the corpus grows.
    """
    texts = docs.join(wanted.select(F.col("id").alias("want")).distinct().hint("merge"), F.col("doc_id") == F.col("want"), "left_semi")
    return written(texts.mapInArrow(shingle_sets, "id long, shingles binary"), "op10-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` (distinct a, b) whose full sets have a similarity of PERCENT or more. A pair moves one set, the other meets the pairs of a slot at once."""
    dealt = slotted(pairs)
    own = dealt.select("a", "slot").distinct().select(F.col("a").alias("id"), "a", "slot", F.lit(None).cast("long").alias("b"))
    asked = own.union(dealt.select(F.col("b").alias("id"), "a", "slot", "b"))
    both = asked.hint("merge").join(sets, "id").select("a", "slot", "b", "shingles").repartition("a", "slot").sortWithinPartitions("a", "slot", F.asc_nulls_first("b"))
    return written(both.mapInArrow(confirm, "a long, b long").distinct(), name)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sketch, other) the pairs whose sketches agree well enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
            some = pa.array(np.flatnonzero((x == y).sum(1) >= LEAST_AGREED))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(some) for k in (0, 1)], names=["a", "b"])


def index_key(sig: np.ndarray, chunk: int, wild: int) -> np.ndarray:
    """The index key of signatures (rows of CHUNKS x WIDTH values) for one chunk and one choice of values left out."""
    key = np.full(len(sig), chunk * len(WILD) + wild + 1, np.uint64)
    for k in WILD[wild]:
        key = key << np.uint64(16) | sig[:, chunk, k].astype(np.uint64)
    return mixed(key).view(np.int64)


def first_key(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of the keys that a signature shares with each of others, the first: the bucket that a pair is told by."""
    same = others == one
    met = np.stack([same[:, :, list(keep)].all(2) for keep in WILD], 2).reshape(len(others), -1)
    keys = np.array([index_key(one[None], c, w)[0] for c in range(CHUNKS) for w in range(len(WILD))])
    return keys[met.argmax(1)]


def places(rows: DataFrame) -> DataFrame:
    """Members (key, id, component, ...) of buckets dealt to places (key, x, y): with main (in the bucket's largest component), lives and visits.

    A bucket has a place for each block x of its members and each block y of its visitors, those outside its largest
    component. A member lives in all places of its x, a visitor visits all places of its y: at exactly one place it meets
    each member, and no place has more than about BLOCK of either.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("largest"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1).cast("long"))
    sizes = sizes.select("key", F.col("largest.component").alias("largest"), blocks(F.col("members")).alias("xs"), blocks(F.col("members") - F.col("largest.n")).alias("ys"))
    got = rows.join(sizes, "key").withColumn("main", F.col("component") == F.col("largest"))
    got = got.withColumn("own_x", F.pmod(F.xxhash64("id"), F.col("xs"))).withColumn("own_y", F.pmod(F.xxhash64("id"), F.col("ys")))
    place = lambda x, y, lives, visits: F.struct(x.alias("x"), y.alias("y"), lives.alias("lives"), visits.alias("visits"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    home = F.transform(upto(F.col("ys")), lambda y: place(F.col("own_x"), y, F.lit(True), ~F.col("main") & (y == F.col("own_y"))))
    away = F.transform(F.filter(upto(F.col("xs")), lambda x: ~F.col("main") & (x != F.col("own_x"))), lambda x: place(x, F.col("own_y"), F.lit(False), F.lit(True)))
    return got.withColumn("at", F.explode(F.concat(home, away))).select("key", "at.x", "at.y", *(c for c in rows.columns if c != "key"), "main", "at.lives", "at.visits")


PLACED = ["key", "x", "y", "id", "component", "sketch", "sig", "hubs", "main", "lives", "visits"]


def across(closest: int | None):
    """For rows (PLACED) sorted by key, x, y: pairs (key, id, a, b, agreed) of a visitor (id) and a resident of a place in different components whose sketches agree well enough.

    A pair is told by the first of the keys that it shares. Pairs of a class and one of its hubs were compared before.
    closest: only so many for each visitor, those that agree best.
    """

    def pairs(key, ids, comps, sketches, sigs, hubs, main, lives, visits):
        ids, comps, main, lives, visits = (np.array(x) for x in (ids, comps, main, lives, visits))
        sig = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, CHUNKS, WIDTH)
        sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)
        tried = defaultdict(list)
        for k, known in enumerate(hubs):
            for hub in known or ():
                tried[hub].append(k)
        for k in np.flatnonzero(visits):
            # those of the largest component, and of the others that come later (all of them where only the closest count)
            other = np.flatnonzero(lives & (comps != comps[k]) & (main | (ids > ids[k]) | (closest is not None)))
            agreed = np.concatenate([np.zeros(0, int), *((sketch[other[i : i + 8192]] == sketch[k]).sum(1) for i in range(0, len(other), 8192))])
            other, agreed = other[agreed >= LEAST_AGREED], agreed[agreed >= LEAST_AGREED]
            if len(other):
                mine = (first_key(sig[k], sig[other]) == key) & ~np.isin(other, tried.get(int(ids[k]), [])) & ~np.isin(ids[other], hubs[k] or [])
                other, agreed = other[mine], agreed[mine]
            if closest is not None and len(other) > closest:
                some = np.lexsort((ids[other], -agreed))[:closest]
                other, agreed = other[some], agreed[some]
            if len(other):
                yield np.full(len(other), key), np.full(len(other), ids[k]), np.minimum(ids[k], ids[other]), np.maximum(ids[k], ids[other]), agreed

    def given(place, group):
        got = list(pairs(place[0], *group)) if any(group[-1]) else []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got]), pa.int64()) for k in range(5)], names=["key", "id", "a", "b", "agreed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group = None, None
        for batch in batches:
            for key, x, y, *row in zip(*(batch.column(c).to_pylist() for c in PLACED)):
                if (key, x, y) != place:
                    if group:
                        yield from given(place, group)
                    place, group = (key, x, y), tuple([] for _ in row)
                for g, v in zip(group, row):
                    g.append(v)
        if group:
            yield from given(place, group)

    return run


def meetings(rows: DataFrame, closest: int | None) -> DataFrame:
    """Pairs (a, b) across the components of each bucket; a visitor's closest ones are chosen among those of all its places."""
    dealt = places(rows).select(*PLACED).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    got = dealt.mapInArrow(across(closest), "key long, id long, a long, b long, agreed long")
    if closest is not None:
        best = Window.partitionBy("key", "id").orderBy(F.desc("agreed"), F.when(F.col("a") == F.col("id"), F.col("b")).otherwise(F.col("a")))
        got = got.withColumn("n", F.row_number().over(best)).where(F.col("n") <= closest)
    return got.select("a", "b").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed documents, component of each class that is linked: id, component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(sign, SIGNED), "op10-signed")
    known = docs.where("doc_id is not null")
    reps = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "op10-classes")
    keys = reps.select("id", "sig").mapInArrow(index, "key long, id long, chunk int")
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.col("chunk") % ORDERS).alias("o"), "id")).alias("first")).where("n > 1").select("key", F.col("first.id").alias("hub"))
    members = written(keys.join(hubs, "key").select("key", "id", "hub"), "op10-members")
    tried = written(members.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "op10-tried")
    sketches = written(reps.select("id", "sketch", "sig").join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "op10-sketches")
    both = tried.hint("merge").join(sketches.select(F.col("id").alias("a"), "sketch"), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("other")).hint("merge"), "b")
    near = written(both.select("a", "b", "sketch", "other").mapInArrow(alike, "a long, b long"), "op10-near")
    # the pairs that are met later are in buckets of three or more
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key")
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).union(members.join(several, "key", "left_semi").select("id").distinct())
    sets = sets_of(wanted, known)
    links = confirmed(near, sets, "op10-links")
    for step, closest in enumerate((CLOSEST, None)):
        now = components(links, "op10-now")
        placed = members.select("key", "id").join(now, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        # the pairs of a bucket's first class were tried, so a bucket of two has none left
        open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
        opened = written(placed.join(open_, "key"), "op10-open")
        hubs_of = members.where("id <> hub").join(opened.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("hub").alias("hubs"))
        rest = opened.hint("merge").join(sketches, "id").join(hubs_of, "id", "left").select("key", "id", "component", "sketch", "sig", "hubs")
        more = written(meetings(rest, closest).join(tried, ["a", "b"], "left_anti"), "op10-more")
        if more.isEmpty():
            continue
        links, tried = links.union(confirmed(more, sets, f"op10-links{step}")), tried.union(more)
    # a doc_id with several texts ties their classes
    of_doc = signed.where("n_shingles > 0").join(reps, ["s1", "s2"]).select("doc_id", "id")
    several = of_doc.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    twice = of_doc.join(several, "doc_id").select("a", F.col("id").alias("b"))
    return signed, components(links.union(twice), "op10-components")


def link(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept (the smallest), class_id (smallest doc_id with an equal set)."""
    signed, comps = classes(docs)
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"))
    got = signed.join(reps, ["s1", "s2"], "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")))
    got = got.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    got = got.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    return got.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which each group keeps the one with the smallest doc_id; all columns kept."""
    gone = link(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
