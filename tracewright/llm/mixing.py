"""Mixing of sources to target weights by fixed-length blocks.

Each source's words are one stream, in a fixed order of its documents, cut into blocks of ``block``
words. Targets are a share of all words by weight, capped at ``most`` times a source's own words, the
excess shared again by weight. A target is so many block slots, which a multinomial draw deals over the
output shards, source by source in tasks of their own, so that shards have about their number of slots
and the sources' totals are met. The k-th slot of a source takes block ``perm(k mod n)`` of its n blocks,
a pseudorandom permutation by index (a Feistel network that walks on until it is below n) that needs no
table, so no block is taken more than ``most`` times. Blocks and documents meet by index. A source with
less than half a block to give is met to the nearest block.

One row a source is all that the driver sees.

Sizes are words; a null text has none. Null sources are one source, last. Rows that repeat a doc_id
are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import kept_columns, let, quoted, words_of, written

BLOCK_WORDS = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SHARD_SLOTS = 4096
#: Documents of one source and salt, about: the stream of a source is numbered salt by salt.
SALT_DOCUMENTS = 4096
#: The table of one row per source is broadcast up to so many sources; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 20_000
#: Slots of one Arrow batch.
SLOT_ROWS = 100_000
SEED = 20240


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of sources in order: ``share`` of all sizes by repeating weights, none above ``most`` times its size."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    got, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if rest * w[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                got[k] = rest * w[k] / total
            break
        for k in over:
            got[k] = float(most * sizes[k])
        open_ -= set(over)
        rest -= sum(got[k] for k in over)
    return got


def draw(slots: int, shards: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A multinomial draw of a source's slots over the output shards: the shards that get some, and how many."""
    rng = np.random.default_rng(seed)
    if slots < shards:
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    n = rng.multinomial(slots, np.full(shards, 1 / shards))
    got = np.flatnonzero(n)
    return got, n[got]


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of ``k`` (below n) under a pseudorandom permutation of 0 .. n - 1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, seed, n]).integers(0, 1 << 63, 4, np.uint64)
    out, open_ = k.astype(np.uint64), np.arange(len(k))
    while len(open_):
        x = out[open_]
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(33)) & low)
        x = left << np.uint64(half) | right
        out[open_] = x
        open_ = open_[x >= n]
    return out.astype(np.int64)


def streams(docs: DataFrame) -> DataFrame:
    """(source, salt, rn, doc_id, tk, size, at): where each document begins in its source's stream of words.

    A source's order is (salt, doc_id, hash of the text); sums run within a salt and then over the salts
    of a source, so that no task gets a whole source.
    """
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    rows = written(rows, "op7-sizes")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(max(1, -(-rows.count() // SALT_DOCUMENTS)))))
    within = Window.partitionBy("source", "salt").orderBy("doc_id", "tk").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = rows.groupBy("source", "salt").agg(F.sum("size").alias("n")).select("source", "salt", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("source", "salt").orderBy("doc_id", "tk"))
    rows = rows.withColumn("rn", number).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r").join(salts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.salt") == F.col("s.salt")))
    return rows.select("r.source", "r.salt", "rn", "doc_id", "tk", "size", (F.col("inner") + F.col("before")).alias("at"))


class Mix:
    """The mix of ``docs``: sources (source, number, size, target, blocks, slots) and its tables."""

    def __init__(self, docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share=SHARE, most=MOST, shard_slots=SHARD_SLOTS, seed=SEED):
        self.spark, self.block = docs.sparkSession, block
        self.docs = written(streams(docs), "op7-streams")
        # one row per source
        found = sorted(((r.source, int(r.n or 0)) for r in self.docs.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
        goal = targets([n for _, n in found], weights, share, most)
        blocks = [-(-n // block) for _, n in found]
        slots = [min(int(most * b), round(g * b / n)) if n else 0 for (_, n), g, b in zip(found, goal, blocks)]
        self.sources = list(zip((s for s, _ in found), range(len(found)), (n for _, n in found), goal, blocks, slots))
        self.shards, self.seed = max(1, -(-sum(slots) // shard_slots)), seed

    def source_table(self) -> DataFrame:
        """One row per source, broadcast while they are few."""
        table = self.spark.createDataFrame([(s, k, n, float(g)) for s, k, n, g, _, _ in self.sources], "of_source string, number int, source_size long, target double")
        return F.broadcast(table) if len(self.sources) <= BROADCAST_SOURCES else table

    def slots(self) -> DataFrame:
        """A row for each slot of the output: shard, number (of the source), block, epoch."""
        shards, seed = self.shards, self.seed

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, blocks, slots in zip(*(b.column(k).to_pylist() for k in range(3))):
                    got, n = draw(slots, shards, [seed, number])
                    first = np.cumsum(n) - n
                    for k in range(0, len(got), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[k : k + 4096]), number, np.int32)), pa.array(np.full(len(got[k : k + 4096]), blocks)), *(pa.array(x[k : k + 4096]) for x in (got, first, n))], names=["number", "blocks", "shard", "first", "n"])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, blocks, shard, first, n in zip(*(b.column(k).to_pylist() for k in range(5))):
                    for at in range(first, first + n, SLOT_ROWS):
                        k = np.arange(at, min(at + SLOT_ROWS, first + n))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(np.full(len(k), number, np.int32)), pa.array(permuted(k % blocks, blocks, number)), pa.array((k // blocks).astype(np.int32))], names=["shard", "number", "block", "epoch"])

        counts = self.spark.createDataFrame([(k, b, n) for _, k, _, _, b, n in self.sources if n], "number int, blocks long, slots long")
        # a source's shards are dealt out again, so that a large source is placed by many tasks
        counts = counts.repartition("number").mapInArrow(drawn, "number int, blocks long, shard long, first long, n long").repartition(max(1, -(-int(sum(n for *_, n in self.sources)) // SLOT_ROWS)), "number", "shard")
        return counts.mapInArrow(placed, "shard long, number int, block long, epoch int")

    def spans(self) -> DataFrame:
        """The document spans of each block: number, block, salt, rn, doc_id, tk, size, first (word of the document), words."""
        d = self.docs.alias("d").join(self.source_table(), F.col("d.source").eqNullSafe(F.col("of_source")))
        b = F.lit(self.block)
        d = d.select("d.*", "number", "source_size", "target", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)))).alias("block"))
        low, high = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
        return d.select("number", "block", "salt", "rn", "source_size", "target", "doc_id", "tk", "size", (low - F.col("at")).alias("first"), F.coalesce(high - low, F.lit(0)).alias("words"))

    def taken(self) -> DataFrame:
        """Per document: doc_id, tk, size, source_size, target, taken, and the spans it gives: (epoch, first, words)."""
        times = self.slots().groupBy("number", "block").agg(F.collect_list("epoch").alias("epochs"))  # at most ``most`` for each block
        # slots grow with the corpus, though the table of sources that they are made from looks small: never broadcast
        both = self.spans().hint("merge").join(times, ["number", "block"], "left")
        given = F.transform(F.coalesce("epochs", F.array()), lambda e: F.struct(e.alias("epoch"), F.col("first").alias("first"), F.col("words").alias("words")))
        both = both.withColumn("given", given).withColumn("part", F.size("given") * F.col("words"))
        return both.groupBy("number", "salt", "rn", "doc_id", "tk", "size", "source_size", "target").agg(F.sum("part").cast("long").alias("taken"), F.flatten(F.collect_list("given")).alias("given"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and the spans (epoch, first word, words) that the mix takes."""
    return Mix(docs, **options).taken().select("doc_id", "size", "source_size", "target", "taken", "given")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns kept: for each document and epoch one row with the words taken, joined by spaces (the text itself where it is taken whole).

    A document of which nothing is taken, as one without words, is not in the mix. Equal rows take the same spans.
    """
    m = Mix(docs, **options)
    got = m.taken().where("taken > 0").select(F.col("doc_id").alias("mix_id"), F.col("tk").alias("mix_tk"), "number", F.col("size").alias("mix_size"), "given").dropDuplicates(["mix_id", "mix_tk", "number"])
    each = got.withColumn("epoch", F.explode(F.array_distinct(F.transform("given", lambda g: g["epoch"]))))
    each = each.withColumn("given", F.array_sort(F.filter("given", lambda g: g["epoch"] == F.col("epoch"))))
    each = each.join(m.source_table(), "number")
    keyed = docs.select(kept_columns(docs).alias("rest"), "text", F.xxhash64("text").alias("tk"))
    both = keyed.join(each, F.col("rest.doc_id").cast("long").eqNullSafe(F.col("mix_id")) & (F.col("tk") == F.col("mix_tk")) & F.col("rest.source").eqNullSafe(F.col("of_source")))
    whole = F.aggregate("given", F.lit(0).cast("long"), lambda a, g: a + g["words"]) == F.col("mix_size")

    def cut(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform("given", lambda g: F.slice(words, g["first"].cast("int") + 1, g["words"].cast("int")))), " ")

    text = F.when(whole, F.col("text")).otherwise(let(words_of(F.col("text")), cut))
    return both.select(*(text.alias("text") if c == "text" else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns))
