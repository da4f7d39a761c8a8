"""Shared helpers: the shared folder, intermediate tables, text batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new local one in local mode (as in tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(rows: DataFrame, keys: list[str], most: int, without_key: list[str] | None = None) -> DataFrame:
    """At most ``most`` rows of ``rows``, one for each value of ``keys``, those with the least hash of it.

    Where a key is null, the columns ``without_key`` stand for it. Keys above a cut of the hash are dropped where they are
    read. The cut lets about 1.2 times ``most`` different keys through, however often a key repeats, with a margin beyond what
    chance and the approximate count of keys can lack, so no more are ordered and the sample is never short.
    """
    k = F.xxhash64(*keys)
    if without_key:
        k = F.when(reduce(lambda x, y: x | y, (F.col(c).isNull() for c in keys)), F.xxhash64(*keys, *without_key)).otherwise(k)
    rows = rows.withColumn("sample_k", k)
    n = rows.agg(F.approx_count_distinct("sample_k", 0.02)).first()[0]
    wanted = int(1.2 * most + 8 * most**0.5) + 40
    if n > wanted:
        rows = rows.where(F.col("sample_k") < F.lit(-(1 << 63) + (wanted << 64) // n))
    # rows with equal keys are one, the least
    return rows.groupBy("sample_k").agg(F.min(F.struct(*(c for c in rows.columns if c != "sample_k"))).alias("row")).orderBy("sample_k").limit(most).select("row.*")


def drawn(text: Column, key: Column, chars: int) -> Column:
    """``chars`` characters of a text from a place that ``key``'s hash draws; all of a shorter one."""
    return F.substring(text, (1 + F.pmod(F.xxhash64(key), F.greatest(F.length(text) - chars, F.lit(0)) + 1)).cast("int"), F.lit(chars))


def kept_columns(docs: DataFrame, without: tuple[str, ...] = ("text",)) -> Column:
    """All columns but ``without`` as one struct; names are taken as they are, whatever characters they hold."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in without))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Rows of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of BATCH_ROWS from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, whatever number of times it is used."""
    return F.transform(F.array(value), use)[0]


class Chunk:
    """Some documents of a batch: row numbers ``rows``, bytes ``data``, offsets ``at`` (one more than rows)."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, at: np.ndarray):
        self.rows, self.data, self.at = rows, data, at


def chunks(column: pa.Array, most: int) -> Iterator[Chunk]:
    """Cut a text column into chunks of at most ``most`` bytes; a longer text is a chunk of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off, buf = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield Chunk(np.arange(first, last), data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def packed_words(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one unsigned integer (seven places fewer than bytes)."""
    data = np.ascontiguousarray(data)
    return np.array(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns a and b. Returns (id, component): each id that has an edge to another
    one, and the smallest id reachable. Every step is a grouping and a join; a node with very many
    neighbours is only an aggregate with partial sums and a join that adaptive execution can split.
    """
    both = edges.where(F.col("a") != F.col("b"))
    cur = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    flat = lambda: cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    if cur.isEmpty():
        return flat()
    before = None
    for _ in range(rounds):
        # large star: the larger neighbours of each node are tied to the least of its neighbourhood
        way = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = way.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b"))
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        cur2 = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        step = cur2.union(least.select("a", F.col("m").alias("b"))).distinct()
        cur = written(step.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), name)
        # settled when a step changes nothing
        got = seen.get
        if got == before:
            return flat()
        before = got
    raise RuntimeError(f"components did not settle in {rounds} rounds")
