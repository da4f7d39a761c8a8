"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least ``threshold`` are at most eps = sqrt(2 - 2 threshold) apart.
Vectors are turned onto principal axes (any orthonormal axes keep distances; these come from a bounded
sample), sorted by the cells of width eps on the leading ones and cut into blocks. Blocks whose boxes
are farther apart than eps cannot hold a link. The others meet, found by the cells of the two leading
axes, and are joined recursively: two sequence intervals are skipped if their boxes are too far apart,
else halved until they are small, and small ones are compared by one product in double precision.

Of a pair of blocks only the number of links of each vector and a spanning forest of the links leave
the task, however many links there are, so large groups of copies make no pairs.

Vectors that are null, zero, or hold a null or non-finite component link with nothing; so do vectors of
different lengths. Every row is a vector, also where vec_ids repeat or are null. Labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import components, sampled, written

THRESHOLD = 0.95
AXES = 8
BLOCK = 4096
LEAF = 256
SAMPLE = 20_000
#: Added to eps so that rounding never skips a link.
MARGIN = 1e-6


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles of length one."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns) of a sample of at most SAMPLE vectors, those with the least hash."""
    some = [r[0] for r in sampled(rows.select("embedding"), ["embedding"], SAMPLE).collect()]
    x = unit(pa.array(some, pa.list_(pa.float64())), dim) if some else np.eye(dim)
    _, vectors = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
    return vectors[:, ::-1]


def boxes(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(p), size)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)


def apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance of boxes."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return (gap * gap).sum(-1)


def join_blocks(a: np.ndarray, pa_: np.ndarray, b: np.ndarray | None, pb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of a and of b (b None: a with itself) and a forest of edges (row numbers, those of b after those of a)."""
    same = b is None
    b, pb = (a, pa_) if same else (b, pb)
    most = 2 - 2 * threshold + MARGIN
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    shift = 0 if same else len(a)
    parent = np.arange(len(a) + (0 if same else len(b)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i, j, k, m):
        if same and m <= i:
            return
        if apart(pa_[i:j].min(0), pa_[i:j].max(0), pb[k:m].min(0), pb[k:m].max(0)) > most:
            return
        if j - i <= LEAF and m - k <= LEAF:
            hit = a[i:j] @ b[k:m].T >= threshold
            if same:
                hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if not hit.any():
                return
            count_a[i:j] += hit.sum(1)
            count_b[k:m] += hit.sum(0)
            # labels of rows and columns fall to the least in reach
            rows, cols = np.arange(j - i), np.full(m - k, j - i + m)
            while True:
                cols2 = np.minimum(cols, np.where(hit, rows[:, None], j - i + m).min(0))
                rows2 = np.minimum(rows, np.where(hit, cols2[None, :], j - i + m).min(1))
                if (rows2 == rows).all() and (cols2 == cols).all():
                    break
                rows, cols = rows2, cols2
            for r in np.flatnonzero(rows != np.arange(j - i)):
                x, y = root(i + r), root(i + rows[r])
                parent[max(x, y)] = min(x, y)
            for c in np.flatnonzero(hit.any(0)):
                x, y = root(shift + k + c), root(i + cols[c])
                parent[max(x, y)] = min(x, y)
            return
        u = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        v = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        for x in u:
            for y in v:
                join(*x, *y)

    join(0, len(a), 0, len(b))
    edges = [(int(x), int(r)) for x in np.flatnonzero(parent != np.arange(len(parent))) for r in [root(x)]]
    return (count_a + count_b, np.zeros(0, np.int64), edges) if same else (count_a, count_b, edges)


def links_of(rows: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """(rid, n, to): links of a vector found in one pair of blocks, and a vector that it is connected with there."""
    turn = axes(rows, dim)[:, : min(AXES, dim)]
    eps = float(np.sqrt(2 - 2 * threshold + MARGIN))
    q = turn.shape[1]
    two = min(2, q)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.floor(unit(b.column("embedding"), dim) @ turn / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("embedding"), *(pa.array(c[:, k]) for k in range(q))], names=["rid", "embedding", *(f"c{k}" for k in range(q))])

    names = [f"c{k}" for k in range(q)]
    placed = rows.select("rid", "embedding").mapInArrow(cells, f"rid long, embedding array<double>, {', '.join(f'{c} int' for c in names)}")
    placed = placed.repartitionByRange(max(1, -(-rows.count() // block)), *names).sortWithinPartitions(*names, "rid")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, cell = [], [], set()

        def made():
            v = np.concatenate(x)
            p = v @ turn
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0][0])]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]), pa.array([[list(c) for c in sorted(cell)]], pa.list_(pa.list_(pa.int32())))], names=["block", "ids", "data", "low", "high", "cells"])

        for b in batches:
            v, r = unit(b.column("embedding"), dim) if b.num_rows else np.zeros((0, dim)), b.column("rid").to_numpy()
            c = np.floor(v @ turn[:, :two] / eps).astype(np.int32)
            for at in range(0, len(r), block):
                ids.append(r[at : at + block])
                x.append(v[at : at + block])
                cell.update(map(tuple, np.unique(c[at : at + block], axis=0).tolist()))
                if sum(map(len, ids)) >= block:
                    yield made()
                    ids, x, cell = [], [], set()
        if ids:
            yield made()

    made = written(placed.select("rid", "embedding").mapInArrow(blocks, "block long, ids binary, data binary, low array<double>, high array<double>, cells array<array<int>>"), "op6-blocks")
    meta = made.select("block", "low", "high", F.explode("cells").alias("cell"))
    around = meta
    for k in range(two):
        around = around.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"x{k}", F.get("cell", F.lit(k)) + F.col("d"))
    left = around.select(F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), *(f"x{k}" for k in range(two))).distinct()
    right = meta.select(F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), *(F.get("cell", F.lit(k)).alias(f"x{k}") for k in range(two)))
    met = left.join(right, [f"x{k}" for k in range(two)]).where("a <= b").drop(*(f"x{k}" for k in range(two))).distinct()
    gap = F.aggregate(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = met.where(gap <= 2 - 2 * threshold + MARGIN).select("a", "b")
    # a block meets itself and those after it; its own vectors come first and the others pass by
    own = made.select(F.col("block").alias("a"), F.lit(None).cast("long").alias("b"), "ids", "data")
    others = pairs.where("a < b").join(made.withColumnRenamed("block", "b"), "b").select("a", "b", "ids", "data")
    both = own.union(others).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, b, ids, data = (batch.column(c)[k].as_py() for c in range(4))
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)
                p = v @ turn
                if b is None:
                    first = (ids, v, p)
                    n, _, edges = join_blocks(v, p, None, None, threshold)
                else:
                    n_a, n_b, edges = join_blocks(first[1], first[2], v, p, threshold)
                    n, ids = np.concatenate([n_a, n_b]), np.concatenate([first[0], ids])
                to = ids.copy()
                for x, y in edges:
                    to[x] = ids[y]
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(to[some])], names=["rid", "n", "to"])

    return both.mapInArrow(joined, "rid long, n long, to long")


def link(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest vec_id reachable, itself included), kept (the smallest)."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = F.coalesce(F.size(x) > 0, F.lit(False)) & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", x.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = written(rows, "op6-rows")
    found = None
    for (dim,) in sorted(map(tuple, rows.where("fine").select(F.size("embedding")).distinct().collect())):
        got = links_of(rows.where(F.col("fine") & (F.size("embedding") == dim)), dim, threshold, block)
        found = got if found is None else found.union(got)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "op6-links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    comps = components(found.where("rid <> to").select(F.col("rid").alias("a"), F.col("to").alias("b")), "op6-components")
    placed = rows.select("rid", "vec_id").join(comps.withColumnRenamed("id", "rid"), "rid", "left").join(counts, "rid", "left").select("vec_id", F.coalesce("component", "rid").alias("component"), F.coalesce("n", F.lit(0)).alias("n_links"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    got = placed.join(least, "component")
    return got.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
