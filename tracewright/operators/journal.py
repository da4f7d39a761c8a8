"""Change logs (A5, A7, A16-A18): snapshots, journals, delta batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def journal_latest(journal: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key in line order; deleted keys are gone."""
    rest = [c for c in journal.columns if c not in keys]
    got = journal.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("line_no")).alias("x"))
    return got.select(*keys, "x.*").where(~F.coalesce(F.col("deleted"), F.lit(False)))


def snapshot_delta(latest: DataFrame, snapshot: DataFrame, key: str = "key") -> DataFrame:
    """What a full snapshot changes in the journal's state: new and changed values, and tombstones for keys that are gone."""
    old = latest.select(key, F.col("value").alias("old"), F.lit(True).alias("was"))
    new = snapshot.select(key, F.col("value").alias("new"), F.lit(True).alias("is"))
    both = old.join(new, key, "full_outer").where(F.col("is").isNull() | F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.col("new").alias("value"), F.col("is").isNull().alias("deleted")).orderBy(key)


def repeated_keys(snapshot: DataFrame, key: str = "key") -> DataFrame:
    """Keys that a snapshot has twice, which is an error."""
    return snapshot.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def changed_sessions(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """A5: files whose size or time (the newest of their own and their subagents') differ from the manifest's, or that it lacks."""
    m = manifest.select(F.col("path"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    now = files.withColumn("mtime", F.greatest("mtime", F.coalesce("child_mtime", "mtime")))
    return now.join(m, "path", "left").where(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")))).select("path", "size", "mtime")


def path_collisions(folds: DataFrame) -> DataFrame:
    """Sessions that come from several paths: the later fold wins and the collision is reported."""
    w = Window.partitionBy("agent", "session_id")
    rows = folds.withColumn("n", F.row_number().over(w.orderBy(F.desc("fold_order")))).withColumn("paths", F.size(F.collect_set("path").over(w)))
    return rows.where("n = 1 and paths > 1").select("agent", "session_id", "path", "paths")


def verdict_of(at: int | None, a: int | None, b: int | None) -> tuple[str, int | None]:
    """What becomes of a batch [a, b) where ``at`` is accepted next, and what is accepted after it."""
    if None not in (a, b) and b < a:
        return "bad", at
    if None not in (a, at) and a == at:
        return "append", b
    return ("replay" if None not in (b, at) and b <= at else "conflict"), at


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (session_id, arrival, from_offset, to_offset, start) sorted by session and arrival: session_id, arrival, verdict, n (place in the session), next (the offset accepted next).

    The offset is all that is kept of a session. A start row, the first of its session, sets it and has no verdict.
    """
    session, n, at = None, 0, 0
    for batch in batches:
        verdicts, places, after = [], [], []
        for s, a, b, start in zip(*(batch.column(c).to_pylist() for c in ("session_id", "from_offset", "to_offset", "start"))):
            if (s,) != session:
                session, n, at = (s,), 0, 0
            if start:
                verdict, at = None, b
            else:
                verdict, at = verdict_of(at, a, b)
            n += 1
            verdicts.append(verdict)
            places.append(n)
            after.append(at)
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("arrival"), pa.array(verdicts, pa.string()), pa.array(places, pa.int64()), pa.array(after, pa.int64())], names=["session_id", "arrival", "verdict", "n", "next"])


def judged(batches: DataFrame) -> DataFrame:
    """The verdicts of ``judge`` on batches (session_id, arrival, from_offset, to_offset, start), a session's one after another in arrival order."""
    longs = batches.select("session_id", *(F.col(c).cast("long").alias(c) for c in ("arrival", "from_offset", "to_offset")), "start")
    ordered = longs.repartition("session_id").sortWithinPartitions("session_id", F.desc("start"), "arrival", "from_offset", "to_offset")
    return ordered.mapInArrow(judge, f"session_id {dict(batches.dtypes)['session_id']}, arrival long, verdict string, n long, next long")


def classify_batches(batches: DataFrame) -> DataFrame:
    """What becomes of delta batches in arrival order: append (from = next), replay (to <= next), conflict, or bad (to < from).

    The offset that is accepted next is the end of the last append, so a batch is judged by a fold in order.
    batches: session_id, arrival, from_offset, to_offset.
    """
    last = F.max_by("next", "n").over(Window.partitionBy("session_id"))
    return judged(batches.withColumn("start", F.lit(False))).select("session_id", "arrival", "verdict", last.alias("next_offset"))
