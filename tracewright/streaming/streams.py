"""Streaming forms (P): files that arrive are folded in micro-batches; results are tables in the shared folder.

Each function takes a streaming DataFrame and gives the batch DataFrame that holds after all that is
there now has been read. Checkpoints and tables are in the folder ``at``: a stream that stops goes on when it is
started again with the same one. Without ``at`` each call has a new place in the shared folder and starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.tables import new_path
from tracewright.sources.files import current_state, replace_state
from tracewright.sources.versions import upsert
from tracewright.streaming.keyed import Offsets, Totals, keyed


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], at: str) -> None:
    """Run a stream over what is there now."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def friction_density(friction: DataFrame, late: str = "2 days", at: str | None = None) -> DataFrame:
    """Counts by day, kind and signature; a later batch replaces the counts of its days. friction: ts, kind, signature."""
    spark = friction.sparkSession
    at = at or new_path(spark, "p4")
    days = friction.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind", "signature").agg(F.count("*").alias("events"))
    drained(days.select(F.col("w.start").alias("day"), "kind", "signature", "events"), "update", lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/table/part={n}"), at)
    return spark.read.parquet(f"{at}/table").groupBy("day", "kind", "signature").agg(F.max_by("events", "batch").alias("events"))


def project_states(arrivals: DataFrame, rebuilt: Callable[[], DataFrame], at: str | None = None, every: str | None = None) -> DataFrame:
    """P5: when something arrives, the state that ``rebuilt`` gives replaces the whole table.

    With ``every`` (as "10 minutes") the stream stays up and rebuilds at most that often, whatever arrives in between; without, it
    reads what is there now and ends.
    """
    spark = arrivals.sparkSession
    at = at or new_path(spark, "p5")
    each = lambda df, n: replace_state(rebuilt(), f"{at}/table", n)
    if every is None:
        drained(arrivals, "append", each, at)
    else:
        arrivals.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime=every).start().awaitTermination()
    return current_state(spark, f"{at}/table")


def host_samples(samples: DataFrame, at: str | None = None) -> DataFrame:
    """The last sample of each (host, ts) in line order, whatever batch it came with. samples: host, ts, line, value."""
    spark = samples.sparkSession
    at = at or new_path(spark, "p3")
    last = lambda df: df.groupBy("host", "ts").agg(F.max_by(F.struct("line", "value"), "line").alias("x")).select("host", "ts", "x.line", "x.value")
    drained(samples, "append", lambda df, n: last(df).write.mode("overwrite").parquet(f"{at}/table/part={n}"), at)
    return last(spark.read.parquet(f"{at}/table").drop("part"))


def sample_range(samples: DataFrame, since: str, until: str) -> DataFrame:
    """M3: samples in [since, until) by host and time; a bound within a second counts as the next whole one."""
    up = lambda x: F.ceil(F.unix_micros(F.lit(x).cast("timestamp")) / 1e6)
    return samples.where((F.unix_seconds(F.col("ts").cast("timestamp")) >= up(since)) & (F.unix_seconds(F.col("ts").cast("timestamp")) < up(until))).orderBy("host", "ts")


def kept_rows(stream: DataFrame, name: str, at: str | None) -> DataFrame:
    """The rows that a stream puts out, a folder a batch: a batch that is run again replaces its own."""
    spark = stream.sparkSession
    at = at or new_path(spark, name)
    # nothing may have arrived yet
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{at}/table/part=none")
    drained(stream, "append", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/table/part={n}"), at)
    return spark.read.schema(stream.schema).parquet(f"{at}/table/part=*")


def token_deltas(samples: DataFrame, at: str | None = None, idle: str | None = None) -> DataFrame:
    """The advance of a cumulative counter by session; a counter that fell gives the sample's own usage.

    samples: session_id, seq, total, last. A batch is put in order by seq; samples arrive in order across batches. The state is each
    session's last total.
    """
    rows = samples.select("session_id", *(F.col(c).cast("long").alias(c) for c in ("seq", "total", "last")))
    return kept_rows(keyed(rows, Totals, "session_id string, seq long, used long", idle), "p6", at)


def offsets(batches: DataFrame, at: str | None = None, idle: str | None = None) -> DataFrame:
    """Delta batches by the session's accepted offset: append, replay, conflict or bad. batches: session_id, arrival, from_offset, to_offset.

    The state is each session's offset.
    """
    rows = batches.select("session_id", *(F.col(c).cast("long").alias(c) for c in ("arrival", "from_offset", "to_offset")))
    return kept_rows(keyed(rows, Offsets, "session_id string, arrival long, verdict string", idle), "p2", at)


def sessions(lines: DataFrame, fold: Callable[[DataFrame], DataFrame], reread: Callable[[DataFrame], DataFrame], table: str) -> None:
    """Of the files that arrive, re-read whole sessions, fold them and replace their rows in ``table``, a batch at once.

    reread gives all lines of the sessions of a batch. A batch that failed half-way, or is run again, leaves the version before it or its own.
    """

    def replace(batch: DataFrame, n: int) -> None:
        touched = batch.select("agent", "session_id").distinct()
        upsert(table, ["agent", "session_id"], touched, lambda: fold(reread(touched)), n)

    drained(lines, "append", replace, table + "-stream")
