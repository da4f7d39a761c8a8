"""Streams with a keyed state (P2, P6): Spark's state store holds one value a session, whatever the number of batches.

A batch reads and writes the state of its own sessions only, and puts out its own rows. Of a session the rows of one micro-batch
are put in order in memory; ``maxFilesPerTrigger`` of the source bounds them. With ``idle`` a session that is silent for so long is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.operators.journal import verdict_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in order, each with the value that the one before left: ``step(value, row)`` gives the next value and the row put out."""

    order: list[str] = []
    out: list[str] = []

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", "value long", self.idle_ms) if self.idle_ms else handle.getValueState("value", "value long")

    def step(self, value: int | None, row: dict) -> tuple[int | None, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows))
        held = held.astype({c: "Int64" for c in held.columns if c != "session_id"}).sort_values(self.order)
        value = self.state.get()[0] if self.state.exists() else None
        out = []
        for row in held.to_dict("records"):
            value, made = self.step(value, {k: None if v is pd.NA else v for k, v in row.items()})
            out.append((key[0], *made))
        if value is not None:
            self.state.update((int(value),))
        yield pd.DataFrame(out, columns=["session_id", *self.out])

    def close(self) -> None:
        pass


class Offsets(InOrder):
    """The accepted offset of a session, 0 at first."""

    order, out = ["arrival", "from_offset", "to_offset"], ["arrival", "verdict"]

    def step(self, value, row):
        verdict, after = verdict_of(0 if value is None else value, row["from_offset"], row["to_offset"])
        return after, (row["arrival"], verdict)


class Totals(InOrder):
    """The last total of a session's counter."""

    order, out = ["seq"], ["seq", "used"]

    def step(self, value, row):
        used = row["total"] - value if value is not None and row["total"] is not None and row["total"] >= value else row["last"]
        return row["total"], (row["seq"], used)


def keyed(stream: DataFrame, processor: type[InOrder], schema: str, idle: str | None) -> DataFrame:
    """The rows that a processor makes of a stream's, by session_id; state lives in the stream's checkpoint."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return stream.groupBy("session_id").transformWithStateInPandas(processor(idle_ms), schema, "Append", "ProcessingTime" if idle else "None")
