"""A table in buckets whose versions are published at once.

Buckets are written aside, in a folder of their own, and count when a version record names them. A record is made under the next
number and never overwritten: of two writers one fails and starts again from the other's version, and a reader sees
the version before or after a change, never half of it. What the last versions don't name is removed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Versions whose data stay, so that a reader that began with one can end.
KEPT = 3
TRIES = 5
#: A reserved number whose record did not come for so long was left by a writer that died.
STALE_SECONDS = 600


class Conflict(Exception):
    """Another writer published the same version."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))


def _numbers(fs, at) -> list[int]:
    if not fs.exists(at("versions")):
        return []
    return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(at("versions")) if x.getPath().getName().endswith(".json") and not x.getPath().getName().startswith("."))


def _read(spark: SparkSession, at, number: int) -> dict:
    return json.loads(spark.read.text(at("versions", f"{number}.json").toString(), wholetext=True).first().value)


def latest(spark: SparkSession, table: str) -> dict | None:
    """The last version record: number, batch, schema and the folder of each bucket; None before the first."""
    fs, at = _files(spark, table)
    found = _numbers(fs, at)
    return _read(spark, at, found[-1]) if found else None


def rows_of(spark: SparkSession, table: str, version: dict, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a version, of some of its buckets or all."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(version["schema"])
    paths = [f"{table}/{p}" for b, p in version["buckets"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(spark: SparkSession, table: str, version: dict) -> None:
    """Make the record of ``version``; Conflict if its number is taken."""
    fs, at = _files(spark, table)
    record, aside = at("versions", f"{version['number']}.json"), at("versions", f".{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    # an empty file reserves the number: only one writer can create it
    reserve = at("versions", f".{version['number']}.taken")
    try:
        fs.create(reserve, False).close()
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if not fs.exists(record) and fs.exists(reserve) and time.time() - fs.getFileStatus(reserve).getModificationTime() / 1000 > STALE_SECONDS:
            fs.delete(reserve, False)
        raise Conflict(str(version["number"])) from e
    if fs.exists(record) or not fs.rename(aside, record):
        raise Conflict(str(version["number"]))


def upsert(table: str, keys: list[str], touched: DataFrame, rows: Callable[[], DataFrame], batch: int | None = None) -> int:
    """Replace the rows of the ``touched`` keys by ``rows()``, which may be none; gives the number of the version.

    A ``batch`` that the last version has already is not applied again. Only the buckets of touched keys are read and written.
    """
    spark = touched.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    for _ in range(TRIES):
        before = latest(spark, table)
        if before and batch is not None and before["batch"] is not None and before["batch"] >= batch:
            return before["number"]
        new = rows()
        named = sorted(str(r.b) for r in touched.select(bucket.alias("b")).distinct().collect())
        if before:
            old = rows_of(spark, table, before, named).join(touched.select(*keys).distinct(), keys, "left_anti")
            new = old.select(*new.columns).unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        new.withColumn("bucket_", bucket).write.partitionBy("bucket_").parquet(f"{table}/{folder}")
        fs, at = _files(spark, table)
        written = {x.getPath().getName().removeprefix("bucket_="): f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(at(folder)) if x.getPath().getName().startswith("bucket_=")}
        held = {b: p for b, p in (before["buckets"] if before else {}).items() if b not in named}
        version = {"number": before["number"] + 1 if before else 0, "batch": batch if batch is not None else before and before["batch"], "schema": new.schema.jsonValue(), "buckets": held | written}
        try:
            publish(spark, table, version)
        except Conflict:
            fs.delete(at(folder), True)
            continue
        clean(spark, table)
        return version["number"]
    raise Conflict(f"{TRIES} writers were faster")


def clean(spark: SparkSession, table: str) -> None:
    """Remove records before the last KEPT versions and folders that none of those name, unless they are newer than all of them (a writer may be at work)."""
    fs, at = _files(spark, table)
    numbers = _numbers(fs, at)
    if len(numbers) <= KEPT:
        return
    named = {p.split("/")[1] for n in numbers[-KEPT:] for p in _read(spark, at, n)["buckets"].values()}
    since = fs.getFileStatus(at("versions", f"{numbers[-KEPT]}.json")).getModificationTime()
    for x in fs.listStatus(at("data")):
        if x.getPath().getName() not in named and x.getModificationTime() < since:
            fs.delete(x.getPath(), True)
    for n in numbers[:-KEPT]:
        for name in (f"{n}.json", f".{n}.taken"):
            fs.delete(at("versions", name), False)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the last version."""
    version = latest(spark, table)
    if version is None:
        raise ValueError(f"{table} has no version yet")
    return rows_of(spark, table, version)
