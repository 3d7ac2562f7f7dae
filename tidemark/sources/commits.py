"""A table that many writers append to, in which every key stands once.

Rows lie in folders under ``data``; what counts is listed by numbered files under ``_commits``, one for each append, that
are made only if no file of that number is there.  A writer reads the commits, writes those of its rows whose keys
aren't in them, and puts its commit next; if another was faster it holds its rows against what that one brought
and tries again.  A batch that is replayed finds its own commit and adds nothing.  Folders without a commit, left by a
writer that died, are never read.  The file system must refuse to make a file that exists, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger

from .storage import _path, remove


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a table in order: ``folder``, ``writer``, ``batch``."""
    files, at = _path(spark, f"{path}/_commits")
    if not files.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(at))
    found = []
    for i, name in enumerate(n for n in names if n.isdigit()):
        if int(name) != i:
            raise ValueError(f"commit {i} of {path} is missing")
        found.append(_read(spark, f"{path}/_commits/{name}"))
    return found


def _read(spark: SparkSession, path: str) -> dict:
    """A commit; one that is just being written is waited for."""
    import time

    files, at = _path(spark, path)
    for _ in range(100):
        stream = files.open(at)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            return json.loads(text)
        time.sleep(0.1)
    raise ValueError(f"{path} was never finished")


def _put(spark: SparkSession, path: str, commit: dict) -> bool:
    """Make a commit unless one of its number is there."""
    files, at = _path(spark, path)
    files.mkdirs(at.getParent())
    try:
        out = files.create(at, False)
    except Exception as e:  # noqa: BLE001
        if files.exists(at):
            return False
        raise e
    out.write(bytearray((json.dumps(commit) + "\n").encode()))
    out.close()
    return True


def read_once(spark: SparkSession, path: str, seen: list[dict] | None = None) -> DataFrame | None:
    """The rows of all commits (or of those given); None where there are none."""
    folders = [f"{path}/data/{c['folder']}" for c in (commits(spark, path) if seen is None else seen) if c["folder"]]
    return spark.read.parquet(*folders) if folders else None


def _unknown(rows: DataFrame, known: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    firsts = ledger.first(rows, keys, order)
    if known is None:
        return firsts
    # Only what is asked for is looked up, so a small batch is held against a large table without moving the table.
    there = known.select(*keys).join(firsts.select(*keys), keys, "left_semi").distinct()
    return firsts.join(there, keys, "left_anti")


def append_once(rows: DataFrame, path: str, keys: list[str], order: str, writer: str, batch: int) -> int:
    """Append the first row by ``order`` of each key that the table doesn't hold; returns the number of the commit.

    Of two writers with a key the one that commits first keeps it.  An append without new keys is committed too, so
    that its replay is known.  Null keys are never equal to any, so rows with one are appended each time.
    """
    spark = rows.sparkSession
    seen = commits(spark, path)
    rest, mine = _unknown(rows, read_once(spark, path, seen), keys, order), None
    while True:
        for i, c in enumerate(seen):
            if (c["writer"], c["batch"]) == (writer, batch):
                if mine:
                    remove(spark, f"{path}/data/{mine}")
                return i
        folder = f"{writer}-{batch}-{uuid.uuid4().hex}"
        rest.write.parquet(f"{path}/data/{folder}")
        if mine:
            remove(spark, f"{path}/data/{mine}")
        mine = folder
        if _put(spark, f"{path}/_commits/{len(seen):012d}", {"folder": folder, "writer": writer, "batch": batch}):
            return len(seen)
        now = commits(spark, path)
        rest, seen = _unknown(spark.read.schema(rows.schema).parquet(f"{path}/data/{mine}"), read_once(spark, path, now[len(seen) :]), keys, order), now


def insert_once_into(stream: DataFrame, path: str, keys: list[str], order: str, writer: str, checkpoint: str):  # noqa: ANN201
    """A stream's sink that appends each key once, whatever other streams write to the table and however often a batch is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch, path, keys, order, writer, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
