"""Growing logs as streams: insert once, fold per item, change against the previous point, replace a day.

A batch operator sees a log whole and puts late rows in their place; so does a stream that keeps what the watermark
still lets in.  Where a stream has passed rows by it is said below.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark.operators import producers
from tidemark.sources import commits
from tidemark.sources.storage import cut, exists, importable


def insert_once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key ever.  State grows with the keys; no watermark forgets one."""
    return stream.dropDuplicates(keys)


def latest(stream: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key so far, by log order and not by arrival; state is one row a key.

    Written in update mode a batch gives the keys it changes, in complete mode all.
    """
    rest = [c for c in stream.columns if c not in keys and c != order]
    return stream.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*")


def velocity(stream: DataFrame) -> DataFrame:
    """Change per hour against the previous point of an item (``id, at, views, seq``): ``id, at, per_hour``.

    Rows of one batch are put in order, of rows at one time the first by ``seq`` counts; a row older than the last point of an earlier batch is dropped, where
    the batch operator would insert it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, views = state.get if state.exists else (None, None)
        # Each part is reduced before the next is read, so a hot item holds one row for each point in time.
        rows = None
        for part in parts:
            part = part.dropna(subset=["views"])
            part = part if rows is None else pd.concat([rows, part])
            rows = part.sort_values(["at", "seq"]).drop_duplicates("at")
        if rows is None:
            return
        out = []
        for t, v in zip(rows["at"], rows["views"], strict=True):
            us = int(t.value // 1000)
            if at is not None and us <= at:
                continue
            if at is not None:
                out.append((key[0], t, (v - views) / ((us - at) / 3.6e9)))
            at, views = us, int(v)
        if at is not None:
            state.update((at, views))
        yield pd.DataFrame(out, columns=["id", "at", "per_hour"])

    importable(stream.sparkSession)
    kind = stream.schema["id"].dataType.simpleString()
    picked = stream.select("id", F.col("at").cast("timestamp").alias("at"), F.col("views").cast("long").alias("views"), F.col("seq").cast("long").alias("seq"))
    return picked.groupBy("id").applyInPandasWithState(step, f"id {kind}, at timestamp, per_hour double", "at long, views long", "append", GroupStateTimeout.NoTimeout)


def frontier(stream: DataFrame) -> DataFrame:
    """The state of each item after every batch that touches it: ``item, is_open, is_closed, is_visited``.

    The open or close of greatest ``seq`` so far decides whether an item is open, whenever it arrives; that it was closed
    or visited is true for good.  State is one row an item, and a batch's parts are read one by one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, closed, visited, last = state.get if state.exists else (False, False, False, None)
        for part in parts:
            closed, visited = closed or (part["op"] == "close").any(), visited or (part["op"] == "visit").any()
            turns = part[part["op"].isin(["open", "close"])]
            if len(turns) and (last is None or turns["seq"].max() > last):
                at = turns["seq"].idxmax()
                last, is_open = int(turns["seq"][at]), turns["op"][at] == "open"
        is_open, closed, visited = bool(is_open), bool(closed), bool(visited)
        state.update((is_open, closed, visited, last))
        yield pd.DataFrame([(key[0], is_open, closed, visited)], columns=["item", "is_open", "is_closed", "is_visited"])

    importable(stream.sparkSession)
    kind = stream.schema["item"].dataType.simpleString()
    picked = stream.select("item", "op", F.col("seq").cast("long").alias("seq"))
    return picked.groupBy("item").applyInPandasWithState(step, f"item {kind}, is_open boolean, is_closed boolean, is_visited boolean", "o boolean, c boolean, v boolean, last long", "update", GroupStateTimeout.NoTimeout)


def append_snapshot(watched: DataFrame, payload: DataFrame, path: str, at: str, number: int) -> int:
    """Append a row for each watched item (``id``) with what a payload says of it, or that it is missing: the job of a schedule.

    ``at`` is the time of the snapshot and ``number`` its place among them.  A job that runs again for the same time adds
    nothing, nor does one that runs beside another; rows lie in a table of ``commits``.  Returns the commit's number.
    """
    rows = producers.snapshot_rows(watched, payload).withColumns({"at": F.lit(at), "seq": F.lit(number).cast("long")})
    return commits.append_once(rows, path, ["id", "at"], "seq", f"snapshot-{at}".replace(" ", "T").replace(":", ""), number)


def counts_by_window(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and value by window and kind, closed once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def replace_days(stream: DataFrame, path: str, day: str = "day", snapshot: str = "snapshot", checkpoint: str | None = None):  # noqa: ANN201
    """A sink that keeps of each day the rows of its latest snapshot (``snapshot``, of any type with an order).

    A later snapshot takes the place of what was written for its day before, an earlier one that comes late changes
    nothing, and one that spans batches is kept whole.  Equal rows of a snapshot are one, so a replayed batch adds
    nothing.  Only the days that a batch has rows of are read and written anew.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch)
        if rows.isEmpty():
            return
        if exists(spark, path):
            there = spark.read.schema(rows.schema).option("basePath", path).parquet(path)
            rows = rows.unionByName(there.join(F.broadcast(rows.select(day).distinct()), day, "left_semi").select(*rows.columns))  # days of one batch
        last = rows.groupBy(day).agg(F.max(snapshot).alias("_last"))
        kept = cut(rows.join(last, day).filter(F.col(snapshot) == F.col("_last")).drop("_last").distinct())
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}.checkpoint").trigger(availableNow=True)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    ids, at, per_hour = ([r[i] for r in rows] for i in range(3))
    return pd.DataFrame({"id": pd.Series(ids, dtype=object), "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "per_hour": pd.Series(per_hour, dtype="float64")})


class _Velocity(StatefulProcessor):
    """Points of an item within the watermark, by their time in microseconds, and the last one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "at long", "views long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        touched: set[int] = set()
        for part in rows:  # each part goes into the state before the next is read
            part = part.dropna(subset=["at", "views"]).sort_values(["at", "seq"]).drop_duplicates("at")
            for at, views, seq in zip((part["at"].astype("datetime64[us]").astype("int64")).tolist(), part["views"].tolist(), part["seq"].tolist(), strict=True):
                was = self.points.getValue((at,)) if self.points.containsKey((at,)) else None
                if was is None or seq < was[1]:
                    self.points.updateValue((at,), (int(views), int(seq)))
                    touched.add(at)
        held = sorted((k[0], v[0]) for k, v in self.points.iterator())
        if held:
            self.handle.registerTimer(held[-1][0] // 1000 + 1)
        out = [(key[0], t, (v - w) / ((t - u) / 3.6e9)) for (u, w), (t, v) in zip(held, held[1:]) if t in touched or u in touched]  # noqa: B905
        yield _changes(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        """All points but the last that the watermark has passed go: no row that may still come lies before that."""
        passed = sorted(k[0] for k in self.points.keys() if k[0] // 1000 < timerValues.getCurrentWatermarkInMs())
        for at in passed[:-1]:
            self.points.removeKey((at,))
        yield _changes([])

    def close(self) -> None:
        pass


def velocity_with_late(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Change per hour against the previous point of an item (``id, at, views, seq``), late points included: ``id, at, per_hour``.

    A point that comes late, but within the watermark, is put in its place, and its own change and that of the point after
    it come out anew; in update mode the last row of an ``(id, at)`` is what the batch operator gives.  Of points at one time
    the first by ``seq`` counts.  State holds the points since the watermark and the one before, the rest goes by timers.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    importable(stream.sparkSession)
    kind = stream.schema["id"].dataType.simpleString()
    picked = stream.select("id", F.col("at").cast("timestamp").alias("at"), F.col("views").cast("long").alias("views"), F.col("seq").cast("long").alias("seq")).withWatermark("at", late)
    return picked.groupBy("id").transformWithStateInPandas(_Velocity(), f"id {kind}, at timestamp, per_hour double", "Update", "EventTime")
