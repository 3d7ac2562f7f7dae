"""Streams over files against what the batch operators make of the same rows."""

import os
import random

from pyspark.sql import functions as F

from tidemark.operators import ledger, trends
from tidemark.sources import commits, lines, logfile
from tidemark.streaming import logs


def stream_of(spark, df, path, parts):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


def rows_of(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    pts = spark.createDataFrame([("a", 0, 10, 1), ("a", 3600, 30, 2), ("b", 0, 5, 3), ("a", 7200, 30, 4), ("b", 1800, 6, 5)], "id string, s long, views long, seq long").withColumn("at", F.timestamp_seconds("s"))
    parts = [pts.filter("seq <= 2"), pts.filter("seq > 2")]
    got = sorted((r.id, r.at, r.per_hour) for r in rows_of(spark, logs.velocity(stream_of(spark, pts, tmp_path / "v", parts)), "v", "append"))
    assert got == sorted((r.id, r.at, r.per_hour) for r in trends.velocity_series(pts).collect())

    twice = pts.unionByName(pts)
    once = rows_of(spark, logs.insert_once(stream_of(spark, twice, tmp_path / "o", [pts, pts]), ["id"]), "o", "append")
    assert sorted(r.id for r in once) == ["a", "b"]

    # The last row by log order, whatever the order of arrival.
    log = spark.createDataFrame([("a", 3, "new"), ("b", 1, "only"), ("a", 2, "old")], "k string, seq long, v string")
    last = rows_of(spark, logs.latest(stream_of(spark, log, tmp_path / "l", [log.filter("seq != 2"), log.filter("seq = 2")]), ["k"]), "l", "complete")
    assert sorted((r.k, r.v) for r in last) == [("a", "new"), ("b", "only")]

    # Of rows at one time the first by log order counts, however they are dealt over batches' parts.
    tied = spark.createDataFrame([("t", 0, 1, 1), ("t", 3600, 9, 4), ("t", 3600, 5, 3)], "id string, s long, views long, seq long").withColumn("at", F.timestamp_seconds("s"))
    assert [r.per_hour for r in rows_of(spark, logs.velocity(stream_of(spark, tied, tmp_path / "t", [tied])), "t", "append")] == [4.0]

    ev = spark.createDataFrame([("x", "open", 1), ("x", "visit", 2), ("x", "close", 3), ("y", "open", 4), ("x", "open", 5)], "item string, op string, seq long")
    last = {r["item"]: tuple(r)[1:] for r in rows_of(spark, logs.frontier(stream_of(spark, ev, tmp_path / "f", [ev.filter("seq <= 3"), ev.filter("seq > 3")])), "f", "update")}
    batch = {r["item"]: (r.is_open, r.is_closed, r.is_visited) for r in ledger.frontier_state(ev).collect()}
    assert last == batch
    # An open that arrives after a later close opens nothing.
    late = [ev.filter("seq IN (1, 3)"), ev.filter("seq IN (2, 4)"), ev.filter("item = 'x' AND seq = 5").withColumn("seq", F.lit(2).cast("long"))]
    last = {r["item"]: r.is_open for r in rows_of(spark, logs.frontier(stream_of(spark, ev, tmp_path / "fl", late)), "fl", "update")}
    assert last == {"x": False, "y": True}

    # A day's later snapshot takes the place of the earlier one, a late earlier one changes nothing, and one over two batches is whole.
    days = spark.createDataFrame([("d1", 1, 10), ("d2", 1, 11), ("d1", 2, 20), ("d1", 2, 21), ("d1", 1, 12), ("d2", 1, 13), ("d1", 2, 20)], "day string, snapshot int, n int")
    out = str(tmp_path / "days")
    batches = [(10, 11), (20,), (21, 12), (13, 20)]
    for k, ns in enumerate(batches):  # one batch after the other
        part = days.filter(F.col("n").isin(*ns))
        logs.replace_days(stream_of(spark, days, tmp_path / f"d{k}", [part]), out, checkpoint=f"{out}.checkpoint{k}").start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("day", "snapshot", "n").collect()) == [("d1", 2, 20), ("d1", 2, 21), ("d2", 1, 11), ("d2", 1, 13)]

    events = spark.createDataFrame([("2024-01-01 00:10", "click", 1.0), ("2024-01-03 00:10", "click", 2.0)], "t string, event_type string, value double").selectExpr("timestamp(t) AS ts", "event_type", "value")
    closed = rows_of(spark, logs.counts_by_window(stream_of(spark, events, tmp_path / "w", [events])), "w", "append")
    assert [(r.n, r.value) for r in closed] == [(1, 1.0)]  # the later window is still open


def test_late_points_take_their_place(spark, tmp_path):
    """Points in any order over ten batches give what the batch operator gives; what the watermark has passed is forgotten."""
    rng = random.Random(15)
    points = [(f"i{k % 4}", 600 * rng.randrange(300), rng.randrange(1000), k) for k in range(240)]
    points = sorted(points, key=lambda p: p[1] + rng.randrange(40_000))  # late by half a day at most
    pts = spark.createDataFrame(points, "id string, s long, views long, seq long").withColumn("at", F.timestamp_seconds("s"))
    place = spark.createDataFrame([(p[3], i // 24) for i, p in enumerate(points)], "seq long, batch int")
    dealt = pts.join(place, "seq").select(*pts.columns, "batch")
    parts = [dealt.filter(F.col("batch") == b).drop("batch") for b in range(10)]
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = {}
        for r in rows_of(spark, logs.velocity_with_late(stream_of(spark, pts, tmp_path / "late", parts)), "late", "update"):
            told[r.id, r.at] = r.per_hour
    finally:
        spark.conf.set(name, old)
    want = {(r.id, r.at): r.per_hour for r in trends.velocity_series(pts).collect()}
    assert set(told) == set(want)
    rows = {k: (told[k], want[k]) for k in want if abs(told[k] - want[k]) > 1e-9}
    assert not rows


def test_insert_once_across_writers(spark, tmp_path):
    """Two streams with common keys and a replayed batch leave each key once: that of whoever committed first, by order within a batch."""
    path = str(tmp_path / "table")
    a = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), ("y", 3, "a")], "k string, seq long, v string")
    b = spark.createDataFrame([("y", 1, "b"), ("z", 2, "b"), ("z", 4, "b2")], "k string, seq long, v string")
    for writer, df in (("a", a), ("b", b), ("a", a)):
        for k in range(2):  # the second time with a checkpoint of its own, as if the first had been lost: its batches are replayed
            commits.insert_once_into(stream_of(spark, df, tmp_path / f"{writer}{k}", [df.filter("seq < 3"), df.filter("seq >= 3")]), path, ["k"], "seq", writer, str(tmp_path / f"cp-{writer}-{k}")).trigger(availableNow=True).start().awaitTermination(120)
    rows = sorted(tuple(r) for r in commits.read_once(spark, path).select("k", "seq", "v").collect())
    assert [r[0] for r in rows] == ["x", "y", "z"] and rows[0] == ("x", 1, "first") and rows[2] == ("z", 2, "b")
    assert commits.append_once(a, path, ["k"], "seq", "c", 0) == len(commits.commits(spark, path)) - 1


def test_a_faster_writer_wins(spark, tmp_path, monkeypatch):
    """A commit that came in between is seen, and its keys aren't written again."""
    path = str(tmp_path / "table")
    schema = "k string, seq long"
    real, raced = commits._put, []

    def put(session, at, commit):
        if not raced:
            raced.append(1)
            commits.append_once(session.createDataFrame([("x", 9), ("w", 9)], schema), path, ["k"], "seq", "other", 0)
        return real(session, at, commit)

    monkeypatch.setattr(commits, "_put", put)
    assert commits.append_once(spark.createDataFrame([("x", 1), ("y", 1)], schema), path, ["k"], "seq", "me", 0) == 1
    assert sorted(tuple(r) for r in commits.read_once(spark, path).collect()) == [("w", 9), ("x", 9), ("y", 1)]
    assert len(os.listdir(f"{path}/data")) == 2


def test_logs_by_byte(spark, tmp_path):
    """Lines come in the order of their bytes at any split, a torn last line once it is whole."""
    rng = random.Random(16)
    folder = tmp_path / "log"
    folder.mkdir()
    texts = ["".join(rng.choice(["", "a", "é", "日本", " x\r", "long " * 9]) for _ in range(rng.randrange(6))) for _ in range(300)]
    (folder / "a.jsonl").write_bytes(("\n".join(texts) + "\n").encode() + "torn".encode())
    (folder / "b.jsonl").write_bytes(b"\n\nonly\n")
    (folder / "_hidden").write_bytes(b"no\n")
    (folder / "c.jsonl").write_bytes(b"nothing whole")
    want, at = [], 0
    for t in texts:
        want.append(("a.jsonl", at, t))
        at += len(t.encode()) + 1
    want += [("b.jsonl", 0, ""), ("b.jsonl", 1, ""), ("b.jsonl", 2, "only")]
    spark.dataSource.register(logfile.LogSource)
    rows = lambda df: sorted((os.path.basename(r.file), r.offset, r.line) for r in df.collect())
    for split in (30, 100, 10**6):
        assert rows(spark.read.format("log").option("split", split).load(str(folder))) == want
    # The engine's own reader too, but that it takes the last line as it is.
    for size in ("300", "10000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = rows(lines.lines_at(spark, [str(folder / "a.jsonl"), str(folder / "b.jsonl")]))
        assert got == sorted([*want, ("a.jsonl", at, "torn")])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")

    seen = []
    stream = spark.readStream.format("log").option("split", 50).load(str(folder))
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(rows(df))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert sorted(seen) == want
        with open(folder / "a.jsonl", "ab") as f:
            f.write(b" and more")
        query.processAllAvailable()
        assert sorted(seen) == want
        with open(folder / "a.jsonl", "ab") as f:
            f.write(b" to come\nnext\nagain torn")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen) == sorted([*want, ("a.jsonl", at, "torn and more to come"), ("a.jsonl", at + 22, "next")])


def test_lines_in_order(spark, tmp_path):
    """A million lines, written over many files, read back as they were ordered; numbers go on over partitions."""
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_000).alias("n")).withColumn("text", F.concat(F.lit("line "), "n"))
    path = str(tmp_path / "out")
    lines.write_lines(df, ["n"], "text", path)
    back = lines.read_ordered(spark, path)
    assert back.agg(F.count("*"), F.count_if(F.col("line") != F.concat(F.lit("line "), F.col("line_no") - 1)), F.min("line_no"), F.max("line_no")).first() == (1_000_000, 0, 1, 1_000_000)
    assert lines.numbered(df.limit(0), ["n"]).count() == 0
