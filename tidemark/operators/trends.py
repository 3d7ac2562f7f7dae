"""Time-series operators: velocity, half-life, watch reports, charts, top velocity."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import cut

from .graph import own_exchange


def velocity_series(snapshots: DataFrame) -> DataFrame:
    """Change per hour between consecutive usable snapshots of an item: ``id, at, hours, per_hour``.

    ``snapshots`` has (id, at timestamp, seq, views bigint or text or null).  Rows without a count, or whose text is none,
    are passed over first, then of rows at one time the first in log order counts.  Rows without id or time take no part.
    """
    if snapshots.schema["views"].dataType.simpleString() == "string":
        snapshots = snapshots.withColumn("views", F.when(F.trim("views").rlike(r"^[+-]?\d+$"), F.trim("views").try_cast("long")))
    usable = snapshots.filter(F.col("views").isNotNull() & F.col("at").isNotNull()).groupBy("id", "at").agg(F.min_by("views", "seq").alias("views")).withColumn("_d", F.date_trunc("day", "at"))
    # Points are put in order within a day; only a day's last one is put in order with those of other days.
    w = Window.partitionBy("id", "_d").orderBy("at")
    inside = usable.select("id", "_d", "at", "views", F.lag(F.struct("at", "views")).over(w).alias("_b"))
    ends = usable.groupBy("id", "_d").agg(F.max(F.struct("at", "views")).alias("_e"))
    earlier = ends.select("id", "_d", F.lag("_e").over(Window.partitionBy("id").orderBy("_d")).alias("_e"))
    met = inside.join(earlier, ["id", "_d"]).withColumn("_b", F.coalesce("_b", "_e"))
    hours = (F.unix_micros("at") - F.unix_micros("_b.at")) / 3.6e9
    pairs = met.select("id", "at", hours.alias("hours"), (F.col("views") - F.col("_b.views")).alias("change"))
    return pairs.filter("hours > 0").select("id", "at", "hours", (F.col("change") / F.col("hours")).alias("per_hour"))


def half_life(points: DataFrame, least: int = 3) -> DataFrame:
    """Exponential decay after the peak: ``id, status, have, half_life_days, r2``; points are made once and read twice.

    The peak is the first greatest point; a line is fitted to the logarithm of the positive points from
    there on.  ``have`` is what the status rests on: all points, or those of the decline.
    """
    return _half_life(cut(points), least)


def _half_life(points: DataFrame, least: int = 3) -> DataFrame:
    # Of equal peaks the first; an item's facts are met with its points by a key that lets a hot item be split.
    facts = points.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("_last"), F.max(F.struct("per_hour", (-F.unix_micros("at")).alias("neg"))).alias("_top"))
    key = own_exchange(F.xxhash64("id"))
    near = facts.select(F.col("id").alias("_id"), key.alias("_h"), "n", "_last", (-F.col("_top.neg")).alias("_peak"))
    met = points.withColumn("_k", key).join(near, (F.col("_k") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")))
    marked = met.select("id", "at", "per_hour", "n", (F.unix_micros("_last") <= F.col("_peak")).alias("at_end"), (F.unix_micros("at") >= F.col("_peak")).alias("after"))
    part = F.col("after") & (F.col("per_hour") > 0)
    # Hours since a fixed time fit the same line as hours since the peak.
    x = F.when(part, (F.unix_micros("at") / 3.6e9) - 470_000)
    y = F.when(part, F.ln("per_hour"))
    fitted = marked.groupBy("id").agg(
        F.max("n").alias("n"), F.max("at_end").alias("at_end"), F.count_if(part).alias("m"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count_distinct(x).alias("nx"), F.count_distinct(y).alias("ny")
    )
    few = F.when(F.col("at_end"), "not_decaying").otherwise("insufficient_data")
    status = F.when(F.col("n") < least, "insufficient_data").when(F.col("m") < least, few).when(F.col("nx") < 2, "insufficient_data").when(F.col("slope") >= 0, "not_decaying").otherwise("ok")
    ok = F.col("status") == "ok"
    return fitted.withColumn("status", status).select(
        "id", "status", F.when(F.col("n") < least, F.col("n")).otherwise(F.col("m")).alias("have"),
        F.when(ok, F.round(F.lit(log(2)) / -F.col("slope") / 24, 2)).alias("half_life_days"), F.when(ok, F.round(F.when(F.col("ny") == 1, 1.0).otherwise(F.col("r2")), 3)).alias("r2"),
    )


def watch_report(watched: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row for each watched item (``ord, id`` and, where it has them, ``kind`` and ``note``): snapshot counts, ends by log order, velocities, half-life."""
    ends = snapshots.groupBy("id").agg(
        F.count("*").alias("snapshots"), F.min_by("at", "seq").alias("first_at"), F.max_by("at", "seq").alias("last_at"),
        F.max_by("views", F.when(F.col("views").isNotNull(), F.col("seq"))).alias("latest_views"), F.max_by(F.col("views").isNull(), "seq").alias("missing_last"),
    )
    points = cut(velocity_series(snapshots))
    own = [F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "note") if c in watched.columns]
    speeds = points.groupBy("id").agg(F.round(F.max_by("per_hour", "at"), 2).alias("latest_per_hour"), F.round(F.max("per_hour"), 2).alias("peak_per_hour"))
    lives = _half_life(points).select("id", "status", "half_life_days")
    met = watched.join(ends, "id", "left").join(speeds, "id", "left").join(lives, "id", "left")
    return met.select("ord", "id", *own, F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "first_at", "last_at", "latest_views", F.coalesce("missing_last", F.lit(False)).alias("missing_last"), "latest_per_hour", "peak_per_hour", F.coalesce("status", F.lit("insufficient_data")).alias("status"), "half_life_days")


def _last_of_day(chart: DataFrame) -> DataFrame:
    """The last snapshot of each region's day, and in it the last row of each id."""
    days = chart.withColumn("day", F.col("at").cast("date"))
    last = days.groupBy("region", "day").agg(F.max("at").alias("at"))
    kept = days.join(last, ["region", "day", "at"])
    return kept.groupBy("region", "day", "id").agg(F.max_by(F.struct("rank", "title", "channel"), "seq").alias("r")).select("region", "day", "id", "r.*")


def chart_daily(chart: DataFrame) -> DataFrame:
    """Entries, exits and size of each day's chart against the day observed before: ``region, day, entries, exits, size``."""
    kept = _last_of_day(chart).select("region", "day", "id")
    order = Window.partitionBy("region").orderBy("day")
    days = kept.select("region", "day").distinct().select("region", "day", F.lag("day").over(order).alias("before"), F.lead("day").over(order).alias("after"))
    here = kept.join(days, ["region", "day"])
    earlier = kept.select("region", F.col("day").alias("before"), "id", F.lit(1).alias("was"))
    entered = here.join(earlier, ["region", "before", "id"], "left").groupBy("region", "day").agg(F.count_if(F.col("was").isNull()).alias("entries"), F.count("*").alias("size"))
    later = kept.select("region", F.col("day").alias("after"), "id")
    left = here.filter("after IS NOT NULL").join(later, ["region", "after", "id"], "left_anti").groupBy("region", F.col("after").alias("day")).agg(F.count("*").alias("exits"))
    return entered.join(left, ["region", "day"], "left").select("region", "day", "entries", F.coalesce("exits", F.lit(0)).alias("exits"), "size")


def chart_residence(chart: DataFrame) -> DataFrame:
    """How long and how high each id stood: first and last day, days, best and latest rank, latest title, first channel."""
    return _last_of_day(chart).groupBy("region", "id").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("days_on_chart"), F.min("rank").alias("best_rank"), F.max_by("rank", "day").alias("latest_rank"),
        F.max_by("title", "day").alias("title"), F.min_by("channel", "day").alias("channel"),
    )


def top_velocity(items: DataFrame, as_of: str, k: int = 5, least_age: float = 0.5) -> DataFrame:
    """The ``k`` items of most views a day of age: ``id, per_day``; age counts as half a day at least."""
    age = F.greatest(F.lit(least_age), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("published_at")) / 8.64e10)
    return items.select("id", F.round(F.col("views") / age, 4).alias("per_day")).orderBy(F.desc("per_day"), "id").limit(k)


def discover(items: DataFrame, as_of: str, least: int, most: int, k: int = 5, least_age: float = 0.5) -> DataFrame:
    """The ``k`` items of most views a day among those of a length between ``least`` and ``most`` seconds, channels of topics left out.

    ``items`` has (id, channel, duration, views, likes, comments, published_at).  Adds rounded age and velocity and the
    share of views that were answered by a like or comment, in percent.
    """
    days = F.greatest(F.lit(least_age), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("published_at")) / 8.64e10)
    half_up = lambda x: F.floor(x + 0.5)
    answered = F.when(F.col("views") > 0, half_up((F.col("likes") + F.col("comments")) / F.col("views") * 10000) / 100).otherwise(0.0)
    fit = items.filter(F.col("duration").between(least, most) & ~F.coalesce("channel", F.lit("")).rlike("Topic$"))
    made = fit.select("id", "channel", "duration", "views", half_up(days).cast("long").alias("age_days"), half_up(F.col("views") / days).cast("long").alias("per_day"), answered.alias("answered"))
    return made.orderBy(F.desc("per_day"), "id").limit(k)


def longest_residents(residence: DataFrame, k: int = 15) -> DataFrame:
    """Of each region the ``k`` ids that stood longest, the better rank first among equals: ``region, place, id, days_on_chart, best_rank``."""
    order = Window.partitionBy("region").orderBy(F.desc("days_on_chart"), "best_rank", "id")
    return residence.select("region", F.row_number().over(order).alias("place"), "id", "days_on_chart", "best_rank").filter(F.col("place") <= k)


def last_days(daily: DataFrame, k: int = 7) -> DataFrame:
    """The last ``k`` observed days of each region's chart."""
    order = Window.partitionBy("region").orderBy(F.desc("day"))
    return daily.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
