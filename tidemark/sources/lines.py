"""Text in a total order: lines numbered and written over many tasks, and read back in the order of their bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str = "line_no") -> DataFrame:
    """Rows with their number from 1 in the order of some columns, and in that order over partitions and within.

    Rows are dealt by ranges and sorted there; a row's number is its place in its range and the rows of the ranges
    before it, of which one count a range goes by way of the driver.  Rows that tie may come in either order.
    """
    ranged = cut(cut(df).repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(_PLACE)})
    counts = sorted(tuple(r) for r in placed.groupBy("_p").agg(F.count("*")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    base = F.create_map(*[F.lit(x) for (p, _), b in zip(counts, before[:-1], strict=True) for x in (p, b)]) if counts else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn(name, (base[F.col("_p")] + F.col("_i") + 1).cast("long")).drop("_p", "_i")


def write_lines(df: DataFrame, order: list[str], line: str, path: str) -> None:
    """Write the texts of a column as lines, in the order of some columns over the files by name and within each.

    A text is one line: its line breaks are written as spaces.  Nulls are empty lines.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\r\n|[\r\n]", " ")
    # Ranges are found in a pass of their own, so what is written is made once before.
    cut(df.select(*order, text.alias("_l"))).repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("_l").alias("value")).write.mode("overwrite").text(path)


def lines_at(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files by the byte they begin at: ``file, offset, line``; only a line feed ends a line.

    The order by file and offset is that of the files, however they are split for reading.  What a split's lines hold is
    summed up, so each begins where those before it end; blocks are put in order within their file, lines within
    their block.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    size = F.octet_length("line") + F.lit(1)
    sums = rows.groupBy("file", "block").agg(F.sum(size).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_o", F.coalesce(F.sum(size).over(within), F.lit(0))).join(bases, ["file", "block"])
    return met.select("file", (F.col("base") + F.col("_o")).alias("offset"), "line")


def read_ordered(spark: SparkSession, path: str, name: str = "line_no") -> DataFrame:
    """Lines of a folder of text files with their number over all of them, in the order of files by name: ``line_no, line``."""
    return numbered(lines_at(spark, path), ["file", "offset"], name).select(name, "line")
