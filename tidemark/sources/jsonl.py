"""Readers and writers of event logs and other files that hold one record a line, or one in all."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, seq: str = "seq") -> DataFrame:
    """Records of JSON lines with their order ``seq``; blank and broken lines, such as a torn last one, are left out.

    The order is that of files by path, of the parts that a large file is read in, and of lines within them.  Where there
    is no file there are no records.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString()
    try:
        texts = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{seq} struct<file:string,part:bigint,line:bigint>, {_fields(kind)}")
    lines = texts.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")).alias("_s"), F.col("value").alias("_l"))
    corrupt = f"struct<{_fields(kind)},_broken:string>"
    parsed = lines.select("_s", "_l", F.from_json("_l", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).filter(F.trim("_l") != "")
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._broken").isNull())
    return good.select(F.col("_s").alias(seq), "r.*").drop("_broken")


def read_runs(spark: SparkSession, base: str, schema: StructType | str, file: str = "ledger.jsonl", seq: str = "seq") -> DataFrame:
    """Records of all runs' logs with the ``run`` they are of: ``base/r_*`` and, nested once more, ``base/*/r_*``.

    A log that both ways lead to is read once, by its path without ``.`` and ``..``; runs come in the order of their paths.
    """
    files = [f for pattern in (f"{base}/r_*/{file}", f"{base}/*/r_*/{file}") for f in matching(spark, pattern)]
    if not files:
        kind = schema if isinstance(schema, str) else schema.simpleString()
        return spark.createDataFrame([], f"{seq} struct<file:string,part:bigint,line:bigint>, run string, {_fields(kind)}")
    rows = read_lines(spark, sorted(dict.fromkeys(files)), schema, seq)
    return rows.select(seq, F.regexp_extract(F.col(f"{seq}.file"), r"/([^/]+)/[^/]+$", 1).alias("run"), *[c for c in rows.columns if c != seq])


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a pattern matches, resolved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted({files.resolvePath(f.getPath()).toString() for f in files.globStatus(path) or []})


def read_charts(spark: SparkSession, base: str, schema: StructType | str, prefix: str = "chart", seq: str = "seq") -> DataFrame:
    """Records of charts, of which each region has a file ``<prefix>_<region>.jsonl``, with their ``region``."""
    rows = read_lines(spark, f"{base}/{prefix}_*.jsonl", schema, seq)
    return rows.select(seq, F.regexp_extract(F.col(f"{seq}.file"), rf"/{prefix}_([^/]*)\.jsonl$", 1).alias("region"), *[c for c in rows.columns if c != seq])


def _fields(kind: str) -> str:
    return kind[len("struct<") : -1] if kind.startswith("struct<") else kind


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that each hold one JSON array; missing or broken files give none."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return texts.select(F.explode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("r")).select("r.*")


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a registry file ``{"records": [...]}`` with their place ``ord``."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.posexplode(F.from_json("value", f"struct<records:array<struct<{_fields(schema)}>>>")["records"]).alias("ord", "r")).select("ord", "r.*")


def read_cards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark cards from a list or from ``{"cards": [...]}``; any other file is an error."""
    texts = spark.read.text(path, wholetext=True)
    each = f"array<struct<{_fields(schema)}>>"
    cards = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", each)).otherwise(F.coalesce(F.from_json("value", f"struct<cards:{each}>")["cards"], F.raise_error(F.lit("cards are neither a list nor in an object's list of that name")).cast(each)))
    return texts.select(F.explode(cards).alias("r")).select("r.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Answers from a map of task to answer; a null answer is an abstention, not a missing one."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("task_id", "answer"))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Answers from lines that each hold a map of task to answer; null answers stay."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("task_id", "answer"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, content``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The file of a folder that changed last: ``path, modificationTime``."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modificationTime"))


def read_sealed(spark: SparkSession, path: str, most: int = 50_000_000) -> DataFrame:
    """Files as bytes with their hash: ``path, length, sha256``; those over ``most`` bytes are left out."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append records to a log folder as JSON lines; a job's lines appear together or not at all."""
    rows.write.mode("append").json(path)
