"""The corpus tables, and the domain tables that are read from them.

Each adapter states in columns what an event log would hold: ids, sources, labels and references are
derived from keys, so that results can be recomputed elsewhere from the same files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import remove, shared_folder


#: Copies of a text begin alike, so this is a hypothesis in which they meet.
HYPOTHESIS = "ascii(coalesce(text, '')) * 10000 + ascii(substr(coalesce(text, ''), 2, 1)) * 100 + length(substring_index(coalesce(text, ''), ' ', 1))"


class Tables:
    """Readers of the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        """Events with their time as a point in time, of the session's zone."""
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def snapshots(self) -> DataFrame:
        """Counts of each user's purchases so far, in cents, at each event: ``id, at, seq, views``."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        views = F.sum(F.round(F.col("value") * 100).cast("long")).over(order)
        return self.events().select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), views.alias("views"))

    def chart(self, size: int = 50) -> DataFrame:
        """Each day's users of most value by kind of event: ``region, at, seq, id, rank, title, channel``."""
        cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
        daily = self.events().groupBy(F.col("event_type").alias("region"), F.date_trunc("day", "ts").alias("at"), F.col("user_id").alias("id")).agg(cents, F.max("event_id").alias("seq"))
        rank = F.row_number().over(Window.partitionBy("region", "at").orderBy(F.desc("cents"), "id"))
        return daily.withColumn("rank", rank).filter(F.col("rank") <= size).select("region", "at", "seq", "id", "rank", F.expr("concat('u', id, '-', cents)").alias("title"), F.expr("concat('c', id % 7)").alias("channel"))

    def artifacts(self) -> DataFrame:
        """A capture of each document: ``artifact_id, source, method, type, sha256, quality_label, seq``."""
        return self.raw("documents").selectExpr(
            "doc_id AS seq", "concat('a', doc_id) AS artifact_id", "concat('https://s', (doc_id * doc_id + doc_id div 11) % 9, '.co.uk/p', doc_id) AS source", "'fetch' AS method",
            "CASE doc_id % 7 WHEN 5 THEN 'json' WHEN 6 THEN 'pdf' ELSE 'html' END AS type", "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE sha2(text, 256) END AS sha256",
            "CASE WHEN doc_id % 29 = 0 THEN 'BOT_WALL' ELSE 'OK' END AS quality_label",
        )

    def present(self) -> DataFrame:
        """What the stored captures hash to now; some are gone or changed."""
        return self.raw("documents").selectExpr("concat('a', doc_id) AS artifact_id", "CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN sha2(concat(text, 'x'), 256) ELSE sha2(text, 256) END AS actual_sha256")

    def findings(self) -> DataFrame:
        """A finding for each document; some cite a capture that is missing."""
        return self.raw("documents").selectExpr(
            "doc_id AS seq", "source AS run", "CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE concat('a', doc_id) END AS artifact_id", "text", "text AS quote",
            "CASE doc_id % 3 WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'INFERRED' ELSE 'CORRECTED' END AS label",
            "CASE doc_id div 2 % 5 WHEN 0 THEN 'disconfirms' WHEN 1 THEN 'neutral' ELSE 'confirms' END AS polarity", "doc_id div 4 AS conclusion_id", f"cast({HYPOTHESIS} AS bigint) AS hypothesis_id",
            "CASE WHEN doc_id % 11 = 0 THEN concat('wire', doc_id % 4) ELSE '' END AS origin", "CASE WHEN doc_id % 6 = 0 THEN array(concat('a', doc_id + 1)) ELSE cast(array() AS array<string>) END AS corroborated_by",
            "'2024-12-31' AS ts", "CASE doc_id % 8 WHEN 1 THEN concat('cue=', doc_id % 90) WHEN 2 THEN 'frame=12.5' WHEN 3 THEN 'cue=x' ELSE '' END AS locator",
        )

    def pubdates(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id AS seq", "concat('a', doc_id) AS artifact_id", "cast(date_add(date'2024-01-01', cast(doc_id % 400 AS int)) AS string) AS published_at")

    def measures(self) -> DataFrame:
        """Error rates of captures, measured twice."""
        return self.raw("documents").selectExpr("concat('a', doc_id) AS artifact_id", "explode(array(struct(doc_id * 2 AS seq, (doc_id % 100) / 100D AS cer), struct(doc_id * 2 + 1 AS seq, (doc_id % 50) / 100D AS cer))) AS m").select("artifact_id", "m.*")

    def hypotheses(self) -> DataFrame:
        """The thesis of all documents that begin alike, with stakes and mode."""
        return self.findings().groupBy("hypothesis_id").agg(F.min("seq").alias("seq"), F.min("run").alias("run"), F.min_by("text", "seq").alias("thesis")).selectExpr("hypothesis_id", "seq", "run", "thesis", "CASE hypothesis_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS stakes", "CASE WHEN hypothesis_id % 2 = 0 THEN 'debunk' ELSE 'discover' END AS mode")

    def predictions(self, claim: str = "text") -> DataFrame:
        """A forecast for each labelled document; ``claim`` says what of its text is wanted."""
        # Before the join, which else moves whole texts for whoever asks for the hypothesis only.
        told = self.raw("documents").selectExpr("doc_id", f"{claim} AS claim", f"cast({HYPOTHESIS} AS bigint) AS hypothesis_id")
        return self.raw("labels").join(told, "doc_id").selectExpr(
            "doc_id AS seq", "doc_id AS prediction_id", "claim", "(doc_id % 101) / 100D AS stated_confidence", "concat('2025-0', 1 + doc_id % 2) AS resolve_by", "hypothesis_id", "'2024-06-01T00:00:00Z' AS created"
        )

    def resolutions(self) -> DataFrame:
        """What came of each forecast; some are withdrawn later."""
        return self.raw("labels").selectExpr(
            "doc_id AS prediction_id", "toxic = 0 AS anchored", "CASE WHEN doc_id % 13 = 0 THEN '2024-06-01T00:00:00Z' ELSE '2024-07-01T00:00:00Z' END AS ts",
            "explode(CASE WHEN doc_id % 7 = 0 THEN array(struct(2 * doc_id AS seq, if(quality = 1, 'hit', 'miss') AS outcome), struct(2 * doc_id + 1 AS seq, 'unresolved' AS outcome))"
            " ELSE array(struct(2 * doc_id AS seq, if(quality = 1, 'hit', 'miss') AS outcome)) END) AS r",
        ).select("prediction_id", "anchored", "ts", "r.*")

    def frontier_events(self) -> DataFrame:
        return self.raw("conversations").selectExpr("conv_id div 3 AS item", "CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'visit' ELSE 'close' END AS op", "conv_id * 100000 + turn AS seq")

    def cards(self) -> DataFrame:
        """A question on each part's price; answers come from its order lines."""
        return self.raw("part").selectExpr(
            "cast(p_partkey AS string) AS task_id", "CASE p_partkey % 3 WHEN 0 THEN 'settled-fact' WHEN 1 THEN 'api-number' ELSE 'on-screen-price' END AS answer_kind", "CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE concat('costs ', format_number(cast(p_retailprice AS decimal(18,2)), 2), ' won') END AS gold_value",
            "1000D AS tolerance", "p_partkey % 2 = 0 AS stable", "p_partkey % 5 = 0 AS holdout", "p_partkey % 11 = 0 AS poison", "cast(date_add(date'2024-01-01', cast(p_partkey % 300 AS int)) AS string) AS captured_at", "'200' AS ttl_days",
        )

    def results(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_extendedprice", "l_quantity"), F.struct("l_orderkey", "l_linenumber")).alias("l"))
        return lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "cast(p_partkey AS string) AS task_id",
            "CASE WHEN p_partkey % 22 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN concat('It is ', p_brand, '.') ELSE concat('about ', format_number(cast(l.l_extendedprice / l.l_quantity AS decimal(18,2)), 2)) END AS answer",
        )

    def facts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS ord", "cast(o_orderkey AS string) AS id", "o_orderpriority AS claim", "CASE o_orderkey % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'degraded' ELSE 'observed' END AS status",
            "cast(cast(o_orderdate AS date) AS string) AS observed_at", "CASE WHEN o_orderkey % 9 = 0 THEN cast(date_add(cast(o_orderdate AS date), 900) AS string) END AS effective_at", "cast(30 + o_orderkey % 900 AS int) AS ttl_days",
        )

    def records(self) -> DataFrame:
        """The facts as a registry holds them, some of them invalid."""
        return self.facts().selectExpr(
            "ord", "CASE WHEN ord % 97 = 0 THEN ' ' WHEN ord % 89 = 0 THEN 'twice' ELSE id END AS id", "CASE WHEN ord % 83 = 0 THEN '' ELSE claim END AS claim", "CASE WHEN ord % 79 = 0 THEN 'rumour' ELSE status END AS status",
            "CASE WHEN ord % 73 = 0 THEN concat(observed_at, 'T00:00') WHEN ord % 2 = 0 THEN concat(' ', observed_at) ELSE observed_at END AS observed_at", "effective_at", "CASE WHEN ord % 71 = 0 THEN 0 ELSE ttl_days END AS ttl_days",
            "CASE ord % 67 WHEN 0 THEN array() WHEN 1 THEN array('') ELSE array('s') END AS source_refs", "CASE WHEN ord % 61 = 0 THEN '' ELSE 'all' END AS scope",
        )

    def gradings(self) -> DataFrame:
        """Grades of two conclusions in three, graded again now and then."""
        graded = self.raw("documents").selectExpr("doc_id AS seq", "doc_id div 4 AS conclusion_id", "concat('std', doc_id % 2) AS standard_id", "CASE doc_id % 5 WHEN 0 THEN 'MEETS' WHEN 1 THEN 'UNKNOWN' ELSE 'SHORTFALL' END AS overall")
        return graded.filter("conclusion_id % 3 != 0")

    def runs(self) -> DataFrame:
        """Runs with the summary that was left of them."""
        return self.raw("documents").groupBy(F.col("source").alias("run")).agg(F.min("doc_id").alias("d")).selectExpr(
            "run", "CASE d % 3 WHEN 0 THEN '2024-07-01T00:00:00Z' WHEN 1 THEN '' END AS created", "CASE d % 4 WHEN 0 THEN '# x [ALPHA]' WHEN 1 THEN '[RECON] y' WHEN 2 THEN '[ALPHA] and [RECON]' ELSE 'z' END AS summary"
        )

    def spool(self) -> str:
        """A new folder of the shared storage, removed with the application."""
        import atexit

        path = f"{shared_folder(self.spark)}/spool-{uuid.uuid4().hex}"

        def gone() -> None:
            if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                remove(self.spark, path)

        atexit.register(gone)
        return path

    def spooled(self, lines: DataFrame) -> str:
        """A folder into which lines (``value``) have been written as text."""
        path = self.spool()
        lines.write.text(path)
        return path

    def spooled_by(self, texts: DataFrame, key: str) -> str:
        """A pattern of files that each hold the one text (``value``) of a key."""
        path = self.spool()
        texts.repartition(key).write.option("lineSep", "\n").partitionBy(key).option("maxRecordsPerFile", 1).text(path)
        return f"{path}/{key}=*"

    def segments(self) -> DataFrame:
        """Turns of conversations as timed segments."""
        return self.raw("conversations").selectExpr(
            "conv_id AS transcript_id", "turn AS idx", "turn * 5D AS start", "turn * 5D + (length(text) % 50) / 10D AS end", "text", "(turn % 10) / 10D AS no_speech_prob", "-(length(text) % 20) / 10D AS avg_logprob"
        )

    def clips(self) -> DataFrame:
        return self.segments().groupBy("transcript_id").agg((F.max("idx") * 5.0 + 5.0).alias("duration")).selectExpr("transcript_id", "duration", "CASE WHEN transcript_id % 4 = 0 THEN 0.01D ELSE 0.05D END AS rms")

    def fetched(self) -> DataFrame:
        """Pages with what their fetch is said to have met."""
        return self.raw("pages").selectExpr(
            "page_id", "url", "CASE WHEN page_id % 13 = 0 THEN '' ELSE html END AS body", "cast(CASE page_id % 12 WHEN 3 THEN 404 WHEN 5 THEN 403 WHEN 7 THEN 503 WHEN 9 THEN 429 ELSE 200 END AS int) AS status",
            "CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS hit", "page_id % 41 = 0 AS unpassed", "html",
        )

    def robots(self) -> DataFrame:
        """A robots file for each host of the pages."""
        host = F.lower(F.try_parse_url("url", F.lit("HOST")))
        return self.raw("pages").select(host.alias("host")).distinct().selectExpr(
            "host", "cast(CASE length(host) % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS int) AS status", "CASE length(host) % 11 WHEN 2 THEN 'text/html' ELSE 'text/plain; charset=utf-8' END AS content_type",
            "concat('# rules\\nUser-agent: *\\nDisallow: /', substr(host, 1, 1), '\\nDisallow: /en/*5\\nAllow: /en/25\\n\\nUser-agent: goodbot\\nuser-agent: other\\nDisallow: /fr/\\nAllow: /fr/*?page\\nDisallow: /de/*.html$\\n',"
            " CASE WHEN length(host) % 5 = 0 THEN 'License: https://example.org/l.xml\\n' ELSE '' END) AS text",
        )
