"""Queries over what writers of logs check and make, and over functions of single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import web
from tidemark.operators import acquire, producers, scoring
from tidemark.sources.tables import Tables

from .registry import query

_KNOWN = "SELECT 'a' || doc_id AS artifact_id FROM documents"


@query(
    """SELECT doc_id AS seq, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'thesis ' || doc_id END AS thesis, 'hyp_' || substr(sha256(CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'thesis ' || doc_id END), 1, 12) AS hypothesis_id,
 CASE WHEN doc_id % 9 = 0 THEN 'empty thesis' WHEN doc_id % 7 = 0 THEN 'unknown stakes' WHEN doc_id % 5 = 0 THEN 'unknown mode' END AS violation FROM documents"""
)
def hypothesis_rows(t: Tables) -> DataFrame:
    made = t.raw("documents").selectExpr("doc_id AS seq", "CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE concat('thesis ', doc_id) END AS thesis", "CASE WHEN doc_id % 7 = 0 THEN 'urgent' ELSE 'high' END AS stakes", "CASE doc_id % 5 WHEN 0 THEN 'guess' WHEN 1 THEN NULL ELSE 'debunk' END AS mode")
    return producers.hypothesis_rows(made).select("seq", "thesis", "hypothesis_id", "violation")


@query(
    """SELECT prediction_id, violation FROM (SELECT doc_id AS prediction_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'confidence out of range' WHEN doc_id % 11 = 0 THEN 'deadline is no date' WHEN doc_id % 7 = 0 THEN 'unknown anchor' END AS violation FROM documents) WHERE violation IS NOT NULL"""
)
def prediction_violations(t: Tables) -> DataFrame:
    made = t.raw("documents").selectExpr(
        "doc_id AS prediction_id", "CASE WHEN doc_id % 13 = 0 THEN 1.2D WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id % 101) / 100D END AS stated_confidence", "CASE WHEN doc_id % 11 = 0 THEN 'soon' ELSE '2025-03-01' END AS resolve_by",
        "CASE WHEN doc_id % 7 = 0 THEN 'zz' WHEN doc_id % 3 = 0 THEN '' ELSE concat('a', doc_id) END AS anchor_artifact_id",
    )
    return producers.prediction_violations(made, t.artifacts())


@query("SELECT doc_id AS seq, CASE WHEN doc_id % 19 = 0 THEN 'unknown artifact' ELSE 'no date' END AS violation FROM documents WHERE doc_id % 19 = 0 OR doc_id % 23 = 0")
def pubdate_violations(t: Tables) -> DataFrame:
    made = t.raw("documents").selectExpr("doc_id AS seq", "CASE WHEN doc_id % 19 = 0 THEN 'zz' ELSE concat('a', doc_id) END AS artifact_id", "CASE WHEN doc_id % 23 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS published_at")
    return producers.pubdate_violations(made, t.artifacts())


@query("SELECT doc_id AS seq, CASE WHEN doc_id % 23 = 0 THEN 'truth empty' ELSE 'unknown artifact' END AS violation FROM documents WHERE doc_id % 19 = 0 OR doc_id % 23 = 0")
def measure_violations(t: Tables) -> DataFrame:
    made = t.raw("documents").selectExpr("doc_id AS seq", "CASE WHEN doc_id % 19 = 0 THEN 'zz' ELSE concat('a', doc_id) END AS artifact_id", "CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 'x' END AS truth")
    return producers.measure_violations(made, t.artifacts())


@query("SELECT source AS goal, min(doc_id) AS seq, 'r_' || substr(sha256(source), 1, 10) AS slug FROM documents GROUP BY source")
def research_rows(t: Tables) -> DataFrame:
    return producers.research_rows(t.raw("documents").select(F.col("source").alias("goal"), F.col("doc_id").alias("seq")))


@query(
    """SELECT doc_id AS prediction_id, CASE WHEN doc_id % 4 = 0 THEN false ELSE doc_id % 17 <> 0 AND doc_id % 3 = 0 END AS anchored, CASE WHEN doc_id % 19 = 0 THEN 'unknown prediction' WHEN doc_id % 5 = 0 THEN 'unknown outcome' END AS violation FROM labels JOIN documents USING (doc_id)"""
)
def resolution_rows(t: Tables) -> DataFrame:
    made = t.predictions().selectExpr("prediction_id", "CASE WHEN prediction_id % 5 = 0 THEN 'maybe' ELSE 'hit' END AS outcome", "CASE WHEN prediction_id % 4 = 0 THEN '' ELSE concat('a', prediction_id) END AS evidence_artifact")
    return producers.resolution_rows(made, t.predictions().filter("prediction_id % 19 != 0"), t.findings()).select("prediction_id", "anchored", "violation")


@query(
    """WITH old AS (SELECT c_custkey AS ord, 'channel' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), new AS (SELECT user_id AS id, min(event_id) AS ord, arg_min(event_type, event_id) AS kind FROM events WHERE user_id NOT IN (SELECT id FROM old) GROUP BY 1)
 SELECT ord, kind, id FROM (SELECT * FROM old UNION ALL SELECT ord + (SELECT coalesce(max(ord), -1) FROM old) + 1, kind, id FROM new) WHERE id % 7 <> 0"""
)
def watch_list(t: Tables) -> DataFrame:
    old = t.raw("customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey AS ord", "'channel' AS kind", "c_custkey AS id")
    new = t.raw("events").selectExpr("event_id AS ord", "event_type AS kind", "user_id AS id")
    gone = t.raw("events").select(F.col("user_id").alias("id")).unionByName(old.select("id")).filter("id % 7 = 0").distinct()
    return producers.watch(old, new, gone)


@query("SELECT CAST(p_partkey AS VARCHAR) AS task_id, p_name AS question FROM part")
def blind_cards(t: Tables) -> DataFrame:
    return scoring.blind(t.cards().join(t.raw("part").selectExpr("cast(p_partkey AS string) AS task_id", "p_name AS question"), "task_id"))


@query("SELECT page_id, page_id % 5 = 0 AS parse_failed, CASE WHEN page_id % 5 = 0 THEN 0 ELSE (len(html) - len(replace(html, '<p>', ''))) // 3 END AS n_rows FROM pages")
def parsed_pages(t: Tables) -> DataFrame:
    """A parser of the caller's that counts paragraphs, and fails on some pages."""

    def paragraphs(page: int, html: str) -> list[dict]:
        if page % 5 == 0:
            raise ValueError(page)
        return [{"i": i} for i in range(html.count("<p>"))]

    return acquire.parsed(t.raw("pages"), paragraphs, "i: int", "page_id", "html").select("page_id", "parse_failed", "n_rows")


# Functions of single values, on values made of the customers' keys and names.

_NAMED = "SELECT c_custkey AS k, c_name AS name, substr(sha256(c_name), 1, 11) AS v FROM customer"


@query(
    f"""WITH c AS ({_NAMED}), ip AS (SELECT k, k % 256 AS a, k * 7 % 256 AS b, k * 13 % 256 AS d FROM c)
 SELECT k, 'video' AS f, CASE k % 3 WHEN 0 THEN 'https://youtu.be/' || v WHEN 1 THEN 'https://www.youtube.com/watch?v=' || v || '&t=1' ELSE name END AS x, CASE WHEN k % 3 < 2 THEN v END AS y FROM c
 UNION ALL SELECT k, 'closed', a || '.' || b || '.' || d || '.1', CAST(a IN (0, 10, 127) OR a >= 224 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND (b = 168 OR b = 0 AND d IN (0, 2)) OR a = 198 AND (b IN (18, 19) OR b = 51 AND d = 100) OR a = 203 AND b = 0 AND d = 113 AS VARCHAR) FROM ip
 UNION ALL SELECT k, 'path', '/' || CASE k % 3 WHEN 0 THEN 'etc/' WHEN 1 THEN 'home/../etc/' ELSE 'home/' END || name, CAST(k % 3 = 2 AS VARCHAR) FROM c
 UNION ALL SELECT k, 'scrubbed', 'key=' || name || '&x', 'key=***&x' FROM c
 UNION ALL SELECT k, 'abstains', CASE WHEN k % 2 = 0 THEN ' Unknown ' ELSE name END, CAST(k % 2 = 0 AS VARCHAR) FROM c
 UNION ALL SELECT k, 'abstains', CASE WHEN k % 2 = 0 THEN '모름' ELSE 'not found' END, CAST(k % 2 = 0 AS VARCHAR) FROM c
 UNION ALL SELECT k, 'video', v, v FROM c UNION ALL SELECT k, 'path', 'refs/' || name || '.html', 'true' FROM c
 UNION ALL SELECT k, 'closed', CASE k % 3 WHEN 0 THEN '::1' WHEN 1 THEN '' ELSE 'h' || k || '.example.com' END, CAST(k % 3 < 2 AS VARCHAR) FROM c
 UNION ALL SELECT k, 'host', CASE k % 5 WHEN 0 THEN 'https://www.news.x' || k || '.co.uk/' WHEN 1 THEN 'http://10.0.0.' || k % 256 || '/' WHEN 2 THEN 'http://a' || k || '.com.mx' WHEN 3 THEN 'http://[2001:0db8:0:0:0:0:0:' || k % 9 + 1 || ']:80/x' ELSE name END,
  CASE k % 5 WHEN 0 THEN 'x' || k || '.co.uk' WHEN 1 THEN '10.0.0.' || k % 256 WHEN 2 THEN 'a' || k || '.com.mx' WHEN 3 THEN '2001:db8::' || k % 9 + 1 ELSE '' END FROM c
 UNION ALL SELECT k, 'number', CASE k % 5 WHEN 0 THEN 'costs ' || d || ',234 won' WHEN 1 THEN '-' || d || ' then 6' WHEN 2 THEN d || ',2,3' WHEN 3 THEN d || 'e3 m' ELSE 'none' END, CASE k % 5 WHEN 0 THEN d || '234.0' WHEN 1 THEN '-' || d || '.0' WHEN 2 THEN d || '.0' WHEN 3 THEN d || '000.0' END FROM (SELECT k, k % 9 + 1 AS d FROM c)
 UNION ALL SELECT k, 'date', CASE k % 3 WHEN 0 THEN ' 2024-' || k % 9 + 1 || '-1 ' WHEN 1 THEN '2024-06-01T00:0' || k % 10 ELSE '2024-02-30' END, CASE WHEN k % 3 = 0 THEN '2024-0' || k % 9 + 1 || '-01' END FROM c
 UNION ALL SELECT k, 'begins', CASE WHEN k % 2 = 0 THEN '2024-06-0' || k % 9 + 1 || 'T00:00' ELSE '2024-02-30' END, CASE WHEN k % 2 = 0 THEN '2024-06-0' || k % 9 + 1 END FROM c
 UNION ALL SELECT k, 'status', CASE k % 3 WHEN 0 THEN 'oops' WHEN 1 THEN '404' ELSE '200' END, CASE k % 3 WHEN 0 THEN 'suspect' WHEN 1 THEN 'http_error' ELSE 'weak_ok' END FROM c
 UNION ALL SELECT k, 'stamp', CASE k % 3 WHEN 0 THEN '[ALPHA] ' || name || ' [RECON]' WHEN 1 THEN name || ' [RECON]' ELSE '[RECON: ' || name || ']' END, CASE k % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'RECON' ELSE 'unlabeled' END FROM c"""
)
def known_values(t: Tables) -> DataFrame:
    """Ids in addresses, closed hosts, paths, secrets in messages, abstentions, hosts, numbers, dates, verdicts by status and stamps, whose results follow from how they are made."""
    c = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.substring(F.sha2("c_name", 256), 1, 11).alias("v"), (F.col("c_custkey") % 9 + 1).alias("d"))
    status = lambda x: web.softblock(F.repeat(F.lit("x"), 4000), x, F.lit(None).cast("boolean"), F.lit(False))
    made = [
        ("video", "CASE k % 3 WHEN 0 THEN concat('https://youtu.be/', v) WHEN 1 THEN concat('https://www.youtube.com/watch?v=', v, '&t=1') ELSE name END", producers.video_id), ("video", "v", producers.video_id),
        ("closed", "concat_ws('.', k % 256, k * 7 % 256, k * 13 % 256, 1)", web.closed_host), ("closed", "CASE k % 3 WHEN 0 THEN '::1' WHEN 1 THEN '' ELSE concat('h', k, '.example.com') END", web.closed_host),
        ("path", "concat('/', CASE k % 3 WHEN 0 THEN 'etc/' WHEN 1 THEN 'home/../etc/' ELSE 'home/' END, name)", web.open_path), ("path", "concat('refs/', name, '.html')", web.open_path),
        ("scrubbed", "concat('key=', name, '&x')", lambda x: producers.scrubbed(x, F.col("name"))), ("abstains", "if(k % 2 = 0, ' Unknown ', name)", scoring.abstains), ("abstains", "if(k % 2 = 0, '모름', 'not found')", scoring.abstains),
        ("host", "CASE k % 5 WHEN 0 THEN concat('https://www.news.x', k, '.co.uk/') WHEN 1 THEN concat('http://10.0.0.', k % 256, '/') WHEN 2 THEN concat('http://a', k, '.com.mx') WHEN 3 THEN concat('http://[2001:0db8:0:0:0:0:0:', d, ']:80/x') ELSE name END", web.registrable),
        ("number", "CASE k % 5 WHEN 0 THEN concat('costs ', d, ',234 won') WHEN 1 THEN concat('-', d, ' then 6') WHEN 2 THEN concat(d, ',2,3') WHEN 3 THEN concat(d, 'e3 m') ELSE 'none' END", tx.first_number),
        ("date", "CASE k % 3 WHEN 0 THEN concat(' 2024-', d, '-1 ') WHEN 1 THEN concat('2024-06-01T00:0', k % 10) ELSE '2024-02-30' END", web.strict_date), ("begins", "CASE WHEN k % 2 = 0 THEN concat('2024-06-0', d, 'T00:00') ELSE '2024-02-30' END", web.date_of),
        ("status", "CASE k % 3 WHEN 0 THEN 'oops' WHEN 1 THEN '404' ELSE '200' END", status), ("stamp", "CASE k % 3 WHEN 0 THEN concat('[ALPHA] ', name, ' [RECON]') WHEN 1 THEN concat(name, ' [RECON]') ELSE concat('[RECON: ', name, ']') END", producers.run_stamp),
    ]
    parts = [c.select("k", F.lit(f).alias("f"), F.expr(x).alias("x"), of(F.expr(x)).cast("string").alias("y")) for f, x, of in made]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 AS hosts, s_suppkey % 4 AS sources, s_suppkey % 7 / 4 AS dup, CASE s_suppkey % 4 WHEN 0 THEN '["typo"]' WHEN 1 THEN '["traceability"]' WHEN 2 THEN 'breadth' ELSE '["breadth"]' END AS fatal FROM supplier)
 SELECT CAST(k AS VARCHAR) AS standard_id, concat_ws(',', CASE WHEN hosts > sources THEN 'volume_bar_incoherent' END, CASE WHEN k % 4 = 2 THEN 'fatal_domains_not_list' WHEN k % 4 = 0 THEN 'fatal_domains_unknown' WHEN k % 4 = 1 THEN 'fatal_set_trivial' END, CASE WHEN NOT (dup > 0 AND dup <= 1) THEN 'dup_similarity_range' END) AS warnings FROM s"""
)
def standard_warnings(t: Tables) -> DataFrame:
    fatal = "CASE s_suppkey % 4 WHEN 0 THEN '[\"typo\"]' WHEN 1 THEN '[\"traceability\"]' WHEN 2 THEN 'breadth' ELSE '[\"breadth\"]' END AS fatal_domains"
    made = t.raw("supplier").selectExpr("cast(s_suppkey AS string) AS standard_id", "s_suppkey % 5 AS min_distinct_hosts", "s_suppkey % 4 AS min_independent_sources", "s_suppkey % 7 / 4D AS dup_similarity", fatal, "cast(NULL AS string) AS required_modalities")
    return producers.standard_warnings(made)


@query(
    """WITH daily AS (SELECT event_type AS region, date_trunc('day', CAST(ts AS TIMESTAMP)) AS d, user_id AS id, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL)
 SELECT region, CAST(CAST(d AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY region, d ORDER BY cents DESC, id) AS rank, id FROM daily"""
)
def chart_rows(t: Tables) -> DataFrame:
    """Each day's chart as the payload that a caller would hand over, and its rows by place."""
    daily = t.events().groupBy(F.col("event_type").alias("region"), F.date_trunc("day", "ts").alias("at"), F.col("user_id").alias("id")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    payload = daily.groupBy("region", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cents")).alias("c"), "id"))), lambda x: x["id"]).alias("items"))
    return producers.chart_rows(payload).select("region", F.col("at").cast("date").cast("string").alias("day"), "rank", F.col("item").alias("id"))
