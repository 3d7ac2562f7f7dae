"""Queries over what readers make of files, and over transcripts, frames and sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gates, ledger, media
from tidemark.sources import commits, jsonl, lines, transcripts
from tidemark.sources.tables import Tables
from tidemark.streaming import logs

from . import registry
from . import sql as q
from .registry import query

ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 > 1"


@query(ORDERS)
def read_lines(t: Tables) -> DataFrame:
    """Lines written to files and read again; some are torn or blank."""
    line = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")))
    torn = F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 9)).when(F.col("o_orderkey") % 10 == 1, " ").otherwise(line)
    return jsonl.read_lines(t.spark, t.spooled(t.raw("orders").select(torn.alias("value"))), "k long, c long, p string").select("k", "c", "p")


@query("SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS answer FROM part")
def read_results(t: Tables) -> DataFrame:
    """A map of answers in one file for each part; a null answer stays."""
    answer = F.when(F.col("p_partkey") % 3 != 0, F.to_json(F.struct(F.col("p_brand").alias("x")))).otherwise('{"x":null}')
    value = F.concat(F.lit('{"'), F.col("p_partkey").cast("string"), F.lit('"'), F.regexp_replace(answer, '^\\{"x"', ""))
    return jsonl.read_maps(t.spark, t.spooled(t.raw("part").select(value.alias("value"))))


def _files(t: Tables, head: str = "", tail: str = "", every: int = 1) -> str:
    """A file for each nation, of a JSON list of its suppliers; every so many of them within an object."""
    each = F.to_json(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
    lists = t.raw("supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", each.alias("j")))).alias("xs"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["j"]), ",\n"), F.lit("]"))
    return t.spooled_by(lists.select("n", F.when(F.col("n") % every == 0, F.concat(F.lit(head), listed, F.lit(tail))).otherwise(listed).alias("value")), "n")


_SUPPLIERS = "SELECT s_suppkey AS k, s_name AS name FROM supplier"


@query(_SUPPLIERS)
def read_array(t: Tables) -> DataFrame:
    return jsonl.read_array(t.spark, _files(t), "k long, name string")


@query(_SUPPLIERS)
def read_cards(t: Tables) -> DataFrame:
    """Lists, and objects that hold one, by turns."""
    return jsonl.read_cards(t.spark, _files(t, '{"cards": ', "}", 2), "k long, name string")


@query("SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, s_suppkey AS k, s_name AS name FROM supplier")
def read_registry(t: Tables) -> DataFrame:
    return jsonl.read_registry(t.spark, _files(t, '{"x": [1], "records": ', ', "y": [2]}'), "k long, name string")


def _talk(t: Tables, line: Column, key: str = "conv_id") -> DataFrame:
    """One text for each conversation, of a line for each of its turns."""
    turns = t.raw("conversations").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    texts = turns.groupBy(F.col(key).alias("transcript_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return texts.select("transcript_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


_SAID = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(f"SELECT conv_id AS transcript_id, CAST(turn * 60 + 30 AS DOUBLE) AS \"start\", CAST(turn * 60 + 60 AS DOUBLE) AS \"end\", {_SAID} AS text FROM conversations")
def parse_timed(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(":30 -> "), (F.col("turn") + 1).cast("string"), F.lit(":00] "), "text")
    return transcripts.parse_timed(_talk(t, line)).drop("idx")


@query("SELECT DISTINCT conv_id AS transcript_id, CASE conv_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'EXTRACT_FAILED' WHEN 2 THEN 'COVERAGE_GAP' ELSE 'UNKNOWN' END AS quality_label FROM conversations")
def transcript_quality(t: Tables) -> DataFrame:
    head = F.expr("CASE conv_id % 4 WHEN 0 THEN '# x gate=OK\\n' WHEN 1 THEN '# FAILED\\n' WHEN 2 THEN '# FAILED gate=SILENT\\n# gate=COVERAGE_GAP\\n' ELSE '' END")
    return transcripts.quality_label(t.raw("conversations").groupBy("conv_id").agg(F.count("*")).select(F.col("conv_id").alias("transcript_id"), F.concat(head, F.lit("[00:01 -> 00:02] x")).alias("content")))


@query(
    f"""WITH ls AS (SELECT conv_id, turn, {_SAID} AS x FROM conversations), good AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM ls WHERE x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->'))
 SELECT conv_id AS transcript_id, string_agg(x, ' ' ORDER BY turn) AS text FROM good WHERE b IS NULL OR b <> x GROUP BY 1"""
)
def subrip_text(t: Tables) -> DataFrame:
    """SubRip texts in which every line stands twice."""
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), "text", F.lit("\n\n9\n00:00:02,000 --> 00:00:03,000\n"), "text", F.lit("\n"))
    return transcripts.plain_text(_talk(t, block))


@query(
    """WITH cues AS (SELECT conv_id, turn, text, turn * 5000 AS a, turn * 5000 + length(text) % 50 * 100 AS b FROM conversations),
 shown AS (SELECT conv_id, turn, printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS cue FROM cues)
 SELECT conv_id AS transcript_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) ORDER BY turn) AS content FROM shown GROUP BY 1"""
)
def webvtt(t: Tables) -> DataFrame:
    return transcripts.to_vtt(t.segments())


@query(f"SELECT conv_id AS transcript_id, CAST(turn AS DOUBLE) * 5 AS \"start\", trim(regexp_replace(text, '[ \t\x0B\f]*\n[ \t\n\x0B\f\r]*', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''")
def parse_cues(t: Tables) -> DataFrame:
    """What the reader of cue blocks makes of the texts that the writer made."""
    return transcripts.parse_timed(transcripts.to_vtt(t.segments())).select("transcript_id", "start", "text")


@query(
    """SELECT conv_id AS transcript_id, -1 AS idx, '# talk ' || conv_id AS line FROM conversations GROUP BY ALL
 UNION ALL SELECT conv_id, turn, printf('[%8.2f --> %8.2f] ', turn * 5.0, turn * 5.0 + length(text) % 50 / 10.0) || trim(text) FROM conversations"""
)
def transcript_lines(t: Tables) -> DataFrame:
    return transcripts.transcript_lines(t.segments(), F.concat(F.lit("talk "), F.col("transcript_id").cast("string")))


@query("SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, regexp_replace(text, '\r\n|[\r\n]', ' ', 'g') AS line FROM conversations")
def ordered_lines(t: Tables) -> DataFrame:
    """All turns of all conversations written as lines of ordered files, and read again with their numbers."""
    path = t.spool()
    lines.write_lines(t.raw("conversations"), ["conv_id", "turn"], "text", path)
    return lines.read_ordered(t.spark, path)


_DOCUMENT = f"""WITH d AS ({q.DIGEST}), n AS (SELECT section, count(*) FILTER (ord <> '') AS n FROM d GROUP BY 1), every AS (SELECT '0-title' AS section, '' AS ord, '# RESEARCH DIGEST: corpus' AS line
 UNION ALL SELECT section, ' ', '## ' || substr(section, 3) || ' (' || n || ')' FROM n UNION ALL SELECT section, '-' || ord, '- ' || regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g') FROM d)"""


@query(f"{_DOCUMENT} SELECT row_number() OVER (ORDER BY section, ord) AS line_no, line FROM every")
def digest_file(t: Tables) -> DataFrame:
    """The digest as a file: written in order over many parts, and read again line for line."""
    path = t.spool()
    lines.write_lines(ledger.digest_document(registry.digest(t), "corpus"), ["section", "ord"], "line", path)
    return lines.read_ordered(t.spark, path)


@query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def read_log(t: Tables) -> DataFrame:
    """Orders written to logs, and put in the order of the logs' bytes."""
    path = t.spool()
    lines.write_lines(t.raw("orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("line")), ["o_orderkey"], "line", path)
    placed = lines.numbered(lines.lines_at(t.spark, path), ["file", "offset"], "place")
    return placed.select(F.from_json("line", "k long")["k"].alias("k"), "place")


@query("SELECT k, min(seq) AS seq, arg_min(v, seq) AS v FROM (SELECT c_custkey AS k, c_custkey AS seq, 'customer' AS v FROM customer UNION ALL SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END, 1000000000 + o_orderkey, 'order' FROM orders) GROUP BY k")
def committed_once(t: Tables) -> DataFrame:
    """A table that two writers append to, one of them twice: every key once, as whoever came first had it."""
    path = t.spool()
    customers = t.raw("customer").selectExpr("c_custkey AS k", "c_custkey AS seq", "'customer' AS v")
    orders = t.raw("orders").selectExpr("o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS k", "1000000000 + o_orderkey AS seq", "'order' AS v")
    for writer, rows in (("a", customers), ("b", orders), ("a", customers), ("b", orders)):
        commits.append_once(rows, path, ["k"], "seq", writer, 0)
    return commits.read_once(t.spark, path)


@query(
    """WITH cues AS (SELECT conv_id, turn, text, turn * 5000 AS a, turn * 5000 + length(text) % 50 * 100 AS b FROM conversations),
 shown AS (SELECT *, printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS s FROM cues)
 SELECT conv_id AS transcript_id, turn AS idx, p AS part, CASE p WHEN 0 THEN s WHEN 1 THEN regexp_replace(text, '\r\n|[\r\n]', ' ', 'g') ELSE '' END AS line FROM shown, range(0, 3) r(p)
 UNION ALL SELECT conv_id, min(turn) - 1, p, CASE p WHEN 0 THEN 'WEBVTT' ELSE '' END FROM conversations, range(0, 2) r(p) GROUP BY conv_id, p"""
)
def vtt_lines(t: Tables) -> DataFrame:
    return transcripts.vtt_lines(t.segments())


@query(
    """WITH p AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), snaps AS (SELECT '2024-01-01' AS at_, 0 AS seq UNION ALL SELECT '2024-01-02', 1)
 SELECT c_custkey AS id, n, n IS NULL AS missing, at_ AS "at", seq FROM customer LEFT JOIN p ON id = c_custkey, snaps"""
)
def snapshot_appends(t: Tables) -> DataFrame:
    """Two scheduled snapshots of the watched items, of which one has run twice."""
    payload = t.raw("events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    watched, path = t.raw("customer").select(F.col("c_custkey").alias("id")), t.spool()
    for at, number in (("2024-01-01", 0), ("2024-01-01", 0), ("2024-01-02", 1)):
        logs.append_snapshot(watched, payload, path, at, number)
    return commits.read_once(t.spark, path)


# Transcripts


_KEY = "regexp_replace(lower(text), '[^가-힣a-z0-9]', '', 'g')"


@query("SELECT conv_id, turn, text FROM conversations WHERE NOT (text = 'Thanks for watching.') AND " + _KEY + " <> 'thanks'")
def strip_boilerplate(t: Tables) -> DataFrame:
    return media.strip_boilerplate(t.raw("conversations").select("conv_id", "turn", "text"), ["Thanks for watching!", "thanks"])


@query("SELECT transcript_id, idx, text FROM (SELECT conv_id // 3 AS transcript_id, conv_id * 100 + turn AS idx, role AS text, lag(role) OVER (PARTITION BY conv_id // 3 ORDER BY conv_id * 100 + turn) AS b FROM conversations) WHERE b IS NULL OR b <> text")
def collapse_repeats(t: Tables) -> DataFrame:
    return media.collapse_repeats(t.raw("conversations").selectExpr("conv_id div 3 AS transcript_id", "conv_id * 100 + turn AS idx", "role AS text"))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, m FROM conversations, (VALUES (0), (1), (2)) v(m)), s AS (SELECT conv_id AS transcript_id, conv_id * (m + 3) % 5 = 0 AS degenerate, (conv_id * (m + 7) % 100) / 100 AS coverage_ratio, m = 2 AS is_strong, 'm' || m AS model FROM c)
 SELECT transcript_id, degenerate, coverage_ratio, is_strong, model FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY degenerate, round(coverage_ratio, 1) DESC, is_strong DESC, model) AS r FROM s) WHERE r = 1"""
)
def best_of(t: Tables) -> DataFrame:
    clips = t.raw("conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, range(3)))).alias("m"))
    return media.best_of(clips.selectExpr("conv_id AS transcript_id", "conv_id * (m + 3) % 5 = 0 AS degenerate", "(conv_id * (m + 7) % 100) / 100D AS coverage_ratio", "m = 2 AS is_strong", "concat('m', m) AS model"))


# Frames


@query(
    """WITH p AS (SELECT doc_id % 7 AS clip, doc_id AS idx, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 7) AS n FROM documents)
 SELECT clip, idx FROM p WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda k: CAST(floor(k * (n / 12)) AS BIGINT)), i)"""
)
def thinned_frames(t: Tables) -> DataFrame:
    return media.thin(t.raw("documents").selectExpr("doc_id % 7 AS clip", "doc_id AS idx"), 12, "clip", "idx")


@query(
    """WITH good AS (SELECT conv_id, turn, string_split_regex(text, '[^A-Za-z]+') AS ws FROM conversations WHERE turn % 10 >= 2 AND length(trim(text)) >= 2),
 each AS (SELECT conv_id, turn, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM good), firsts AS (SELECT conv_id, arg_min(term, (turn, p)) AS term, min((turn, p)) AS f FROM each WHERE length(term) >= 2 GROUP BY conv_id, lower(term))
 SELECT conv_id AS clip, term, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS ord FROM firsts"""
)
def ocr_terms(t: Tables) -> DataFrame:
    return media.ocr_terms(t.raw("conversations").selectExpr("conv_id AS clip", "turn AS idx", "text", "(turn % 10) / 4D AS confidence"))


_PIXELS = "SELECT l_partkey % 10 AS clip, l_linenumber AS frame, CAST(l_orderkey * 7 % 256 AS INTEGER) AS r, CAST(l_linenumber * 30 AS INTEGER) AS g, CAST(l_suppkey * 3 % 256 AS INTEGER) AS b FROM lineitem"


def _pixels(t: Tables) -> DataFrame:
    return t.raw("lineitem").selectExpr("l_partkey % 10 AS clip", "l_linenumber AS frame", "cast(l_orderkey * 7 % 256 AS int) AS r", "cast(l_linenumber * 30 AS int) AS g", "cast(l_suppkey * 3 % 256 AS int) AS b")


@query(
    f"""WITH px AS ({_PIXELS}), grid AS (SELECT clip, r // 32 * 32 + 16 AS r, g // 32 * 32 + 16 AS g, b // 32 * 32 + 16 AS b, count(*) AS n FROM px GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, r, g, b) AS rank, round(n / sum(n) OVER (PARTITION BY clip), 4) AS weight FROM grid)
 SELECT clip, rank, printf('#%02x%02x%02x', r, g, b) AS colour, weight FROM ranked WHERE rank <= 6"""
)
def palette(t: Tables) -> DataFrame:
    return media.palette(_pixels(t))


@query(
    f"""WITH px AS ({_PIXELS}), c AS (SELECT clip, frame, greatest(r, g, b) AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE floor((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) * 255) END AS s FROM px),
 frames AS (SELECT clip, frame, avg(v) AS v, avg(s) AS s, stddev_pop(v) AS d FROM c GROUP BY ALL)
 SELECT clip, count(*) AS frames, round(avg(v), 1) AS brightness, round(avg(s), 1) AS saturation, round(avg(d), 1) AS contrast FROM frames GROUP BY clip"""
)
def colour_statistics(t: Tables) -> DataFrame:
    return media.colour_statistics(_pixels(t))


@query(
    f"""WITH px AS ({_PIXELS}), c AS (SELECT clip, frame, greatest(r, g, b) AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE floor((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) * 255) END AS s FROM px),
 frames AS (SELECT clip, frame, avg(v) AS v, avg(s) AS s, stddev_pop(v) AS d FROM c GROUP BY ALL), grid AS (SELECT clip, r // 32 * 32 + 16 AS r, g // 32 * 32 + 16 AS g, b // 32 * 32 + 16 AS b, count(*) AS n FROM px GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, r, g, b) AS rank, round(n / sum(n) OVER (PARTITION BY clip), 4) AS weight FROM grid),
 colours AS (SELECT clip, string_agg(printf('#%02x%02x%02x', r, g, b) || ':' || round(weight, 3), ' ' ORDER BY rank) AS palette FROM ranked WHERE rank <= 6 GROUP BY clip)
 SELECT clip, count(*) AS frames, round(avg(v), 1) AS brightness, round(avg(s), 1) AS saturation, round(avg(d), 1) AS contrast, any_value(palette) AS palette FROM frames JOIN colours USING (clip) GROUP BY clip"""
)
def colour_report(t: Tables) -> DataFrame:
    return media.colour_report(_pixels(t))


#: Each document as a frame of its source's clip: the codes of 64 of its letters stand for brightness.
_LUMAS = "SELECT source AS clip, doc_id AS idx, i, coalesce(unicode(nullif(substr(text, i * 3 + 20, 1), '')), 0) AS luma FROM documents, range(0, 64) x(i)"
_HASHES = f"l AS ({_LUMAS}), m AS (SELECT clip, idx, avg(luma) AS m FROM l GROUP BY ALL), h AS (SELECT clip, idx, sum(CASE WHEN luma > m THEN CASE WHEN i = 63 THEN -9223372036854775808 ELSE 1::BIGINT << i END ELSE 0 END)::BIGINT AS hash FROM l JOIN m USING (clip, idx) GROUP BY ALL)"


def _hashes(t: Tables) -> DataFrame:
    lumas = t.raw("documents").select("source", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return media.average_hash(lumas.selectExpr("source AS clip", "doc_id AS idx", "i", "coalesce(ascii(nullif(substring(text, i * 3 + 20, 1), '')), 0) AS luma"))


@query(f"WITH {_HASHES} SELECT clip, idx, hash FROM h")
def average_hash(t: Tables) -> DataFrame:
    return _hashes(t)


@query(
    f"""WITH RECURSIVE {_HASHES}, p AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS r FROM h), kept AS (SELECT clip, r, [hash] AS hs, idx, hash, true AS ok FROM p WHERE r = 1
 UNION ALL SELECT p.clip, p.r, CASE WHEN near THEN hs ELSE list_append(hs, p.hash) END, p.idx, p.hash, NOT near FROM (SELECT p.*, hs, len(list_filter(hs, lambda x: bit_count(xor(x, p.hash)) <= 4)) > 0 AS near FROM kept JOIN p ON p.clip = kept.clip AND p.r = kept.r + 1) p)
 SELECT clip, idx, hash FROM kept WHERE ok"""
)
def kept_frames(t: Tables) -> DataFrame:
    """The frames of all clips; the hashes come from the operator before."""
    return media.kept_frames(_hashes(t)).select("clip", "idx", "hash")


@query("SELECT l_suppkey AS clip, round(sqrt(avg((l_discount - 0.05) * (l_discount - 0.05))), 9) AS rms FROM lineitem GROUP BY 1")
def loudness(t: Tables) -> DataFrame:
    return media.loudness(t.raw("lineitem").selectExpr("l_suppkey AS clip", "cast(l_discount AS double) - 0.05D AS sample")).withColumn("rms", F.round("rms", 9))


# Documents with a front matter


def _skills(t: Tables) -> DataFrame:
    """Documents with dates plain, in quotes, with one digit, with a time, or none; some marked as dated only."""
    date = "date_format(date_add(date'2024-01-01', cast(length(text) % 200 AS int)), if(doc_id % 7 = 2, 'yyyy-M-d', 'yyyy-MM-dd'))"
    stamp = f"CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '\\nlast_verified: soon' WHEN 3 THEN concat('\\nlast_verified: \"', {date}, '\"') WHEN 4 THEN concat('\\nlast_verified: ', {date}, 'T00:00') ELSE concat('\\nlast_verified: ', {date}) END"
    by = "CASE doc_id % 5 WHEN 0 THEN '\\nverified_by: date-stamp-unverified' WHEN 1 THEN '\\nverified_by: \"reviewer\"' ELSE '' END"
    return t.raw("documents").selectExpr("concat('p', doc_id) AS path", f"CASE WHEN doc_id % 11 = 0 THEN text ELSE concat('---\\nname: d', doc_id, coalesce({stamp}, ''), {by}, '\\n  last_verified: 2024-05-01\\n---\\n', text) END AS content")


_STATES = """s AS (SELECT doc_id, text, DATE '2024-01-01' + CAST(length(text) % 200 AS INTEGER) AS day, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 OR text IS NULL THEN 'missing' WHEN doc_id % 7 IN (1, 4) THEN 'invalid-date' END AS bad FROM documents),
 judged AS (SELECT *, CASE WHEN bad IS NULL THEN date_diff('day', day, DATE '2024-05-01') END AS age FROM s), states AS (SELECT *, coalesce(bad, CASE WHEN age >= 30 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'stamped-unverified' ELSE 'fresh' END) AS state FROM judged)"""


@query(f"WITH {_STATES} SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'd' || doc_id END AS name, age AS age_days, state FROM states")
def skill_staleness(t: Tables) -> DataFrame:
    return gates.skill_staleness(_skills(t), "2024-05-01")


@query(f"""WITH {_STATES} SELECT count(*) FILTER (state <> 'fresh') = 0 AS passed, count(*) AS checked, count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'missing') AS missing,
 count(*) FILTER (state = 'invalid-date') AS invalid_date, count(*) FILTER (state = 'stamped-unverified') AS stamped_unverified FROM states""")  # fmt: skip
def staleness_gate(t: Tables) -> DataFrame:
    return gates.staleness_gate(gates.skill_staleness(_skills(t), "2024-05-01"), strict=True)


@query(f"WITH {_STATES} SELECT 'p' || doc_id AS path, CASE WHEN state IN ('missing', 'invalid-date', 'stale') THEN 'stamped-unverified' ELSE state END AS state FROM states")
def skill_restamped(t: Tables) -> DataFrame:
    """The states of documents once those that fail are dated: none of them passes for verified."""
    return gates.skill_staleness(gates.restamped(_skills(t), "2024-05-01"), "2024-05-01").select("path", "state")


@query("SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'no block' ELSE '---' || chr(10) || 'name: d' || doc_id || chr(10) || 'last_verified: 2024-05-01' || chr(10) || '---' || chr(10) || text END AS content FROM documents")
def skill_stamped(t: Tables) -> DataFrame:
    stamp = "CASE doc_id % 6 WHEN 0 THEN '' ELSE '\\nlast_verified: soon' END"
    files = t.raw("documents").selectExpr("concat('p', doc_id) AS path", f"CASE WHEN doc_id % 11 = 0 THEN 'no block' ELSE concat('---\\nname: d', doc_id, {stamp}, '\\n---\\n', text) END AS content")
    return gates.with_field(files, "last_verified", F.lit("2024-05-01"))


@query("SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'write' ELSE 'same' END AS action FROM documents UNION ALL SELECT 'q' || doc_id, 'prune' FROM documents WHERE doc_id % 13 = 0")
def mirror_drift(t: Tables) -> DataFrame:
    ours = t.raw("documents").selectExpr("concat('p', doc_id) AS path", "text AS content")
    theirs = t.raw("documents").filter("doc_id % 5 != 0").selectExpr("concat('p', doc_id) AS path", "CASE WHEN doc_id % 7 = 0 THEN concat(text, ' ') ELSE text END AS content")
    return gates.drift(ours, theirs.unionByName(t.raw("documents").filter("doc_id % 13 = 0").selectExpr("concat('q', doc_id) AS path", "text AS content")))
