"""SQL that computes the registered queries from the same tables, in DuckDB's dialect."""

from __future__ import annotations

from tidemark.functions import text as tx
from tidemark.functions import web
from tidemark.operators import gates, ledger


def _list(xs: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs: tuple[str, ...] | list[str]) -> str:
    return "(" + _list(xs)[1:-1] + ")"


def _any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _ends(text: str, endings: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({text}, '{p}')" for p in endings) + ")"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}'), lambda w: NOT list_contains({_list(tx.FILLERS)}, w) AND (NOT regexp_full_match(w, '[\\x00-\\x7F]+') OR length(w) >= 4))"


_SHINGLES = "CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE list_distinct(t) END"


def _host(url: str) -> str:
    h = f"regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"
    last = lambda n: f"array_to_string(list_slice(string_split({h}, '.'), -{n}, -1), '.')"
    return (
        f"CASE WHEN regexp_full_match({h}, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') OR len(string_split({h}, '.')) <= 2 THEN {h} WHEN list_contains({_list(web.SUFFIXES)}, {last(2)}) THEN {last(3)} ELSE {last(2)} END"
    )


def _modality(kind: str) -> str:
    return f"CASE {' '.join(f'WHEN {kind} IN {_in(v)} THEN ' + repr(k) for k, v in web.MODALITIES.items())} ELSE 'other' END"


# Adapters

_HYP = "(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE unicode(text) END * 10000 + CASE WHEN length(coalesce(text, '')) < 2 THEN 0 ELSE unicode(substr(text, 2, 1)) END * 100 + length(split_part(coalesce(text, ''), ' ', 1)))"

_SNAPSHOTS = """snapshots AS (SELECT user_id AS id, ts AS t0, event_id AS seq,
  sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS views FROM events)"""
_POINTS = (
    _SNAPSHOTS
    + """, usable AS (SELECT id, t0, arg_min(views, seq) AS views FROM snapshots WHERE views IS NOT NULL GROUP BY id, t0),
 pairs AS (SELECT id, t0, (epoch_us(t0) - epoch_us(lag(t0) OVER w)) / 3.6e9 AS hours, views - lag(views) OVER w AS change FROM usable WINDOW w AS (PARTITION BY id ORDER BY t0)),
 points AS (SELECT id, t0, hours, change / hours AS per_hour FROM pairs WHERE hours > 0)"""
)
_LIVES = (
    _POINTS
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t0) AS i, count(*) OVER (PARTITION BY id) AS n FROM points),
 peaks AS (SELECT *, first_value(i) OVER (PARTITION BY id ORDER BY per_hour DESC, i) AS peak FROM placed),
 lines AS (SELECT id, any_value(n) AS n, any_value(peak) AS peak, count(*) FILTER (p) AS m, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny
   FROM (SELECT *, i >= peak AND per_hour > 0 AS p, CASE WHEN i >= peak AND per_hour > 0 THEN epoch_us(t0) / 3.6e9 - 470000 END AS x, CASE WHEN i >= peak AND per_hour > 0 THEN ln(per_hour) END AS y FROM peaks) GROUP BY id),
 lives AS (SELECT id, CASE WHEN n < 3 THEN 'insufficient_data' WHEN m < 3 THEN CASE WHEN peak >= n THEN 'not_decaying' ELSE 'insufficient_data' END WHEN nx < 2 THEN 'insufficient_data'
   WHEN slope >= 0 THEN 'not_decaying' ELSE 'ok' END AS status, CASE WHEN n < 3 THEN n ELSE m END AS have, slope, r2, ny FROM lines)"""
)
_CHART = """daily AS (SELECT event_type AS region, date_trunc('day', ts) AS t0, user_id AS id, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL),
 chart AS (SELECT region, CAST(t0 AS DATE) AS day, id, rank, 'u' || id || '-' || cents AS title, 'c' || (id % 7) AS channel
   FROM (SELECT *, row_number() OVER (PARTITION BY region, t0 ORDER BY cents DESC, id) AS rank FROM daily) WHERE rank <= 50)"""
_ARTIFACTS = """artifacts AS (SELECT doc_id AS seq, 'a' || doc_id AS artifact_id, 'https://s' || ((doc_id * doc_id + doc_id // 11) % 9) || '.co.uk/p' || doc_id AS source,
  's' || ((doc_id * doc_id + doc_id // 11) % 9) || '.co.uk' AS host, CASE doc_id % 7 WHEN 5 THEN 'json' WHEN 6 THEN 'pdf' ELSE 'html' END AS type, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE sha256(text) END AS sha256,
  CASE WHEN doc_id % 29 = 0 THEN 'BOT_WALL' ELSE 'OK' END AS quality_label FROM documents)"""
_FINDINGS = f"""findings AS (SELECT doc_id AS seq, source AS run, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'a' || doc_id END AS artifact_id, text, text AS quote,
  CASE doc_id % 3 WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'INFERRED' ELSE 'CORRECTED' END AS label, CASE doc_id // 2 % 5 WHEN 0 THEN 'disconfirms' WHEN 1 THEN 'neutral' ELSE 'confirms' END AS polarity,
  doc_id // 4 AS conclusion_id, {_HYP} AS hypothesis_id, CASE WHEN doc_id % 11 = 0 THEN 'wire' || (doc_id % 4) ELSE '' END AS origin,
  CASE WHEN doc_id % 6 = 0 THEN ['a' || (doc_id + 1)] ELSE [] END AS corroborated_by,
  CASE doc_id % 8 WHEN 1 THEN 'cue=' || (doc_id % 90) WHEN 2 THEN 'frame=12.5' WHEN 3 THEN 'cue=x' ELSE '' END AS locator FROM documents)"""
_MEASURES = """measures AS (SELECT 'a' || doc_id AS artifact_id, doc_id * 2 AS seq, (doc_id % 100) / 100 AS cer FROM documents UNION ALL SELECT 'a' || doc_id, doc_id * 2 + 1, (doc_id % 50) / 100 FROM documents)"""
_HYPOTHESES = f"""hypotheses AS (SELECT h AS hypothesis_id, min(doc_id) AS seq, min(source) AS run, CASE h % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS stakes,
  CASE WHEN h % 2 = 0 THEN 'debunk' ELSE 'discover' END AS mode FROM (SELECT *, {_HYP} AS h FROM documents) GROUP BY h)"""
_PREDICTIONS = f"""predictions AS (SELECT doc_id AS seq, doc_id AS prediction_id, text AS claim, (doc_id % 101) / 100 AS stated_confidence, '2025-0' || (1 + doc_id % 2) AS resolve_by, {_HYP} AS hypothesis_id,
  '2024-06-01T00:00:00Z' AS created FROM labels JOIN documents USING (doc_id))"""
_RESOLUTIONS = """resolutions AS (SELECT doc_id AS prediction_id, 2 * doc_id AS seq, CASE WHEN quality = 1 THEN 'hit' ELSE 'miss' END AS outcome, toxic = 0 AS anchored,
  CASE WHEN doc_id % 13 = 0 THEN '2024-06-01T00:00:00Z' ELSE '2024-07-01T00:00:00Z' END AS ts FROM labels
  UNION ALL SELECT doc_id, 2 * doc_id + 1, 'unresolved', toxic = 0, '2024-07-01T00:00:00Z' FROM labels WHERE doc_id % 7 = 0)"""
_RESOLVED = f"""{_PREDICTIONS}, {_RESOLUTIONS}, last AS (SELECT prediction_id, arg_max(outcome, seq) AS outcome, arg_max(anchored, seq) AS anchored, arg_max(ts, seq) AS ts FROM resolutions GROUP BY 1),
 done AS (SELECT stated_confidence AS p, CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END AS y, anchored, ts <= created AS premature FROM predictions JOIN last USING (prediction_id) WHERE outcome IN ('hit', 'miss'))"""
_FRONTIER = "frontier AS (SELECT conv_id // 3 AS item, CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'visit' ELSE 'close' END AS op, conv_id * 100000 + turn AS seq FROM conversations)"
_FETCHED = """fetched AS (SELECT page_id, url, html, CASE WHEN page_id % 13 = 0 THEN '' ELSE html END AS body, CASE page_id % 12 WHEN 3 THEN 404 WHEN 5 THEN 403 WHEN 7 THEN 503 WHEN 9 THEN 429 ELSE 200 END AS status,
  CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS hit, page_id % 41 = 0 AS unpassed FROM pages)"""
_CARDS = """cards AS (SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE p_partkey % 3 WHEN 0 THEN 'settled-fact' WHEN 1 THEN 'api-number' ELSE 'on-screen-price' END AS answer_kind,
  CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS gold, p_partkey % 2 = 0 AS stable, p_partkey % 5 = 0 AS holdout, p_partkey % 11 = 0 AS poison,
  date_diff('day', DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER), DATE '2024-09-01') > 200 AS expired FROM part),
 firsts AS (SELECT l_partkey, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS e, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS n FROM lineitem GROUP BY 1),
 results AS (SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE WHEN p_partkey % 22 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN 'It is ' || p_brand || '.' ELSE CAST(CAST(e / n AS DECIMAL(18,2)) AS VARCHAR) END AS answer
   FROM firsts JOIN part ON l_partkey = p_partkey),
 judged AS (SELECT *, r.task_id IS NOT NULL AS answered, CASE WHEN poison THEN r.task_id IS NOT NULL AND lower(answer) = 'unknown' WHEN r.task_id IS NULL OR lower(answer) = 'unknown' THEN false
   WHEN answer_kind <> 'settled-fact' THEN coalesce(abs(TRY_CAST(answer AS DOUBLE) - TRY_CAST(gold AS DOUBLE)) <= 1000, false) ELSE regexp_matches(lower(answer), '(^|\\W)' || lower(gold) || '($|\\W)') END AS passed
   FROM cards LEFT JOIN results r USING (task_id))"""
_FACTS = f"""facts AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'degraded' ELSE 'observed' END AS status,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS age_days, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) + 900 END AS effective_at, 30 + o_orderkey % 900 AS ttl_days FROM orders),
 states AS (SELECT id, age_days, CASE WHEN age_days < 0 THEN 'corrupt' WHEN effective_at > DATE '1998-12-01' THEN 'pending' WHEN status IN {_in(gates.UNVERIFIED)} THEN 'unverified' WHEN age_days >= ttl_days THEN 'stale' ELSE 'fresh' END AS freshness,
  status FROM facts)"""
_WORDS = r"""words AS (SELECT conv_id AS transcript_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS i FROM
  (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}\p{M}_가-힣]', ' ', 'g'), '\s+'), lambda w: w <> '') AS ws FROM conversations))),
 runs AS (SELECT transcript_id, max(n) AS longest FROM (SELECT transcript_id, word, g, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY transcript_id, word ORDER BY i) AS g FROM words) GROUP BY ALL) GROUP BY 1)"""


def _near(items: str, group: str, node: str, text: str, least: float = tx.NEAR) -> str:
    """CTEs ``near`` (group, a, b, similarity) over ``items``."""
    return f"""toks AS (SELECT {group} AS g, {node} AS n, {_tokens(text)} AS t FROM {items}), shs AS (SELECT g, n, {_SHINGLES} AS s FROM toks),
 each AS (SELECT g, n, unnest(s) AS w FROM shs), met2 AS (SELECT x.g, x.n AS a, y.n AS b, count(*) AS nb FROM each x JOIN each y ON x.g = y.g AND x.w = y.w AND x.n < y.n GROUP BY ALL),
 near AS (SELECT met2.g, a, b, nb / (len(sa.s) + len(sb.s) - nb) AS similarity FROM met2 JOIN shs sa ON sa.g = met2.g AND sa.n = a JOIN shs sb ON sb.g = met2.g AND sb.n = b WHERE nb / (len(sa.s) + len(sb.s) - nb) >= {least})"""


def _count_components(nodes: str, edges: str, name: str = "parts") -> str:
    """CTEs ``name`` (g, n_nodes, n_components) by reachability (use WITH RECURSIVE)."""
    return f"""{name}_e AS (SELECT g, a, b FROM {edges} UNION SELECT g, b, a FROM {edges}), {name}_r AS (SELECT g, n, n AS m FROM {nodes} UNION SELECT r.g, r.n, e.b FROM {name}_r r JOIN {name}_e e ON e.g = r.g AND e.a = r.m),
 {name} AS (SELECT g, count(*) AS n_nodes, count(*) FILTER (least_m = n) AS n_components FROM (SELECT g, n, min(m) AS least_m FROM {name}_r GROUP BY g, n) GROUP BY g)"""


VELOCITY = f"WITH {_POINTS} SELECT id, epoch_us(t0) AS \"at\", round(hours, 6) AS hours, round(per_hour, 3) AS per_hour FROM points"
HALF_LIFE = f"""WITH {_LIVES} SELECT id, status, have, CASE WHEN status = 'ok' THEN round(ln(2) / -slope / 24, 2) END AS half_life_days,
 CASE WHEN status = 'ok' THEN round(CASE WHEN ny = 1 THEN 1.0 ELSE r2 END, 3) END AS r2 FROM lives"""
WATCH_REPORT = f"""WITH {_LIVES}, ends AS (SELECT id, count(*) AS snapshots, arg_min(t0, seq) AS first_at, arg_max(t0, seq) AS last_at, arg_max(views, seq) FILTER (views IS NOT NULL) AS latest_views, arg_max(views IS NULL, seq) AS missing_last FROM snapshots GROUP BY id),
 speeds AS (SELECT id, round(arg_max(per_hour, t0), 2) AS latest_per_hour, round(max(per_hour), 2) AS peak_per_hour FROM points GROUP BY id)
 SELECT c_custkey AS ord, c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS note, coalesce(snapshots, 0) AS snapshots, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, CAST(latest_views AS BIGINT) AS latest_views, coalesce(missing_last, false) AS missing_last, latest_per_hour, peak_per_hour,
 coalesce(status, 'insufficient_data') AS status, CASE WHEN status = 'ok' THEN round(ln(2) / -slope / 24, 2) END AS half_life_days
 FROM customer LEFT JOIN ends ON ends.id = c_custkey LEFT JOIN speeds ON speeds.id = c_custkey LEFT JOIN lives ON lives.id = c_custkey"""
CHART_DAILY = f"""WITH {_CHART}, days AS (SELECT region, day, lag(day) OVER w AS before, lead(day) OVER w AS after FROM (SELECT DISTINCT region, day FROM chart) WINDOW w AS (PARTITION BY region ORDER BY day)),
 entered AS (SELECT c.region, c.day, count(*) FILTER (o.id IS NULL) AS entries, count(*) AS size FROM chart c JOIN days d ON d.region = c.region AND d.day = c.day LEFT JOIN chart o ON o.region = c.region AND o.day = d.before AND o.id = c.id GROUP BY ALL),
 gone AS (SELECT c.region, d.after AS day, count(*) AS exits FROM chart c JOIN days d ON d.region = c.region AND d.day = c.day LEFT JOIN chart o ON o.region = c.region AND o.day = d.after AND o.id = c.id WHERE d.after IS NOT NULL AND o.id IS NULL GROUP BY ALL)
 SELECT region, CAST(day AS VARCHAR) AS day, entries, coalesce(exits, 0) AS exits, size FROM entered LEFT JOIN gone USING (region, day)"""
CHART_RESIDENCE = f"""WITH {_CHART} SELECT region, id, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen, count(*) AS days_on_chart, min(rank) AS best_rank, arg_max(rank, day) AS latest_rank,
 arg_max(title, day) AS title, arg_min(channel, day) AS channel FROM chart GROUP BY region, id"""
CHART_TOP = f"""SELECT region, place, id, days_on_chart, best_rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY days_on_chart DESC, best_rank, id) AS place FROM ({CHART_RESIDENCE})) WHERE place <= 15"""
CHART_WEEK = f"""SELECT region, day, entries, exits, size FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS r FROM ({CHART_DAILY})) WHERE r <= 7"""
DISCOVERY = """WITH items AS (SELECT user_id AS id, sum(CAST(round(value * 100) AS BIGINT)) AS views, min(ts) AS born, count(*) AS likes, count(DISTINCT event_type) AS comments, max(event_id) AS last FROM events GROUP BY 1),
 aged AS (SELECT *, greatest(0.5, (epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(born)) / 8.64e10) AS age FROM items)
 SELECT id, 'c' || id AS channel, last % 900 AS duration, CAST(views AS BIGINT) AS views, CAST(floor(age + 0.5) AS BIGINT) AS age_days, CAST(floor(views / age + 0.5) AS BIGINT) AS per_day, CASE WHEN views > 0 THEN floor((likes + comments) / views * 10000 + 0.5) / 100 ELSE 0.0 END AS answered
 FROM aged WHERE last % 900 BETWEEN 60 AND 600 AND id % 4 <> 0 ORDER BY per_day DESC, id LIMIT 5"""
TOP_VELOCITY = """SELECT user_id AS id, round(sum(CAST(round(value * 100) AS BIGINT)) / greatest(0.5, (epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(min(ts))) / 8.64e10), 4) AS per_day FROM events GROUP BY user_id ORDER BY per_day DESC, id LIMIT 5"""

LATEST = f"WITH {_MEASURES} SELECT artifact_id, max(seq) AS seq, arg_max(cer, seq) AS cer FROM measures GROUP BY artifact_id"
FIRST = """SELECT user_id || '|' || event_type AS logical_key, min(event_id) AS seq, arg_min(CAST(round(value * 100) AS BIGINT), event_id) AS cents, 'a_' || substr(sha256(user_id || '|' || event_type), 1, 16) AS artifact_id FROM events GROUP BY user_id, event_type"""
INSERT_ONCE = "SELECT k, min(seq) AS seq FROM (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS k, o_orderkey AS seq FROM orders UNION ALL SELECT user_id, -event_id FROM events) WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY k"
FRONTIER = f"""WITH {_FRONTIER}, closes AS (SELECT item, max(seq) FILTER (op = 'close') AS c FROM frontier GROUP BY item), state AS (SELECT item, min(seq) FILTER (op = 'open' AND (c IS NULL OR seq > c)) AS opened_at, min(seq) FILTER (op = 'close') AS closed_at,
 min(seq) FILTER (op = 'visit') AS visited_at FROM frontier JOIN closes USING (item) GROUP BY item)
 SELECT item, opened_at IS NOT NULL AS is_open, closed_at IS NOT NULL AS is_closed, visited_at IS NOT NULL AS is_visited, opened_at, closed_at, visited_at FROM state"""
DANGLING = f"WITH {_FINDINGS}, {_ARTIFACTS} SELECT seq, artifact_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.artifact_id = f.artifact_id)"
_FAKE = f"""{_FINDINGS}, {_ARTIFACTS}, cited AS (SELECT seq, artifact_id, unnest(list_distinct(list_concat([artifact_id], corroborated_by))) AS c FROM findings WHERE len(corroborated_by) > 0),
 fake AS (SELECT cited.seq, cited.artifact_id, count(DISTINCT host) AS n_hosts FROM cited LEFT JOIN artifacts a ON a.artifact_id = c GROUP BY ALL HAVING count(DISTINCT host) < 2)"""
FAKE = f"WITH {_FAKE} SELECT seq, artifact_id, n_hosts FROM fake"
LOW_QUALITY = f"WITH {_FINDINGS}, {_ARTIFACTS} SELECT f.seq, artifact_id, quality_label FROM findings f JOIN artifacts a USING (artifact_id) WHERE quality_label IN {_in(ledger.BAD_QUALITY)}"
CAPTURE = f"WITH {_FINDINGS}, {_MEASURES} SELECT f.seq, f.artifact_id, m.cer FROM findings f JOIN (SELECT artifact_id, arg_max(cer, seq) AS cer FROM measures GROUP BY 1) m USING (artifact_id)"
INTEGRITY = f"""WITH {_FAKE}, present AS (SELECT 'a' || doc_id AS artifact_id, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS actual FROM documents),
 state AS (SELECT CASE WHEN sha256 IS NULL OR actual IS NULL THEN 'u' WHEN sha256 <> actual THEN 'm' ELSE 'i' END AS s FROM artifacts JOIN present USING (artifact_id))
 SELECT *, mismatch = 0 AND unverifiable = 0 AND dangling = 0 AS ok FROM (SELECT (SELECT count(*) FROM state WHERE s = 'i') AS intact, (SELECT count(*) FROM state WHERE s = 'm') AS mismatch, (SELECT count(*) FROM state WHERE s = 'u') AS unverifiable,
 (SELECT count(*) FROM findings f WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.artifact_id = f.artifact_id)) AS dangling,
 (SELECT count(*) FROM findings JOIN artifacts USING (artifact_id) WHERE quality_label <> 'OK') AS low_quality, (SELECT count(DISTINCT artifact_id) FROM fake) AS fake_corroborated)"""
SEAL = f"""WITH {_FINDINGS}, {_ARTIFACTS}, met AS (SELECT f.seq, f.artifact_id, f.text, a.type, a.quality_label, locator, CASE WHEN f.seq % 5 = 0 THEN quote END AS quote, min(f.seq) OVER (PARTITION BY f.artifact_id) AS first_seq FROM findings f JOIN artifacts a USING (artifact_id)),
 kinds AS (SELECT *, CASE WHEN coalesce(quote, '') <> '' THEN 'text_span' WHEN regexp_full_match(locator, 'cue=[0-9]+') THEN 'transcript_cue' WHEN starts_with(locator, 'frame=') THEN 'frame' ELSE 'text_span' END AS anchor_kind FROM met)
 SELECT seq, artifact_id, seq = first_seq AS registers, anchor_kind, CASE anchor_kind WHEN 'transcript_cue' THEN substr(locator, 5) WHEN 'frame' THEN '0' ELSE CASE WHEN coalesce(quote, '') <> '' THEN quote ELSE substr(text, 1, 120) END END AS anchor,
 CASE anchor_kind WHEN 'transcript_cue' THEN 'transcript_cue' WHEN 'frame' THEN 'frame_screenshot' ELSE CASE type WHEN 'html' THEN 'page_html' ELSE 'structured_data' END END AS evidence_kind, text || CASE WHEN quality_label <> 'OK' THEN ' [WARN low-quality source]' ELSE '' END AS claim FROM kinds"""
SEAL_SKIPPED = f"""WITH {_FINDINGS}, {_ARTIFACTS} SELECT f.seq, f.artifact_id, 'dangling' AS reason FROM findings f WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.artifact_id = f.artifact_id)"""

_NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all(quote, '\\d+(?:,\\d{3})*(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))))"
_CONFLICTS = f"""own AS (SELECT conclusion_id, seq, artifact_id, {_NUMBERS} AS ns, list_distinct({_tokens('quote')}) AS ws FROM findings),
 conflicts AS (SELECT x.conclusion_id, x.seq AS a_seq, y.seq AS b_seq, x.artifact_id AS a, y.artifact_id AS b, list_sort(list_distinct(list_concat(x.ns, y.ns))) AS ns FROM own x JOIN own y ON x.conclusion_id = y.conclusion_id AND x.seq < y.seq
  WHERE len(x.ns) > 0 AND len(y.ns) > 0 AND x.ns <> y.ns AND list_has_any(x.ws, y.ws))"""
CONFLICTS = f"WITH {_FINDINGS}, {_CONFLICTS} SELECT conclusion_id, a_seq, b_seq, a, b, array_to_string(list_transform(ns, lambda x: printf('%.4f', x)), ',') AS numbers FROM conflicts"
CONFLICT_LINKS = f"""WITH {_FINDINGS}, {_CONFLICTS}, sides AS (SELECT conclusion_id, a_seq AS seq, b_seq AS other FROM conflicts UNION ALL SELECT conclusion_id, b_seq, a_seq FROM conflicts),
 counted AS (SELECT conclusion_id, seq, count(*) AS n, min(other) AS first_seq FROM sides GROUP BY ALL)
 SELECT own.conclusion_id, own.seq, artifact_id, min(own.seq) OVER (PARTITION BY own.conclusion_id, ns, list_sort(ws)) AS class_seq, coalesce(n, 0) AS n_links, first_seq FROM own LEFT JOIN counted USING (conclusion_id, seq) WHERE len(ns) > 0"""
HYPOTHESIS_CONFLICTS = f"""WITH {_FINDINGS}, own AS (SELECT hypothesis_id, seq, {_NUMBERS} AS ns, list_distinct({_tokens('quote')}) AS ws FROM findings)
 SELECT x.hypothesis_id, count(*) AS conflicts FROM own x JOIN own y ON x.hypothesis_id = y.hypothesis_id AND x.seq < y.seq WHERE len(x.ns) > 0 AND len(y.ns) > 0 AND x.ns <> y.ns AND list_has_any(x.ws, y.ws) GROUP BY 1"""
NEAR_LINKS = f"""WITH {_FINDINGS}, {_near('findings', 'hypothesis_id', 'seq', 'text')}, sides AS (SELECT g, a AS n FROM near UNION ALL SELECT g, b FROM near), counted AS (SELECT g, n, count(*) AS n_links FROM sides GROUP BY ALL)
 SELECT shs.g AS hypothesis_id, shs.n AS seq, min(shs.n) OVER (PARTITION BY shs.g, list_sort(s)) AS class_seq, coalesce(n_links, 0) AS n_links FROM shs LEFT JOIN counted USING (g, n) WHERE len(s) > 0"""
NEAR_PAIRS = f"WITH {_FINDINGS}, {_near('findings', 'hypothesis_id', 'seq', 'text')} SELECT g AS hypothesis_id, a, b, round(similarity, 6) AS similarity FROM near"
DISTINCT_CLAIMS = f"WITH RECURSIVE {_FINDINGS}, {_near('findings', 'hypothesis_id', 'seq', 'text')}, nodes AS (SELECT hypothesis_id AS g, seq AS n FROM findings), {_count_components('nodes', 'near')} SELECT g AS hypothesis_id, n_nodes AS n, n_components AS n_distinct FROM parts"
_SUPPORTS = f"""{_FINDINGS}, {_ARTIFACTS}, cites AS (SELECT conclusion_id, seq, substr(quote, 1, 200) AS quote, unnest(list_concat([artifact_id], corroborated_by)) AS artifact_id, generate_subscripts(list_concat([artifact_id], corroborated_by), 1) AS p FROM findings),
 best AS (SELECT conclusion_id, artifact_id, arg_max(quote, (length(quote), -seq, -p)) AS quote FROM cites GROUP BY ALL), supports AS (SELECT conclusion_id, b.artifact_id, b.quote, a.type, a.sha256, a.host, a.seq FROM best b JOIN artifacts a USING (artifact_id))"""
GRADE = f"""WITH {_SUPPORTS}, {_CONFLICTS}, dated AS (SELECT *, date_diff('day', DATE '2024-01-01' + CAST(seq % 400 AS INTEGER), DATE '2024-12-31') AS age FROM supports),
 facts AS (SELECT conclusion_id, count(*) AS n_artifacts, count(DISTINCT host) AS distinct_hosts, count(age) AS n_dated, min(age) FILTER (age >= 0) AS freshest_age, bool_and(sha256 IS NOT NULL) AS all_hashed, count(DISTINCT type) AS n_types,
  list_distinct(list({_modality('type')})) AS modalities FROM dated GROUP BY 1),
 clash AS (SELECT conclusion_id, count(*) AS conflicts FROM conflicts GROUP BY 1), every AS (SELECT DISTINCT conclusion_id FROM findings),
 m AS (SELECT conclusion_id, coalesce(n_artifacts, 0) AS n_artifacts, coalesce(distinct_hosts, 0) AS distinct_hosts, coalesce(n_dated, 0) AS n_dated, freshest_age, coalesce(conflicts, 0) AS conflicts, coalesce(all_hashed, false) AS all_hashed, coalesce(n_types, 0) AS n_types,
  coalesce(modalities, []) AS modalities FROM every LEFT JOIN facts USING (conclusion_id) LEFT JOIN clash USING (conclusion_id)),
 v AS (SELECT *, distinct_hosts >= 2 AS breadth_met, CASE WHEN n_dated = 0 OR round(n_dated / n_artifacts, 3) < 0.5 OR freshest_age IS NULL THEN NULL ELSE freshest_age <= 300 END AS recency_met, conflicts = 0 AS consistency_met FROM m)
 SELECT conclusion_id, n_artifacts, distinct_hosts AS effective_sources, distinct_hosts, n_dated, freshest_age, conflicts, breadth_met, recency_met, consistency_met, all_hashed AS traceability_met, n_types >= 2 AS source_type_met,
 list_has_all(modalities, ['web', 'structured']) AS modality_met,
 array_to_string(list_filter([CASE WHEN NOT breadth_met THEN 'breadth' END, CASE WHEN NOT consistency_met THEN 'consistency' END, CASE WHEN NOT recency_met THEN 'recency' END], lambda x: x IS NOT NULL), ',') AS shortfalls,
 CASE WHEN NOT breadth_met OR NOT consistency_met OR (NOT recency_met AND recency_met IS NOT NULL) THEN 'SHORTFALL' WHEN recency_met IS NULL THEN 'UNKNOWN' ELSE 'MEETS' END AS overall FROM v"""
GRADE_DUP = f"""WITH RECURSIVE {_SUPPORTS}, {_near('supports', 'conclusion_id', 'artifact_id', 'quote')}, nodes AS (SELECT conclusion_id AS g, artifact_id AS n FROM supports),
 edges AS (SELECT g, a, b FROM near UNION SELECT x.conclusion_id, x.artifact_id, y.artifact_id FROM supports x JOIN supports y ON x.conclusion_id = y.conclusion_id AND x.host = y.host AND x.artifact_id < y.artifact_id), {_count_components('nodes', 'edges')}
 SELECT g AS conclusion_id, n_components AS effective_sources FROM parts"""
_CLAIMS = (
    f"{_near('findings', 'hypothesis_id || polarity', 'seq', 'text')}, claim_nodes AS (SELECT hypothesis_id || polarity AS g, seq AS n FROM findings), {_count_components('claim_nodes', 'near', 'claims')}"
)
_TRI = f"""{_FINDINGS}, {_ARTIFACTS}, {_CLAIMS}, met AS (SELECT f.*, coalesce(a.host, '') AS host, CASE WHEN a.artifact_id IS NULL THEN 'other' ELSE {_modality('a.type')} END AS modality, CASE WHEN origin <> '' THEN 'origin:' || origin ELSE coalesce(a.host, '') END AS unit
  FROM findings f LEFT JOIN artifacts a USING (artifact_id)),
 tri0 AS (SELECT hypothesis_id, count(*) AS n_signals, count(*) FILTER (polarity = 'confirms') AS confirming, count(*) FILTER (polarity = 'disconfirms') AS disconfirming,
  count(DISTINCT CASE WHEN polarity = 'confirms' AND host <> '' THEN host END) AS confirming_hosts, count(DISTINCT CASE WHEN polarity = 'disconfirms' AND host <> '' THEN host END) AS disconfirming_hosts,
  count(DISTINCT CASE WHEN polarity = 'confirms' AND unit <> '' THEN unit END) AS confirming_origins, count(DISTINCT CASE WHEN polarity = 'disconfirms' AND unit <> '' THEN unit END) AS disconfirming_origins,
  coalesce(list_sort(list_distinct(list(modality) FILTER (polarity = 'confirms'))), []) AS modalities FROM met GROUP BY 1),
 tri AS (SELECT tri0.*, coalesce(c.n_components, 0) AS confirming_claims, coalesce(d.n_components, 0) AS disconfirming_claims, confirming_hosts - disconfirming_hosts AS net_hosts, confirming_origins - disconfirming_origins AS net_origins
  FROM tri0 LEFT JOIN claims c ON c.g = hypothesis_id || 'confirms' LEFT JOIN claims d ON d.g = hypothesis_id || 'disconfirms')"""
TRIANGULATE = f"""WITH RECURSIVE {_TRI} SELECT hypothesis_id, n_signals, confirming, disconfirming, confirming_hosts, disconfirming_hosts, confirming_origins, disconfirming_origins, array_to_string(modalities, ',') AS modalities, confirming_claims,
 disconfirming_claims, net_hosts, net_origins FROM tri"""
_PRED_NEAR = _near("predictions", "hypothesis_id || resolve_by", "seq", "claim").replace("toks", "ptoks").replace("shs", "pshs").replace("each", "peach").replace("met2", "pmet2").replace("near AS", "pnear AS")
_COUNTED = f"""{_HYPOTHESES}, {_PREDICTIONS}, {_PRED_NEAR}, pred_nodes AS (SELECT hypothesis_id || resolve_by AS g, seq AS n FROM predictions), {_count_components('pred_nodes', 'pnear', 'preds')},
 counts AS (SELECT hypothesis_id, sum(n_nodes) AS raw, sum(n_components) AS dis FROM preds JOIN (SELECT DISTINCT hypothesis_id || resolve_by AS g, hypothesis_id FROM predictions) USING (g) GROUP BY 1),
 staked AS (SELECT tri.*, stakes, coalesce(raw, 0) AS raw, coalesce(dis, 0) AS dis FROM tri LEFT JOIN hypotheses USING (hypothesis_id) LEFT JOIN counts USING (hypothesis_id))"""
DISCOVER = f"""WITH RECURSIVE {_TRI}, {_COUNTED}, reasoned AS (SELECT hypothesis_id, stakes, list_filter([CASE WHEN len(modalities) < 2 THEN CASE WHEN confirming > 0 THEN 'single-modality' ELSE 'no-confirming-signals' END END,
 CASE WHEN confirming_claims < confirming THEN 'echoed-claims(' || confirming || '->' || confirming_claims || ')' END, CASE WHEN net_origins <= 0 THEN 'no-net-independent-convergence' END,
 CASE WHEN confirming > 0 AND confirming_origins < 3 THEN 'thin-independence(' || confirming_origins || '<3)' END,
 CASE WHEN dis = 0 THEN 'no-falsifiable-prediction' WHEN raw > dis THEN 'echoed-predictions(' || raw || '->' || dis || ')' END], lambda x: x IS NOT NULL) AS r FROM staked)
 SELECT hypothesis_id, CASE WHEN len(r) = 0 THEN 'ALPHA' ELSE 'RECON' END AS label, array_to_string(r, ',') AS reasons,
 CASE WHEN stakes = 'high' AND len(list_filter(r, lambda x: x <> 'single-modality')) > 0 THEN 'HIGH-STAKES EFFORT SHORTFALL' ELSE '' END AS warning FROM reasoned"""
DEBUNK = f"""WITH RECURSIVE {_TRI}, {_COUNTED}, labelled AS (SELECT *, CASE WHEN confirming = 0 AND disconfirming = 0 THEN 'UNRESOLVED' WHEN net_origins >= 1 AND confirming_origins >= 2 THEN 'CONFIRMED-FALSE'
 WHEN net_origins <= -1 AND disconfirming_origins >= 2 THEN 'CONFIRMED-TRUE' ELSE 'UNRESOLVED' END AS label, greatest(confirming_origins, disconfirming_origins) AS most FROM staked)
 SELECT hypothesis_id, label, array_to_string(list_filter([CASE WHEN confirming = 0 AND disconfirming = 0 THEN 'no-signals' WHEN label = 'UNRESOLVED' THEN CASE WHEN most < 2 THEN 'thin-independence(' || most || '<2)' ELSE 'balanced-evidence' END END,
 CASE WHEN label <> 'CONFIRMED-TRUE' AND confirming_claims < confirming THEN 'echoed-claims(' || confirming || '->' || confirming_claims || ')' END, CASE WHEN label <> 'CONFIRMED-TRUE' AND confirming > 0 AND len(modalities) < 2 THEN 'single-modality' END,
 CASE WHEN dis = 0 THEN 'no-overturn-condition' WHEN raw > dis THEN 'echoed-predictions(' || raw || '->' || dis || ')' END], lambda x: x IS NOT NULL), ',') AS reasons,
 CASE WHEN label = 'UNRESOLVED' AND stakes = 'high' THEN 'HIGH-STAKES DEBUNK UNRESOLVED' ELSE '' END AS warning FROM labelled"""
_ECHO = f"""yes AS (SELECT * FROM findings WHERE polarity = 'confirms'), ytoks AS (SELECT hypothesis_id AS g, seq AS n, {_tokens('text')} AS t FROM yes), ylong AS (SELECT g, n, {_SHINGLES} AS s FROM ytoks WHERE len(t) >= 3),
 yeach AS (SELECT g, n, unnest(s) AS w FROM ylong), ymet AS (SELECT x.g, x.n AS a, y.n AS b, count(*) AS nb FROM yeach x JOIN yeach y ON x.g = y.g AND x.w = y.w AND x.n < y.n GROUP BY ALL),
 ynear AS (SELECT ymet.g, a, b FROM ymet JOIN ylong sa ON sa.g = ymet.g AND sa.n = a JOIN ylong sb ON sb.g = ymet.g AND sb.n = b WHERE nb / (len(sa.s) + len(sb.s) - nb) >= {tx.NEAR}),
 ywords AS (SELECT g, n, list_distinct(t) AS w, len(t) < 3 AS short FROM ytoks WHERE len(t) > 0),
 ybrief AS (SELECT x.g, least(x.n, y.n) AS a, greatest(x.n, y.n) AS b FROM ywords x JOIN ywords y ON x.g = y.g AND x.n <> y.n AND x.short AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= {tx.NEAR}),
 yedges AS (SELECT g, a, b FROM ynear UNION SELECT g, a, b FROM ybrief), ynodes AS (SELECT g, a AS n FROM yedges UNION SELECT g, b FROM yedges),
 yplaced AS (SELECT ynodes.g, n, row_number() OVER (PARTITION BY ynodes.g ORDER BY n) AS r, coalesce(before, []) AS before FROM ynodes LEFT JOIN (SELECT g, b, list(a) AS before FROM yedges GROUP BY g, b) e ON e.g = ynodes.g AND e.b = n),
 yfold AS (SELECT g, n, r, [n] AS seeds, NULL::BIGINT AS seed FROM yplaced WHERE r = 1 UNION ALL
  SELECT p.g, p.n, p.r, CASE WHEN list_has_any(f.seeds, p.before) THEN f.seeds ELSE list_append(f.seeds, p.n) END, list_min(list_intersect(f.seeds, p.before)) FROM yfold f JOIN yplaced p ON p.g = f.g AND p.r = f.r + 1),
 echo AS (SELECT g, count(DISTINCT seed) AS n_components FROM yfold WHERE seed IS NOT NULL GROUP BY g)"""
_CHAINS = f"{_ECHO}, {_count_components('ynodes', 'yedges', 'chains')}"
ECHOES = f"WITH RECURSIVE {_FINDINGS}, {_ECHO} SELECT g AS hypothesis_id, n_components AS echo_clusters FROM echo"
ECHO_MEMBERS = f"WITH RECURSIVE {_FINDINGS}, {_ECHO} SELECT g AS hypothesis_id, n AS seq, seed FROM yfold WHERE seed IS NOT NULL"
ECHO_CHAINS = f"WITH RECURSIVE {_FINDINGS}, {_CHAINS} SELECT g AS hypothesis_id, n_components AS echo_clusters FROM chains"
CONCENTRATION = f"""WITH {_FINDINGS}, {_ARTIFACTS}, yes AS (SELECT f.hypothesis_id, f.seq, coalesce(host, '') AS host FROM findings f LEFT JOIN artifacts a USING (artifact_id) WHERE polarity = 'confirms'),
 hosts AS (SELECT hypothesis_id, host, count(*) AS n, min(seq) AS s FROM yes WHERE host <> '' GROUP BY ALL), top AS (SELECT hypothesis_id, arg_max(host, (n, -s)) AS host, max(n) AS n FROM hosts GROUP BY 1), total AS (SELECT hypothesis_id, count(*) AS confirming FROM yes GROUP BY 1)
 SELECT hypothesis_id, confirming, coalesce(host, '') AS host, coalesce(n, 0) AS n, coalesce(n, 0) / confirming > 0.5 AS concentrated FROM total LEFT JOIN top USING (hypothesis_id)"""

_JUDGED = f"""staked2 AS (SELECT hypothesis_id, mode FROM hypotheses), verdicts AS (SELECT hypothesis_id, CASE WHEN mode = 'debunk' THEN b.label ELSE d.label END AS label, CASE WHEN mode = 'debunk' THEN b.reasons ELSE d.reasons END AS reasons, mode
 FROM staked2 JOIN ({DISCOVER}) d USING (hypothesis_id) JOIN ({DEBUNK}) b USING (hypothesis_id))"""
_GATE = f"""{_FINDINGS}, {_HYPOTHESES}, {_JUDGED}, {_ECHO}, gate AS (SELECT hypothesis_id, label, coalesce(n_components, 0) AS echo_clusters, coalesce(concentrated, false) AS concentrated,
 CASE WHEN mode = 'debunk' THEN label <> 'UNRESOLVED' ELSE label = 'ALPHA' AND coalesce(n_components, 0) = 0 AND NOT coalesce(concentrated, false) END AS passed
 FROM verdicts LEFT JOIN echo ON echo.g = hypothesis_id LEFT JOIN ({CONCENTRATION}) c USING (hypothesis_id))"""
INDEPENDENCE = f"WITH RECURSIVE {_GATE} SELECT hypothesis_id, label, echo_clusters, concentrated, passed FROM gate"
RUN_GATE = f"WITH RECURSIVE {_GATE} SELECT evaluated, failed, evaluated > 0 AND failed = 0 AS passed FROM (SELECT count(*) AS evaluated, count(*) FILTER (NOT passed) AS failed FROM gate)"

_GRADINGS = """gradings AS (SELECT doc_id AS seq, doc_id // 4 AS conclusion_id, 'std' || (doc_id % 2) AS standard_id, CASE doc_id % 5 WHEN 0 THEN 'MEETS' WHEN 1 THEN 'UNKNOWN' ELSE 'SHORTFALL' END AS overall FROM documents WHERE doc_id // 4 % 3 <> 0)"""
AUDIT = f"""WITH {_FINDINGS}, {_CONFLICTS}, {_MEASURES}, {_FRONTIER}, {_ARTIFACTS}, {_GRADINGS}, closes AS (SELECT item, max(seq) FILTER (op = 'close') AS c FROM frontier GROUP BY item),
 lasts AS (SELECT conclusion_id, standard_id, arg_max(overall, seq) AS overall FROM gradings GROUP BY ALL)
 SELECT i.*, (SELECT count(DISTINCT artifact_id) FROM findings JOIN measures USING (artifact_id)) AS capture_errors, (SELECT count(*) FROM conflicts) AS numeric_conflicts,
 (SELECT count(DISTINCT item) FROM frontier JOIN closes USING (item) WHERE op = 'open' AND (c IS NULL OR seq > c)) AS open_at_stop,
 (SELECT count(DISTINCT artifact_id) FROM findings JOIN artifacts USING (artifact_id) WHERE quality_label <> 'OK') AS signals_on_bad_capture, (SELECT count(*) FROM lasts) AS graded,
 (SELECT count(*) FROM lasts WHERE overall = 'SHORTFALL') AS shortfalls, (SELECT count(DISTINCT conclusion_id) FROM findings WHERE conclusion_id NOT IN (SELECT conclusion_id FROM gradings)) AS ungraded_conclusions FROM ({INTEGRITY}) i"""

_SHAPED = f"{_FINDINGS}, {_ARTIFACTS}, shaped AS (SELECT run, CASE a.type WHEN 'html' THEN 'unstructured' WHEN 'json' THEN 'structured' WHEN 'pdf' THEN 'semi-structured' ELSE 'dangling' END AS shape, count(*) AS n FROM findings f LEFT JOIN artifacts a USING (artifact_id) GROUP BY ALL)"
SHAPE_COUNTS = f"WITH {_SHAPED} SELECT run, shape, n FROM shaped"


def _issues(stakes: str) -> str:
    b = gates.BUDGETS[stakes]
    parts = [f"CASE WHEN total < {b['least']} THEN 'total-candidates(' || total || '<{b['least']})' END"]
    parts += [f"""CASE WHEN "{s}" < {b['per_shape']} THEN '{s}(' || "{s}" || '<{b['per_shape']})' END""" for s in b["required"]]
    return "[" + ", ".join(parts) + "]"


SHAPE_BUDGET = f"""WITH {_SHAPED}, {_HYPOTHESES}, ranks AS (SELECT run, max(CASE stakes WHEN 'high' THEN 2 WHEN 'med' THEN 1 ELSE 0 END) AS r FROM hypotheses GROUP BY 1),
 flat AS (SELECT run, coalesce(sum(n) FILTER (shape <> 'dangling'), 0) AS total, coalesce(sum(n) FILTER (shape = 'dangling'), 0) AS dangling, coalesce(sum(n) FILTER (shape = 'unstructured'), 0) AS unstructured,
  coalesce(sum(n) FILTER (shape = 'structured'), 0) AS structured, coalesce(sum(n) FILTER (shape = 'semi-structured'), 0) AS "semi-structured", 0 AS video, 0 AS ocr FROM shaped GROUP BY 1),
 judged AS (SELECT run, total, CASE r WHEN 2 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS stakes, list_filter(list_concat([CASE WHEN r IS NULL THEN 'stakes-undeclared' END, CASE WHEN dangling > 0 THEN 'dangling-findings(' || dangling || ')' END],
  CASE r WHEN 2 THEN {_issues('high')} WHEN 1 THEN {_issues('med')} ELSE {_issues('low')} END), lambda x: x IS NOT NULL) AS issues FROM flat LEFT JOIN ranks USING (run))
 SELECT run, stakes, CAST(total AS BIGINT) AS total, array_to_string(issues, ';') AS issues, len(issues) = 0 AS passed FROM judged"""
HARVEST = f"""WITH {_FINDINGS}, {_ARTIFACTS}, used AS (SELECT run, count(*) AS findings, count(*) FILTER (label = 'CORRECTED') AS corrections, coalesce(list_sort(list_distinct(list({_modality('a.type')}) FILTER (a.type IS NOT NULL))), []) AS used
 FROM findings f LEFT JOIN artifacts a USING (artifact_id) GROUP BY 1) SELECT run, findings, corrections, array_to_string(used, ',') AS used, array_to_string(list_filter({_list(sorted(web.MODALITIES))}, lambda m: NOT list_contains(used, m)), ',') AS gaps FROM used"""
_RUNS = f"""{_FINDINGS}, {_ARTIFACTS}, {_PREDICTIONS}, runs0 AS (SELECT source AS run, min(doc_id) AS d FROM documents GROUP BY 1),
 runs AS (SELECT run, CASE d % 3 WHEN 0 THEN '2024-07-01T00:00:00Z' ELSE '2024-12-31' END AS created, CASE d % 4 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'RECON' WHEN 2 THEN 'ALPHA' ELSE 'unlabeled' END AS label FROM runs0),
 facts AS (SELECT run, count(*) AS findings, count(DISTINCT CASE WHEN m <> 'other' THEN m END) AS n_modalities, count(DISTINCT host) AS n_hosts, coalesce(bool_or(polarity = 'disconfirms'), false) AS has_disconfirm, count(DISTINCT m) AS n_all
  FROM (SELECT f.*, a.host, CASE WHEN a.artifact_id IS NULL THEN 'other' ELSE {_modality('a.type')} END AS m FROM findings f LEFT JOIN artifacts a USING (artifact_id)) GROUP BY run),
 foretold AS (SELECT DISTINCT f.run, true AS has_prediction FROM predictions p JOIN findings f USING (seq)), starters AS (SELECT DISTINCT min(source) AS run FROM (SELECT *, {_HYP} AS h FROM documents) GROUP BY h),
 profiles AS (SELECT run, created, label, findings, n_modalities, n_hosts, coalesce(has_prediction, false) AS has_prediction, has_disconfirm,
  list_filter([CASE WHEN label = 'RECON' AND n_modalities <= 1 THEN 'single-modality' END, CASE WHEN label = 'RECON' AND has_prediction IS NULL THEN 'no-prediction' END, CASE WHEN label = 'RECON' AND NOT has_disconfirm THEN 'no-disconfirm' END,
   CASE WHEN label = 'RECON' AND n_hosts < 3 THEN 'thin-hosts' END], lambda x: x IS NOT NULL) AS gaps,
  list_filter([CASE WHEN label = 'ALPHA' AND n_modalities >= 2 AND n_all >= 2 THEN 'modality-expansion' END, CASE WHEN label = 'ALPHA' AND has_disconfirm THEN 'disconfirm-added' END, CASE WHEN label = 'ALPHA' AND n_hosts >= 3 THEN 'host-diversification' END],
   lambda x: x IS NOT NULL) AS corrections FROM runs JOIN starters USING (run) JOIN facts USING (run) LEFT JOIN foretold USING (run))"""
HARVEST_RUNS = f"WITH {_RUNS} SELECT * REPLACE (array_to_string(gaps, ',') AS gaps, array_to_string(corrections, ',') AS corrections) FROM profiles"
HARVEST_COUNTS = f"""WITH {_RUNS} SELECT 'label' AS what, label AS name, count(*) AS n FROM profiles GROUP BY ALL UNION ALL SELECT 'gaps', g, count(*) FROM (SELECT unnest(gaps) AS g FROM profiles) GROUP BY ALL
 UNION ALL SELECT 'corrections', g, count(*) FROM (SELECT unnest(corrections) AS g FROM profiles) GROUP BY ALL"""
CORRECTION_PARTS = f"""WITH {_RUNS}, parts AS (SELECT run, n_hosts, unnest(corrections) AS type FROM profiles), met AS (SELECT f.run, f.seq, polarity, coalesce(a.host, '') AS host, coalesce({_modality('a.type')}, 'other') AS modality FROM findings f LEFT JOIN artifacts a USING (artifact_id)),
 mods AS (SELECT run, modality, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, min(seq)) AS r FROM met GROUP BY run, modality), hosts AS (SELECT run, host, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, min(seq)) AS r FROM met WHERE host <> '' GROUP BY run, host)
 SELECT run, type, CASE WHEN r = 1 THEN 'from' ELSE 'added' END AS part, greatest(r - 1, 1) AS place, modality AS value FROM mods JOIN parts USING (run) WHERE type = 'modality-expansion'
 UNION ALL SELECT run, type, 'source', seq, host FROM met JOIN parts USING (run) WHERE type = 'disconfirm-added' AND polarity = 'disconfirms' AND host <> ''
 UNION ALL SELECT run, type, 'host', r, host FROM hosts JOIN parts USING (run) WHERE type = 'host-diversification' AND r <= 5 UNION ALL SELECT run, type, 'count', 1, CAST(n_hosts AS VARCHAR) FROM parts WHERE type = 'host-diversification'
 UNION ALL SELECT run, type, 'effect', 1, CASE type WHEN 'modality-expansion' THEN 'reached ALPHA' ELSE 'adversarial pass completed' END FROM parts WHERE type <> 'host-diversification'"""
FIRST_CORRECTIONS = f"""WITH {_RUNS} SELECT run, place, type, CASE type WHEN 'modality-expansion' THEN 'reached ALPHA' WHEN 'disconfirm-added' THEN 'adversarial pass completed' ELSE '' END AS effect
 FROM (SELECT run, unnest(corrections) AS type, generate_subscripts(corrections, 1) AS place FROM profiles) ORDER BY run, place LIMIT 10"""
RUN_THESES = f"""WITH {_FINDINGS}, theses AS (SELECT hypothesis_id, min(seq) AS s, min(run) AS run, arg_min(text, seq) AS thesis FROM findings GROUP BY 1)
 SELECT run, substr(coalesce(arg_max(thesis, s), ''), 1, 100) AS thesis, CASE arg_max(hypothesis_id, s) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS stakes FROM theses GROUP BY run"""
TOP_HOSTS = f"""WITH {_FINDINGS}, {_ARTIFACTS}, counts AS (SELECT run, host, count(*) AS n, min(f.seq) AS s FROM findings f JOIN artifacts a USING (artifact_id) GROUP BY ALL)
 SELECT run, place, host, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, s) AS place FROM counts) WHERE place <= 5"""
REGISTRY_CHECK = f"""WITH {_FACTS}, records AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 97 = 0 THEN ' ' WHEN o_orderkey % 89 = 0 THEN 'twice' ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders),
 seen AS (SELECT ord, id, trim(id) = '' AS bare, ord > min(ord) OVER (PARTITION BY id) AS twice FROM records),
 issues AS (SELECT ord, id, CASE WHEN bare THEN 'id missing' WHEN twice THEN 'duplicate id' WHEN ord % 79 = 0 THEN 'status unknown' WHEN ord % 83 = 0 OR trim(o_orderpriority) = '' THEN 'claim missing' WHEN ord % 67 = 0 THEN 'source_refs empty'
  WHEN ord % 67 = 1 THEN 'source_refs blank' WHEN ord % 61 = 0 THEN 'scope missing' WHEN ord % 73 = 0 THEN 'observed_at invalid' WHEN ord % 71 = 0 THEN 'ttl_days invalid' END AS issue FROM seen JOIN orders ON o_orderkey = ord)
 SELECT ord, id, issue AS warning FROM issues WHERE issue IS NOT NULL
 UNION ALL SELECT ord, i.id, CASE WHEN freshness <> 'fresh' THEN freshness ELSE s.status END FROM issues i JOIN states s ON s.id = CAST(ord AS VARCHAR) WHERE issue IS NULL AND (freshness <> 'fresh' OR s.status IN {_in(gates.UNHEALTHY)})"""
FRESHNESS = f"WITH {_FACTS} SELECT id, age_days, freshness, status FROM states"
WARNINGS = f"WITH {_FACTS} SELECT id, CASE WHEN freshness <> 'fresh' THEN freshness ELSE status END AS warning FROM states WHERE freshness <> 'fresh' OR status IN {_in(gates.UNHEALTHY)}"
VALIDATION = """WITH a AS (SELECT count(*) AS n, count(*) FILTER (l_quantity <> trunc(l_quantity) OR contains(CAST(l_quantity AS VARCHAR), '.')) AS bad_q, count(*) FILTER (l_extendedprice < 1000) AS low_e, count(*) FILTER (regexp_matches(l_returnflag, '(?i)^r$')) AS junk_r,
  count(*) - count(DISTINCT l_linenumber) AS dup_l, count(l_shipdate) AS ships FROM lineitem)
 SELECT field, issue, CAST(n AS BIGINT) AS n FROM (SELECT 'l_quantity' AS field, 'not_coercible' AS issue, bad_q AS n FROM a UNION ALL SELECT 'l_extendedprice', 'below_min', low_e FROM a UNION ALL SELECT 'l_returnflag', 'junk', junk_r FROM a
  UNION ALL SELECT 'l_linenumber', 'duplicates', dup_l FROM a UNION ALL SELECT 'l_shipdate', 'not_str', ships FROM a UNION ALL SELECT 'l_comment', 'empty_ratio', n FROM a UNION ALL SELECT 'l_tax', 'unknown_type', 1 FROM a UNION ALL SELECT 'l_linestatus', 'invalid_regex', 1 FROM a) WHERE n > 0"""

SAMPLES = """WITH f AS (SELECT l_orderkey AS o, l_linenumber AS i, 'l_extendedprice' AS field, 'below_min' AS issue, CAST(l_extendedprice AS VARCHAR) AS value FROM lineitem WHERE l_extendedprice < 1000
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', 'below_min', CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_quantity < 2 AND NOT contains(CAST(l_quantity AS VARCHAR), '.')
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', 'above_max', CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_quantity > 49 AND NOT contains(CAST(l_quantity AS VARCHAR), '.')
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'above_max', CAST(l_discount AS VARCHAR) FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', 'junk', l_returnflag FROM lineitem WHERE lower(l_returnflag) = 'r')
 SELECT field, issue, place, value FROM (SELECT *, row_number() OVER (PARTITION BY field, issue ORDER BY o, i, value) AS place FROM f) WHERE place <= 3"""
CALIBRATION = f"""WITH RECURSIVE {_RESOLVED}, s AS (SELECT count(*) AS n_resolved, count(*) FILTER (premature) AS n_premature, round(avg((p - y) ** 2), 4) AS brier_all, round(avg((p - y) ** 2) FILTER (anchored), 4) AS brier_anchored FROM done),
 gaps AS (SELECT round(abs(avg(p) - avg(y)), 3) AS gap FROM done GROUP BY least(CAST(trunc(p * 5) AS INTEGER), 4)),
 {_PRED_NEAR}, pred_nodes AS (SELECT hypothesis_id || resolve_by AS g, seq AS n FROM predictions), {_count_components('pred_nodes', 'pnear', 'preds')}
 SELECT n_predictions, n_resolved, n_premature, brier_all, brier_anchored, CASE WHEN n_predictions > 0 THEN round(n_resolved / n_predictions, 3) ELSE 0.0 END AS resolution_rate, round(brier_all - brier_anchored, 4) AS brier_divergence,
 (SELECT coalesce(sum(n_components), 0) FROM preds) AS n_distinct, (SELECT max(gap) FROM gaps) AS worst_bucket_gap FROM s, (SELECT count(*) AS n_predictions FROM predictions)"""
RELIABILITY = f"""WITH {_RESOLVED} SELECT least(CAST(trunc(p * 5) AS INTEGER), 4) AS bucket, count(*) AS n, round(avg(p), 3) AS mean_confidence, round(avg(y), 3) AS hit_rate, round(abs(avg(p) - avg(y)), 3) AS gap FROM done GROUP BY 1"""
_RATE = "round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FILTER ({}), 4)"
SCORECARD = f"""WITH {_CARDS} SELECT *, round(dev_rate - holdout_rate, 4) AS holdout_gap FROM (SELECT count(*) AS n_cards, count(*) AS n_valid, count(*) FILTER (answered) AS n_scored, count(*) FILTER (expired) AS n_expired, count(*) FILTER (NOT expired AND NOT poison) AS n_live,
 {_RATE.format('NOT expired AND NOT poison')} AS pass_rate, {_RATE.format('NOT expired AND NOT poison AND stable')} AS stable_pass_rate, {_RATE.format('NOT expired AND NOT poison AND NOT holdout')} AS dev_rate,
 {_RATE.format('NOT expired AND NOT poison AND holdout')} AS holdout_rate, {_RATE.format('poison AND NOT expired')} AS poison_caught_rate FROM judged)"""
KINDS = f"WITH {_CARDS} SELECT answer_kind, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM judged WHERE NOT expired AND NOT poison GROUP BY 1"
CER = "SELECT p_partkey, round(levenshtein(p_name, p_type) / length(p_name), 4) AS cer FROM part WHERE trim(p_name) <> ''"
_KEY = "regexp_replace(lower({}), '[^가-힣a-z0-9]', '', 'g')"
MATRIX = f"""WITH k AS (SELECT p_partkey, {_KEY.format('p_name')} AS r, {_KEY.format("p_name || ' ' || p_brand")} AS s, {_KEY.format('p_type')} AS o FROM part)
 SELECT p_partkey AS clip, 'small' AS model, CASE WHEN length(r) > 0 THEN round(levenshtein(r, s) / length(r), 3) END AS cer FROM k UNION ALL SELECT p_partkey, 'other', CASE WHEN length(r) > 0 THEN round(levenshtein(r, o) / length(r), 3) END FROM k"""
_BENCH = f"""cells AS (SELECT p_partkey AS clip, s AS source, m AS model, CASE WHEN s = 'raw' AND m = 'large' OR s = 'vocals' AND m = 'small' THEN p_name WHEN s = 'raw' AND m = 'small' THEN p_name || ' ' || p_brand WHEN s = 'raw' THEN p_type WHEN m = 'large' THEN p_name || ' x' END AS text, p_name
  FROM part, (VALUES ('raw'), ('vocals')) a(s), (VALUES ('large'), ('small'), ('other')) b(m)), keyed AS (SELECT *, {_KEY.format('text')} AS t, {_KEY.format('p_name')} AS r, {_KEY.format("CASE WHEN source = 'raw' THEN p_name ELSE p_name || ' x' END")} AS v FROM cells),
 bench AS (SELECT clip, source, model, text, CASE WHEN length(r) > 0 THEN round(levenshtein(r, t) / length(r), 3) END AS cer_raw, CASE WHEN length(v) > 0 THEN round(levenshtein(v, t) / length(v), 3) END AS cer_same FROM keyed)"""
BENCH = f"WITH {_BENCH} SELECT * FROM bench"
BENCH_REPORT = f"""WITH {_BENCH} SELECT DISTINCT clip, '' AS source, 0 AS part, '' AS model, '## ' || clip AS line FROM bench UNION ALL SELECT DISTINCT clip, source, 1, '', '### source = ' || source FROM bench
 UNION ALL SELECT DISTINCT clip, source, 2, '', '| model | CER_raw | CER_same |' FROM bench UNION ALL SELECT DISTINCT clip, source, 3, '', '|---|---|---|' FROM bench
 UNION ALL SELECT clip, source, 4, model, CASE WHEN text IS NULL THEN '| ' || model || ' | ERROR ||' ELSE '| ' || model || ' | ' || coalesce(CAST(cer_raw AS VARCHAR), '-') || ' | ' || coalesce(CAST(cer_same AS VARCHAR), '-') || ' |' END FROM bench
 UNION ALL SELECT clip, source, 5, model, '- **' || model || '**: ' || substr(text, 1, 300) FROM bench WHERE text IS NOT NULL"""
AGREEMENT = f"""WITH k AS (SELECT p_partkey, {_KEY.format('p_name')} AS a, {_KEY.format('p_type')} AS b FROM part)
 SELECT p_partkey AS clip, round(100 * (1 - (CASE WHEN length(a) = 0 THEN 0.0 ELSE round(levenshtein(a, b) / length(a), 4) END + CASE WHEN length(b) = 0 THEN 0.0 ELSE round(levenshtein(b, a) / length(b), 4) END) / 2), 1) AS agreement FROM k"""
PREDICTION_DUPLICATES = f"""WITH {_PREDICTIONS}, {_near('predictions', "hypothesis_id || '|' || resolve_by", 'seq', 'claim')}, firsts AS (SELECT b AS seq, min(a) AS a FROM near GROUP BY 1)
 SELECT p.seq, p.prediction_id, a AS near_duplicate_of FROM predictions p LEFT JOIN firsts USING (seq)"""

_ORD = "lpad(CAST({} AS VARCHAR), 20, '0')"
DIGEST = f"""WITH RECURSIVE {_FINDINGS}, {_HYPOTHESES}, {_ARTIFACTS}, {_PREDICTIONS}, {_JUDGED}, warned AS (SELECT hypothesis_id, CASE WHEN mode = 'debunk' THEN b.warning ELSE d.warning END AS warning FROM hypotheses JOIN ({DISCOVER}) d USING (hypothesis_id) JOIN ({DEBUNK}) b USING (hypothesis_id)), theses AS (SELECT hypothesis_id, arg_min(text, seq) AS thesis FROM findings GROUP BY 1)
 SELECT '1-evidence' AS section, {_ORD.format('seq')} AS ord, '[' || type || '] ' || source || ' (gate=' || quality_label || ', sha=' || substr(coalesce(sha256, ''), 1, 12) || ')' AS line FROM artifacts
 UNION ALL SELECT '2-findings', label || '|' || {_ORD.format('seq')}, '(' || label || ') ' || coalesce(text, '') || ' <-' || artifact_id || '@' || locator FROM findings
 UNION ALL SELECT '3-hypotheses', {_ORD.format('hypothesis_id')}, substr(coalesce(thesis, ''), 1, 90) || ' [confirm ' || confirming || ' (distinct ' || confirming_claims || ', hosts ' || confirming_hosts || ', modalities ' || CASE WHEN modalities = '' THEN 0 ELSE len(string_split(modalities, ',')) END
  || ') / disconfirm ' || disconfirming || ' / net ' || net_hosts || '] ' || CASE WHEN warning <> '' THEN '[!' || warning || '] ' ELSE '' END || '[' || label || CASE WHEN reasons <> '' THEN ': ' || reasons ELSE '' END || ']'
  FROM verdicts JOIN warned USING (hypothesis_id) JOIN ({TRIANGULATE}) USING (hypothesis_id) JOIN theses USING (hypothesis_id)
 UNION ALL SELECT '4-predictions', '', n_predictions || ' made, ' || n_distinct || ' distinct, ' || n_resolved || ' resolved, ' || n_premature || ' premature, brier ' || brier_all FROM ({CALIBRATION})
 UNION ALL SELECT '4-predictions', {_ORD.format('p.seq')}, '(conf ' || stated_confidence || ', by ' || resolve_by || ') ' || substr(claim, 1, 100) || CASE WHEN near_duplicate_of IS NOT NULL THEN ' (dup of ' || near_duplicate_of || ')' ELSE '' END
  FROM predictions p JOIN ({PREDICTION_DUPLICATES}) USING (seq)
 UNION ALL SELECT '5-open', {_ORD.format('opened_at')}, CAST(item AS VARCHAR) FROM ({FRONTIER}) WHERE is_open"""

_URL_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
HOSTS = f"SELECT page_id, {_host('url')} AS host, {_URL_HOST} AS full_host FROM pages"


def _type(t: str) -> str:
    h = f"CASE WHEN starts_with({t}, 'http') THEN regexp_extract({t}, '^[a-z]+://([^/?#:]*)', 1) ELSE '' END"
    chain = f"CASE WHEN {_ends(t, web.ENDINGS['video'])} OR ({_any(h, web.VIDEO_HOSTS)} AND {_any(t, web.VIDEO_PATHS)}) THEN 'video'"
    for kind in ("image", "audio", "transcript", "csv", "pdf"):
        chain += f" WHEN {_ends(t, web.ENDINGS[kind])} THEN '{kind}'"
    return chain + f" WHEN ends_with({t}, '.json') OR starts_with({h}, 'api.') THEN 'json' WHEN {_ends(t, ('.txt', '.md'))} THEN 'text' WHEN starts_with({t}, 'http') THEN 'html' ELSE 'unknown' END"


TYPES = f"SELECT page_id, kind, {_modality('kind')} AS modality FROM (SELECT page_id, {_type('lower(url)')} AS kind FROM pages)"
_VISIBLE = r"length(trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"
_QUALITY = f"""CASE WHEN status >= 400 THEN 'HTTP_ERROR' WHEN {_VISIBLE} >= 1500 THEN 'OK' WHEN {_any('lower(body)', web.BOT_MARKERS)} THEN 'BOT_WALL' WHEN {_any('lower(body)', web.JS_MARKERS)} THEN 'JS_WALL' WHEN {_any('lower(body)', web.LOGIN_MARKERS)} THEN 'LOGIN_WALL'
 WHEN {_any('lower(body)', web.PAY_MARKERS)} THEN 'PAYWALL' WHEN {_VISIBLE} < 200 THEN 'EMPTY' ELSE 'OK' END"""
WEB_QUALITY = f"WITH {_FETCHED} SELECT page_id, {_QUALITY} AS quality FROM fetched"
INGEST = f"""WITH {_FETCHED}, typed AS (SELECT *, {_type('lower(url)')} AS kind, {_QUALITY} AS quality FROM fetched), firsts AS (SELECT url, min(page_id) AS page_id FROM fetched GROUP BY url)
 SELECT t.page_id AS seq, t.url || '|fetch' AS logical_key, kind AS type, sha256(body) AS sha256, quality AS quality_label, 'a_' || substr(sha256(t.url || '|fetch'), 1, 16) AS artifact_id FROM typed t JOIN firsts USING (page_id)"""
JSON_QUALITY = """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'HTTP_ERROR' WHEN event_id % 7 = 0 THEN 'MALFORMED' WHEN event_id % 7 = 1 THEN 'API_ERROR' WHEN event_id % 7 = 2 THEN 'EMPTY' WHEN event_id % 7 = 3 THEN 'API_ERROR'
 WHEN NOT json_valid(props) THEN 'MALFORMED' WHEN json_exists(props, '$.error') OR json_exists(props, '$.errors') THEN 'API_ERROR' WHEN regexp_full_match(props, '\\s*(\\{\\s*\\}|\\[\\s*\\]|null|"")\\s*') THEN 'EMPTY' ELSE 'OK' END AS quality FROM events"""
_BLOCK = f"""CASE WHEN unpassed THEN 'blocked' WHEN status IN (404, 410) OR status >= 500 THEN 'http_error' WHEN status = 403 THEN CASE WHEN marked THEN 'blocked' ELSE 'suspect' END WHEN status >= 400 THEN 'http_error' WHEN n = 0 THEN 'empty_shell'
 WHEN marked AND n < 3000 THEN 'blocked' WHEN hit THEN 'ok' WHEN marked AND hit = false THEN 'blocked' WHEN marked THEN 'suspect' WHEN js THEN 'js_wall' WHEN hit = false AND n < 3000 THEN 'empty_shell' WHEN hit = false THEN 'suspect' ELSE 'weak_ok' END"""
_BLOCKED = f"{_FETCHED}, seen AS (SELECT *, length(body) AS n, {_any('lower(body)', web.CHALLENGE_MARKERS)} AS marked, {_any('lower(body)', web.JS_MARKERS)} AS js FROM fetched), verdicts AS (SELECT *, {_BLOCK} AS verdict FROM seen)"
SOFTBLOCK = f"WITH {_BLOCKED} SELECT page_id, verdict FROM verdicts"
_ROBOTS = f"""hosts AS (SELECT DISTINCT {_URL_HOST} AS host FROM pages), asked AS (SELECT DISTINCT url, {_URL_HOST} AS host, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '#.*$', '') AS raw FROM pages),
 paths AS (SELECT url, host, CASE WHEN raw = '' OR starts_with(raw, '?') THEN '/' || raw ELSE raw END AS path FROM asked)"""
ROBOTS = rf"""WITH {_ROBOTS}, rules AS (SELECT 'allow' AS kind, '^/fr/.*\?page' AS pattern, 10 AS n UNION ALL SELECT 'disallow', '^/fr/', 4 UNION ALL SELECT 'disallow', '^/de/.*\.html$', 11),
 best AS (SELECT url, arg_max(kind, (n, kind = 'allow')) AS kind FROM paths JOIN rules ON regexp_matches(path, pattern) GROUP BY url) SELECT url, coalesce(kind, 'allow') = 'allow' AS allowed FROM paths LEFT JOIN best USING (url)"""
OPTOUT = rf"""WITH {_ROBOTS}, rules AS (SELECT 'allow' AS kind, '^/fr/.*\?page' AS pattern, 10 AS n UNION ALL SELECT 'disallow', '^/fr/', 4 UNION ALL SELECT 'disallow', '^/de/.*\.html$', 11),
 best AS (SELECT url, arg_max(kind, (n, kind = 'allow')) AS kind FROM paths JOIN rules ON regexp_matches(path, pattern) GROUP BY url),
 met AS (SELECT url, length(host) % 7 <> 1 AND (length(host) % 7 = 0 OR length(host) % 11 <> 2) AS readable, length(host) % 7 <> 0 AND coalesce(kind, 'allow') = 'disallow' AS refused, length(host) % 5 = 0 AND length(host) % 7 NOT IN (0, 1) AND length(host) % 11 <> 2 AS licensed, length(url) % 6 = 0 AS noai
  FROM paths LEFT JOIN best USING (url)),
 signalled AS (SELECT *, list_filter([CASE WHEN readable AND refused THEN 'robots-disallow' END, CASE WHEN noai THEN 'noai-meta' END, CASE WHEN licensed THEN 'rsl-license' END], lambda x: x IS NOT NULL) AS s FROM met)
 SELECT url, CASE WHEN readable AND refused THEN 'disallowed' WHEN NOT readable THEN 'unknown' WHEN len(s) > 0 THEN 'conditional' ELSE 'allowed' END AS posture, array_to_string(s, ',') AS signals FROM signalled"""
ACQUIRE = f"""WITH {_BLOCKED}, states AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'refused_optout' WHEN 1 THEN 'undecidable_optout' WHEN 2 THEN 'needs_consent' ELSE CASE WHEN page_id % 14 = 3 THEN 'fetch_error' WHEN body IS NULL THEN 'fetch_invalid'
 WHEN verdict IN ('blocked', 'empty_shell') THEN 'blocked' WHEN verdict = 'http_error' THEN 'http_error' WHEN verdict = 'js_wall' THEN 'js_wall' WHEN page_id % 15 = 4 THEN 'parse_error' WHEN page_id % 8 = 0 THEN 'parse_empty'
 WHEN page_id % 4 = 0 THEN CASE WHEN verdict = 'suspect' THEN 'suspect' ELSE 'ok_unvalidated' END WHEN page_id % 3 > 0 THEN 'validation_failed' WHEN verdict = 'suspect' THEN 'ok_suspect' ELSE 'ok' END END AS state FROM verdicts)
 SELECT CAST(page_id AS VARCHAR) AS url, state, state IN ('ok', 'ok_unvalidated') AS ok FROM states"""

RUNS = f"WITH {_WORDS} SELECT transcript_id, longest FROM runs"
DELOOP = r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text || ' la la la la ' || text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM conversations)
 SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: i <= 2 OR ws[i] <> ws[i - 1] OR ws[i] <> ws[i - 2]), lambda i: ws[i]), ' ') AS text FROM w"""
COVERAGE = f"""WITH {_WORDS}, segs AS (SELECT conv_id AS transcript_id, count(*) AS n_segments, sum((length(text) % 50) / 10) FILTER (turn % 10 < 5) AS v, avg(-(length(text) % 20) / 10) FILTER (turn % 10 < 5) AS l, max(turn) * 5.0 + 5.0 AS duration FROM conversations GROUP BY 1),
 garbage AS (SELECT transcript_id, CASE WHEN n < 6 THEN NULL WHEN tiny / n > 0.5 THEN 'tiny_tokens' WHEN longest >= greatest(8, floor(n * 0.25)) THEN 'repeat_loop' WHEN u / n < 0.35 THEN 'low_diversity' END AS reason
  FROM (SELECT transcript_id, count(*) AS n, count(DISTINCT word) AS u, count(*) FILTER (regexp_full_match(word, '\\d+') OR length(word) <= 1) AS tiny FROM words GROUP BY 1) JOIN runs USING (transcript_id)),
 facts AS (SELECT transcript_id, n_segments, round(coalesce(v, 0), 6) AS v, round(round(coalesce(v, 0), 6) / duration, 3) AS ratio, round(l, 3) AS mean_logprob, reason, CASE WHEN transcript_id % 4 = 0 THEN 0.01 ELSE 0.05 END AS rms FROM segs LEFT JOIN garbage USING (transcript_id)),
 judged AS (SELECT *, CASE WHEN v < 0.8 THEN CASE WHEN rms > 0.02 THEN 'NO_SPEECH_OR_MASKED' ELSE 'SILENT' END WHEN ratio < 0.5 AND rms > 0.02 THEN 'COVERAGE_GAP' WHEN mean_logprob < -1.0 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS s FROM facts)
 SELECT transcript_id, n_segments, round(v, 1) AS voiced_sec, ratio AS coverage_ratio, mean_logprob, reason, CASE WHEN reason IS NOT NULL AND s IN ('OK', 'LOW_CONFIDENCE') THEN 'DEGENERATE' ELSE s END AS status FROM judged"""


VIOLATIONS = f"""WITH {_FINDINGS}, {_ARTIFACTS} SELECT seq, 'unknown artifact' AS violation FROM findings f WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.artifact_id = f.artifact_id)
 UNION ALL SELECT DISTINCT seq, 'unknown corroborator' FROM (SELECT seq, unnest(corroborated_by) AS c FROM findings) WHERE c NOT IN (SELECT artifact_id FROM artifacts)"""
MISSING = "SELECT c_custkey AS id, n, n IS NULL AS missing FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey"
DURATIONS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 * 3600 ELSE 0 END + o_orderkey % 60 * 60 + CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 60 ELSE 0 END AS seconds FROM orders"
MISMATCHES = f"""SELECT conclusion_id, '[FAIL ' || (conclusion_id % 5) || '] ' || conclusion_id || ': expected ' || e || ', got ' || overall AS line FROM (SELECT *, CASE WHEN conclusion_id % 2 = 0 THEN 'MEETS' ELSE 'SHORTFALL' END AS e FROM ({GRADE})) WHERE overall <> e"""
CONFORMANCE = f"""SELECT conclusion_id % 5 AS area, count(*) AS n, count(*) FILTER (overall = CASE WHEN conclusion_id % 2 = 0 THEN 'MEETS' ELSE 'SHORTFALL' END) AS passed,
 count(*) FILTER (overall <> CASE WHEN conclusion_id % 2 = 0 THEN 'MEETS' ELSE 'SHORTFALL' END) AS failed FROM ({GRADE}) GROUP BY 1"""
