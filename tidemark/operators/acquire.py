"""Crawl permission and acquisition: robots rules, opt-out posture, the state of each fetch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.sources.storage import importable

NOAI = ("noai", "noimageai", "noml")


def robots_groups(robots: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """Parsed robots files, one row for each line of a group: ``host, grp, agents, kind, value, pos``.

    A user-agent line opens a group unless the one before it was such a line too; comment, blank and
    licence lines do not break such a run, other fields do.  Lines before any group count for none.
    """
    line = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    lines = robots.select(host, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "raw")).select(host, "pos", line.alias("line")).filter(F.col("line").contains(":"))
    parts = lines.select(host, "pos", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("kind"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy(host).orderBy("pos")
    ruled = parts.filter("kind != 'license' OR value = ''")
    starts = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
    grouped = ruled.withColumn("_s", starts.cast("int")).withColumn("grp", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s").filter("grp > 0")
    agents = grouped.filter("kind = 'user-agent'").groupBy(host, "grp").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("agents"))
    return grouped.join(agents, [host, "grp"])


def licences(robots: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """Hosts whose robots file names a licence."""
    return robots.filter(F.col(text).rlike(r"(?im)^\s*license\s*:\s*[^\s#]")).select(host).distinct()


def product_tokens(agent: Column) -> Column:
    """The product names of a user agent, lower case."""
    return F.array_distinct(F.filter(F.transform(F.split(F.trim(F.coalesce(agent, F.lit(""))), r"[\s();,]+"), lambda x: F.lower(F.split(x, "/")[0])), lambda x: x != ""))


def rule_pattern(value: Column) -> Column:
    """A robots path rule as a regular expression: ``*`` matches anything, a final ``$`` the end."""
    open_ = F.regexp_replace(value, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(open_, r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), escaped, F.when(value.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def robots_decision(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Whether robots rules let each page (``url``) be fetched by ``agent``: ``url, host, allowed``.

    Of a group's rules that match path and query the longest decides, an allow among equals; every group
    for one of the agent's products must allow, else those for ``*``.  Without a rule a page is allowed.

    Rules are found by their literal beginnings, so a page meets those only that it may match; patterns are tried on
    wildcard rules alone.
    """
    groups = robots_groups(robots)
    names = product_tokens(F.lit(agent))
    own = groups.withColumn("specific", F.size(F.array_intersect(F.array_remove("agents", "*"), names)) > 0)
    hosts = own.groupBy("host").agg(F.bool_or("specific").alias("any_specific"))
    applied = own.join(hosts, "host").filter(F.col("specific") | ~F.col("any_specific") & F.array_contains("agents", "*"))
    literal = F.regexp_extract("value", r"(?s)^(.*?)(?:\*.*|\$)?$", 1)
    ruled = applied.filter("kind IN ('allow', 'disallow') AND value != ''").select("host", "grp", "kind", "value", literal.alias("start")).distinct()
    rules = ruled.withColumn("pattern", F.when(F.col("start") != F.col("value"), rule_pattern(F.col("value"))))
    asked = pages.select("url", web.host_name(F.col("url")).alias("host"), web.path_and_query(F.col("url")).alias("path"))
    # What stands before a rule's first wildcard is looked up among the beginnings of the path, of the lengths that the host's rules have.
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("start")).alias("sizes"))
    begins = asked.join(sizes, "host").select("url", "host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).withColumn("start", F.expr("left(path, n)"))
    matched = begins.join(rules, ["host", "start"]).filter(F.expr("pattern IS NULL OR path RLIKE pattern"))
    best = matched.groupBy("url", "host", "grp").agg(F.max_by("kind", F.struct(F.length("value"), (F.col("kind") == "allow").alias("a"))).alias("kind"))
    refused = best.filter("kind = 'disallow'").select("url", "host").distinct().withColumn("refused", F.lit(True))
    return asked.join(refused, ["url", "host"], "left").select("url", "host", F.col("refused").isNull().alias("allowed"))


#: Comments, declarations, raw text and quoted attributes are consumed whole, so a tag within them is none.
_MARKUP = (
    r"""(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*>|<(script|style)(?=[\s/>])[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>.*?(?:</\1(?=[\s/>])|\z)"""
    r"""|<meta(?=[\s/>])[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|</?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
)
_ATTRIBUTE = r"""(?s)([^\s"'>/=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|(?!["'])[^>\s]*))?"""


def meta_tags(html: Column) -> Column:
    """The meta tags of a page in order: an array of ``name`` (or property, or http-equiv) and ``content``, lower case.

    Tags in comments, scripts and styles are none; attributes may stand in any order and quoting, hold ``>`` in
    quotes, and repeat, when the last counts.  A tag that isn't closed is none.  Character references aren't decoded.
    """
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_MARKUP), F.lit(0)), lambda t: t.rlike(r"^(?i)<meta[\s/>]"))
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"^(?i)<meta", ""), r"/?>\z", "")

    def read(t: Column) -> Column:
        names, values = (F.regexp_extract_all(inner(t), F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
        pairs = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.struct(F.lower(x["k"]).alias("k"), F.regexp_replace(x["v"], r"""(?s)^(["'])(.*)\1$""", "$2").alias("v")))
        last = lambda n: F.lower(F.coalesce(F.try_element_at(F.filter(pairs, lambda x: x["k"] == n), F.lit(-1))["v"], F.lit("")))
        one = lambda *ns: F.coalesce(*[F.when(last(n) != "", last(n)) for n in ns], F.lit(""))
        return F.struct(one("name", "property", "http-equiv").alias("name"), last("content").alias("content"))

    return F.filter(F.transform(tags, read), lambda m: m["name"] != "")


def meta_signals(html: Column, headers: Column | None = None) -> Column:
    """Sorted opt-out signals of a page's meta tags and headers (a map of lower-case names): tdmrep, noai, noimageai, noml."""
    tags = meta_tags(html)
    robots = F.array_join(F.transform(F.filter(tags, lambda m: F.trim(m["name"]).isin("robots", "x-robots-tag")), lambda m: m["content"]), " ")
    head = lambda n: F.lower(F.coalesce(headers[n], F.lit(""))) if headers is not None else F.lit("")
    said = F.concat(robots, F.lit(" "), head("x-robots-tag"))
    reserved = F.exists(tags, lambda m: (F.trim(m["name"]) == "tdm-reservation") & (F.trim(m["content"]) == "1")) | (F.trim(head("tdm-reservation")) == "1")
    return F.array_compact(F.array(*[F.when(said.rlike(rf"\b{n}\b"), F.lit(n)) for n in NOAI], F.when(reserved, F.lit("tdmrep"))))


def optout(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The posture towards each page (``url, html``, optional map ``headers``): ``url, posture, signals``.

    ``robots`` has (host, status, content_type, text); what can't be read is unknown, never allowed; a
    missing file (404) allows all.
    """
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    plain = (F.col("status") == 200) & kind.isin("text/plain", "text/x-robots")
    read = robots.withColumn("readable", plain | (F.col("status") == 404)).withColumn("text", F.when(plain, F.col("text")).otherwise(F.lit("")))
    allowed = robots_decision(pages, read, agent).groupBy("url", "host").agg(F.bool_and("allowed").alias("allowed"))
    licensed = licences(read).withColumn("licensed", F.lit(True))
    signals = meta_signals(F.col("html"), F.col("headers") if "headers" in pages.columns else None)
    met = pages.select("url", signals.alias("found")).join(allowed, "url").join(read.select("host", "readable"), "host", "left").join(licensed, "host", "left")
    ok, free = F.coalesce("readable", F.lit(False)), F.coalesce("licensed", F.lit(False))
    every = F.array_compact(F.array(F.when(ok & ~F.col("allowed"), F.lit("robots-disallow")), F.when(F.array_contains("found", "tdmrep"), F.lit("tdmrep")), F.when(F.size(F.array_remove("found", "tdmrep")) > 0, F.lit("noai-meta")), F.when(free, F.lit("rsl-license"))))
    posture = F.when(ok & ~F.col("allowed"), "disallowed").when(~ok, "unknown").when(F.size(every) > 0, "conditional").otherwise("allowed")
    return met.select("url", posture.alias("posture"), F.array_join(every, ",").alias("signals"))


def acquisition_state(fetched: DataFrame, consent: bool = False) -> DataFrame:
    """Where each acquisition stopped: ``url, state, ok``.

    ``fetched`` has (url, posture, fetch_failed, body, status, hit, unpassed, parse_failed, n_rows, has_schema,
    n_issues).  Later gates count only where none before stopped.
    """
    block = web.softblock(F.col("body"), F.col("status"), F.col("hit"), F.col("unpassed"))
    doubt = block == "suspect"
    state = (
        F.when(F.col("posture") == "disallowed", "refused_optout").when(F.col("posture") == "unknown", "undecidable_optout").when((F.col("posture") == "conditional") & (not consent), "needs_consent")
        .when(F.coalesce("fetch_failed", F.lit(False)), "fetch_error").when(F.col("body").isNull(), "fetch_invalid").when(block.isin("blocked", "empty_shell"), "blocked").when(block == "http_error", "http_error")
        .when(block == "js_wall", "js_wall").when(F.coalesce("parse_failed", F.lit(False)), "parse_error").when(F.coalesce("n_rows", F.lit(0)) == 0, "parse_empty")
        .when(~F.coalesce("has_schema", F.lit(False)), F.when(doubt, "suspect").otherwise("ok_unvalidated")).when(F.coalesce("n_issues", F.lit(0)) > 0, "validation_failed").when(doubt, "ok_suspect").otherwise("ok")
    )
    return fetched.select("url", state.alias("state"), state.isin("ok", "ok_unvalidated").alias("ok"))


def parsed(fetched: DataFrame, parser: Callable[[str, str], list[dict]], schema: str, key: str = "url", body: str = "body") -> DataFrame:
    """What a parser makes of each body: ``key, parse_failed, n_rows, rows``; an error of it is a failure of that page only.

    ``parser`` gets address and body and returns records of ``schema``.  Null bodies are passed over.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = fetched.schema[key].dataType.simpleString()
    out = f"{key} {kind}, parse_failed boolean, n_rows long, rows array<struct<{schema}>>"
    arrow = to_arrow_schema(fetched.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    made, failed = parser(k, text), False
                except Exception:  # noqa: BLE001
                    made, failed = [], True
                for c, v in zip(cols, (k, failed, len(made), made), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], names=arrow.names)

    importable(fetched.sparkSession)
    return fetched.filter(F.col(body).isNotNull()).select(key, body).mapInArrow(run, out)
