"""Operators on small cases of their own, with the behaviours that are easily changed by accident."""

from math import exp, log

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import web
from tidemark.operators import acquire, evidence, gates, graph, ledger, media, producers, scoring, trends, validate
from tidemark.sources import audio, jsonl, lines, transcripts

FINDING = "seq long, artifact_id string, text string, quote string, label string, polarity string, conclusion_id string, hypothesis_id string, origin string, corroborated_by array<string>, ts string"
ARTIFACT = "artifact_id string, source string, type string, sha256 string, quality_label string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def finding(seq, art, text="", polarity="confirms", hyp="h", origin="", cb=(), con="c"):
    return (seq, art, text, text, "OBSERVED", polarity, con, hyp, origin, list(cb), "2024-12-31")


def test_hosts(spark):
    cases = {"https://news.bbc.co.uk/x": "bbc.co.uk", "http://www.a.b.example.com": "example.com", "http://10.0.0.1:80/": "10.0.0.1", "nonsense": "", "http://EXAMPLE.org": "example.org", "http://[::1]/": "::1"}
    df = spark.createDataFrame(list(cases.items()), "u string, h string").withColumn("got", web.registrable(F.col("u")))
    assert all(r.h == r.got for r in df.collect())


def test_types_and_quality(spark):
    kinds = {"http://youtube.com/watch?v=1": "video", "http://youtube.com/@c/about": "html", "a.PDF": "pdf", "http://api.x.org/y": "json", "x.md": "text", "x": "unknown", "http://h/a.srt": "transcript"}
    df = spark.createDataFrame(list(kinds.items()), "u string, k string").withColumn("got", web.detect_type(F.col("u")))
    assert all(r.k == r.got for r in df.collect())
    q = lambda body, status=200: one(spark, web.web_quality(F.lit(body), F.lit(status)))
    assert [q("captcha"), q("x" * 300), q("captcha " + "x" * 2000), q("", 404), q("short")] == ["BOT_WALL", "OK", "OK", "HTTP_ERROR", "EMPTY"]
    j = lambda body: one(spark, web.json_quality(F.lit(body), F.lit(200)))
    assert [j("{"), j("{}"), j('{"error": 1}'), j('[{"error": 1}]'), j("[1] 2"), j('{"a": "rate limit"}'), j("")] == ["MALFORMED", "EMPTY", "API_ERROR", "OK", "MALFORMED", "API_ERROR", "MALFORMED"]


def test_softblock_precedence(spark):
    def v(body="x" * 4000, status=200, hit=None, unpassed=False):
        return one(spark, web.softblock(F.lit(body), F.lit(status).cast("string") if status is None else F.lit(status), F.lit(hit).cast("boolean"), F.lit(unpassed)))

    wall = "just a moment"
    assert v(wall, hit=True) == "blocked" and v("", hit=True) == "empty_shell" and v(wall + "x" * 4000, hit=True) == "ok"
    assert v(status="oops") == "suspect" and v(status="200") == "weak_ok" and v(status=None) == "weak_ok" and v(status="oops", unpassed=True) == "blocked"
    assert v(status=404) == "http_error" and v(status=403) == "suspect" and v(wall, 403) == "blocked" and v(wall + "x" * 4000) == "suspect"
    assert v("enable javascript") == "js_wall" and v() == "weak_ok" and v("tiny", hit=False) == "empty_shell" and v(unpassed=True, hit=True) == "blocked"


def test_addresses(spark):
    """Against the standard library's reading of addresses."""
    import ipaddress

    cases = ["2001:0db8:0:0:0:0:0:1", "::1", "::", "1::", "2001:db8:0:0:1:0:0:1", "2001:db8:0:1:1:1:1:1", "::ffff:192.0.2.33", "fe80:0:0:0:200:f8ff:fe21:67cf", "1:2:3:4:5:6:7:8", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3", "FD00::00AB"]
    df = spark.createDataFrame([(c,) for c in [*cases, "1:2:3", "g::1", "1:::2", "1::2::3"]], "h string").select("h", web.ipv6_compressed(F.col("h")).alias("x"), web.registrable(F.concat(F.lit("http://["), "h", F.lit("]/p"))).alias("r"))
    got = {r.h: (r.x, r.r) for r in df.collect()}
    for c in cases:
        # Those of mapped addresses are written in hexadecimal digits, which are those of the same address.
        assert ipaddress.ip_address(got[c][0]) == ipaddress.ip_address(c) and got[c][1] == got[c][0]
        assert "." in c or got[c][0] == ipaddress.ip_address(c).compressed
    assert [got[c][0] for c in ("1:2:3", "g::1", "1:::2", "1::2::3")] == [None] * 4
    closed = ["", "127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.169.254", "224.0.0.1", "240.0.0.1", "0.0.0.0", "::1", "::", "fe80::1", "fc00::1", "ff02::1"]
    free = ["8.8.8.8", "172.32.0.1", "example.com", "2606:4700::1111", "1.2.3", "192.169.0.1"]
    df = spark.createDataFrame([(c,) for c in closed + free], "h string").select("h", web.closed_host(F.col("h")).alias("x"))
    assert {r.h for r in df.collect() if r.x} == set(closed)
    paths = {"refs/a.html": True, "/etc/passwd": False, "/home/x/../../etc/passwd": False, "/etcetera/x": True, "C:\\Windows\\x": False, "c:/program files/x": False, "research/r_1/../x": True, "/dev": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", web.open_path(F.col("p")).alias("x"))
    assert {r.p: r.x for r in df.collect()} == paths


def test_dates_and_numbers(spark):
    days = {"2024-06-01": True, " 2024-6-1 ": True, "2024-06-01T00:00": False, "2024-13-01": False, "": False, None: False}
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", web.strict_date(F.col("d")).isNotNull().alias("ok"), web.date_of(F.col("d")).isNotNull().alias("begins"))
    assert {r.d: r.ok for r in df.collect()} == days and {r.d for r in df.collect() if r.begins} == {"2024-06-01", " 2024-6-1 ", "2024-06-01T00:00"} - {" 2024-6-1 "}
    numbers = {"costs 1,234 won": 1234.0, "-5 then 6": -5.0, "1e6": 1e6, "1,2,3": 1.0, "3.50": 3.5, "none": None, "12,34": 12.0, "1,234,567.8e-1": 123456.78}
    df = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", tx.first_number(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == numbers


def test_registry(spark):
    rows = [(0, "a", "c", "observed", ["s"], "x", "2024-06-01", None, 5), (1, "a", "c", "observed", ["s"], "x", "2024-06-01", None, 5), (2, " ", "c", "observed", ["s"], "x", "2024-06-01", None, 5), (3, "b", "c", "rumour", ["s"], "x", "2024-06-01", None, 5)]
    rows += [(4, "b", "c", "observed", ["s"], "x", "2024-06-01", None, 5), (5, "d", "c", "dead", ["s"], "x", "2024-06-01T00:00", None, 5), (6, "e", "c", "dead", ["s"], "x", "2024-06-01", None, 50), (7, "f", "c", "observed", [], "x", "2024-06-01", None, 5), (8, "g", "c", "observed", ["s"], "x", "2024-06-01", "soon", 5)]
    facts = spark.createDataFrame(rows, "ord int, id string, claim string, status string, source_refs array<string>, scope string, observed_at string, effective_at string, ttl_days int")
    got = {r.ord: r.warning for r in gates.registry_check(facts, "2024-06-10").collect()}
    assert got == {0: "stale", 1: "duplicate id", 2: "id missing", 3: "status unknown", 4: "duplicate id", 5: "observed_at invalid", 6: "dead", 7: "source_refs empty", 8: "effective_at invalid"}


def test_text_functions(spark):
    assert one(spark, tx.error_rate(F.lit("abcde"), F.lit("abxde"))) == 0.2
    assert one(spark, tx.error_rate(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, tx.error_rate(F.lit("가나다"), F.lit("가다"))) == 0.3333
    assert one(spark, tx.deloop(F.lit("a b b b b c c a"))) == "a b b c c a"
    assert one(spark, tx.numbers(F.lit("1,234 and 3.0 and 1,2,3"))) == [1.0, 2.0, 3.0, 1234.0]
    assert one(spark, tx.tokens(F.lit("The Market from 서울 is big and growing"))) == ["market", "서울", "growing"]
    # Words alone never meet runs of three, so a short near copy is missed by shingles and found by words.
    a, b = tx.tokens(F.lit("prices rise")), tx.tokens(F.lit("prices rise fast"))
    assert one(spark, tx.jaccard(tx.shingles(a), tx.shingles(b))) == 0.0 and one(spark, tx.text_similarity(a, b)) > 0.6


def test_half_life_recovers_decay(spark):
    start, rows, total = 1_700_000_000, [], 0.0
    for k in range(30):
        total += 5000 * exp(-log(2) / 72 * k * 6) * 6
        rows.append(("v", start + k * 6 * 3600, k, int(total)))
    snaps = spark.createDataFrame([*rows, ("few", start, 0, 1), ("few", start, 1, 2), ("few", start + 1, 2, None)], "id string, s long, seq long, views long").withColumn("at", F.timestamp_seconds("s"))
    out = {r.id: r for r in trends.half_life(trends.velocity_series(snaps)).collect()}
    assert out["v"].status == "ok" and abs(out["v"].half_life_days - 3) < 0.2 and "few" not in out
    report = trends.watch_report(spark.createDataFrame([(1, "v"), (2, "none")], "ord int, id string"), snaps).orderBy("ord").collect()
    assert report[0].snapshots == 30 and report[1].snapshots == 0 and report[1].status == "insufficient_data"


def test_chart_skips_days_without_a_snapshot(spark):
    rows = [("r", "2024-01-01 01:00", 1, "a", 1), ("r", "2024-01-01 09:00", 2, "b", 1), ("r", "2024-01-05 09:00", 3, "c", 1), ("r", "2024-01-05 09:00", 4, "b", 2)]
    chart = spark.createDataFrame(rows, "region string, t string, seq long, id string, rank int").selectExpr("region", "timestamp(t) AS at", "seq", "id", "rank", "id AS title", "id AS channel")
    daily = {str(r.day): (r.entries, r.exits, r["size"]) for r in trends.chart_daily(chart).collect()}
    assert daily == {"2024-01-01": (1, 0, 1), "2024-01-05": (1, 0, 2)}
    assert {r.id: r.days_on_chart for r in trends.chart_residence(chart).collect()} == {"b": 2, "c": 1}


def test_frontier_reopened_item_stays_closed_too(spark):
    ev = spark.createDataFrame([("a", "open", 1), ("a", "close", 2), ("a", "open", 3), ("b", "close", 4), ("b", "visit", 5)], "item string, op string, seq long")
    out = {r["item"]: r for r in ledger.frontier_state(ev).collect()}
    assert out["a"].is_open and out["a"].is_closed and out["a"].opened_at == 3 and not out["b"].is_open and out["b"].is_visited


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (10, 11), (3, 5), (7, 7), (None, 1)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(5, 3), (4, 3), (11, 10)}
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    assert graph.components(edges.limit(0)).count() == 0


def test_grade_and_order(spark):
    arts = spark.createDataFrame([("a1", "http://x.com/1", "html", "h", "OK"), ("a2", "http://y.com/1", "json", "h", "OK"), ("a3", "http://y.com/2", "html", None, "OK")], ARTIFACT)
    pubs = spark.createDataFrame([(1, "a1", "2024-12-01"), (2, "a2", "2030-01-01")], "seq long, artifact_id string, published_at string")
    rows = [finding(1, "a1", "revenue reached 100 million", cb=["a2"]), finding(2, "a3", "revenue reached 120 million")]
    knobs = {"min_independent_sources": 2, "min_distinct_hosts": 2, "max_age_days": 60, "fatal_domains": ["breadth", "consistency"]}
    for order in (rows, rows[::-1]):
        r = evidence.grade(spark.createDataFrame(order, FINDING), arts, pubs, knobs).first()
        assert (r.effective_sources, r.distinct_hosts, r.breadth_met, r.recency_met, r.consistency_met, r.traceability_met, r.overall) == (2, 2, True, True, False, False, "SHORTFALL")
    f = spark.createDataFrame(rows, FINDING)
    assert evidence.grade(f, arts, pubs, {}).first().overall == "UNGRADED"
    assert evidence.grade(f, arts, pubs, {"fatal_domains": ["traceability"]}).first().overall == "SHORTFALL"
    assert evidence.grade(f, arts, pubs.limit(0), {"max_age_days": 10, "fatal_domains": ["recency"]}).first().overall == "UNKNOWN"
    assert evidence.grade(f, arts, pubs, {"min_distinct_hosts": 1, "fatal_domains": "breadth"}).first().overall == "UNGRADED"
    # A corroborating artifact takes over the citing quote, so a declared similarity makes both one source.
    assert evidence.grade(f, arts, pubs, knobs | {"dup_similarity": 0.9}).first().effective_sources == 1


def test_verdicts(spark):
    arts = spark.createDataFrame([(f"a{i}", f"http://h{i}.com/", "html" if i % 2 else "pdf", "h", "OK") for i in range(6)], ARTIFACT)
    rows = [finding(i, f"a{i}", f"claim number {'abcdef'[i]}xyz stands apart{i}", hyp="three") for i in range(3)] + [finding(10 + i, f"a{i}", "same words in every outlet today", hyp="one", origin="wire") for i in range(3)]
    rows += [finding(20, "a1", "x", hyp="tie"), finding(21, "a2", "x", "disconfirms", hyp="tie"), finding(22, "a3", "x", hyp="tie"), finding(23, "a4", "x", "disconfirms", hyp="tie")]
    tri = evidence.triangulate(spark.createDataFrame(rows, FINDING), arts)
    got = {r.hypothesis_id: r for r in tri.collect()}
    assert got["three"].confirming_origins == 3 and got["one"].confirming_origins == 1 and got["one"].confirming_hosts == 3 and got["one"].confirming_claims == 1
    extra = {"stakes": F.lit("high"), "raw_predictions": F.lit(1), "distinct_predictions": F.lit(1)}
    found = {r.hypothesis_id: r for r in evidence.discover_verdict(tri.withColumns(extra)).collect()}
    assert found["three"].label == "ALPHA" and found["one"].reasons == "echoed-claims(3->1),thin-independence(1<3)" and found["one"].warning
    judged = {r.hypothesis_id: r for r in evidence.debunk_verdict(tri.withColumns(extra)).collect()}
    assert judged["three"].label == "CONFIRMED-FALSE" and judged["tie"].label == "UNRESOLVED" and "balanced-evidence" in judged["tie"].reasons
    mixed = evidence.verdict(tri.withColumns(extra | {"mode": F.when(F.col("hypothesis_id") == "three", "debunk").otherwise("odd")}))
    assert {r.hypothesis_id: r.label for r in mixed.collect()} == {"three": "CONFIRMED-FALSE", "one": "RECON", "tie": "RECON"}


def test_echo_clusters_catch_short_copies(spark):
    rows = [finding(1, "a", "prices rise", hyp="h"), finding(2, "b", "prices rise fast", hyp="h"), finding(3, "c", "something else entirely here", hyp="h")]
    assert [r.echo_clusters for r in evidence.echo_clusters(spark.createDataFrame(rows, FINDING)).collect()] == [1]


def test_calibration_edges(spark):
    preds = spark.createDataFrame([(i, p, "2024-01-01", i) for i, p in enumerate([0.0, 1.0, 0.5, 0.7])], "prediction_id long, stated_confidence double, created string, seq long")
    res = spark.createDataFrame([(0, 1, "miss", False, "2024-02-01"), (1, 2, "hit", False, "2024-01-01"), (2, 3, "hit", False, "2024-02-01"), (2, 4, "unresolved", False, "2024-02-02")], "prediction_id long, seq long, outcome string, anchored boolean, ts string")
    r = scoring.calibration(preds, res).first()
    assert (r.n_predictions, r.n_resolved, r.n_premature, r.brier_all, r.brier_anchored, r.brier_divergence) == (4, 2, 1, 0.0, None, None)
    assert [x.bucket for x in scoring.reliability(preds, res).orderBy("bucket").collect()] == [0, 4]
    assert scoring.calibration(preds.limit(0), res).first().resolution_rate == 0.0


def test_cards(spark):
    schema = "task_id string, answer_kind string, gold_value string, tolerance double, stable boolean, holdout boolean, poison boolean, captured_at string, ttl_days string"
    cards = spark.createDataFrame([
        ("n", "count", "1,010", 1.0, True, False, False, None, None), ("w", "settled-fact", "art", 0.0, False, True, False, None, None), ("p", "api-number", "x", 0.0, False, False, True, None, None),
        ("q", "on-screen-price", "x", 0.0, False, False, True, None, None), ("old", "count", "1", 0.0, True, False, False, "2024-01-01", "0"), ("bad", None, "1", 0.0, True, False, False, None, None),
    ], schema)
    res = spark.createDataFrame([("n", "about 1,011 in all"), ("w", "a party"), ("p", "unknown"), ("old", "1")], "task_id string, answer string")
    got = {r.task_id: (r.passed, r.expired) for r in scoring.judged_cards(cards, res, "2024-01-02").collect()}
    assert got == {"n": (True, False), "w": (False, False), "p": (True, False), "q": (False, False), "old": (True, True)}
    assert scoring.scorecard(cards, res, "2024-01-01").first().n_expired == 0


def test_freshness_boundaries(spark):
    facts = spark.createDataFrame([("ttl", "ok", "2024-01-01", None, 10), ("day", "ok", "2024-01-02", None, 10), ("future", "ok", "2025-01-01", None, 10), ("soon", "ok", "2024-01-05", "2024-02-01", 10), ("dead", "dead", "2024-01-10", None, 10)], "id string, status string, observed_at string, effective_at string, ttl_days int")
    assert {r.id: r.freshness for r in gates.freshness(facts, "2024-01-11").collect()} == {"ttl": "stale", "day": "fresh", "future": "corrupt", "soon": "pending", "dead": "fresh"}
    assert ("dead", "dead") in {tuple(r) for r in gates.registry_warnings(facts, "2024-01-11").collect()}


def test_skills(spark):
    files = spark.createDataFrame([("a", "---\nname: x\nlast_verified: 2024-01-01\n---\nbody"), ("b", "no"), ("c", "---\nname: y\n---\n")], "path string, content string")
    assert {r.path: r.state for r in gates.skill_staleness(files, "2024-01-31").collect()} == {"a": "stale", "b": "missing", "c": "missing"}
    fixed = gates.with_field(files, "last_verified", F.lit("2024-01-30"))
    assert {r.path: r.state for r in gates.skill_staleness(fixed, "2024-01-31").collect()} == {"a": "fresh", "b": "missing", "c": "fresh"}


def test_validation(spark):
    rows = spark.createDataFrame([("1,000", "a", "x"), ("nan", "a", "x"), ("oops", None, "x"), (" ", "b", "x")] * 3, "n string, s string, u string")
    rules = {"n": {"type": "float", "max": 10, "required": True}, "s": {"unique": True, "reject_regex": "A"}, "u": {}, "z": {"type": "date"}, "y": 3, "w": {"reject_regex": "("}}
    got = {(r.field, r.issue): r.n for r in validate.validate(rows, rules, 100).collect()}
    assert got == {("n", "empty_ratio"): 3, ("n", "not_coercible"): 3, ("n", "non_finite"): 3, ("n", "above_max"): 3, ("s", "junk"): 6, ("s", "duplicates"): 7, ("u", "uniform"): 12, ("z", "unknown_type"): 1, ("y", "bad_rule"): 1, ("w", "invalid_regex"): 1, ("_table", "min_rows"): 12}
    assert [r.issue for r in validate.validate(rows.limit(0), rules).collect()] == ["no_rows"]


def test_robots(spark):
    robots = "User-agent: a\n# note\n\nUser-agent: b\nDisallow: /x\nAllow: /x/y\nDisallow: /*.gif$\nDisallow:\nUser-agent: *\nDisallow: /"
    df = spark.createDataFrame([("h.com", 200, "text/plain", robots)], "host string, status int, content_type string, text string")
    urls = [f"http://h.com{p}" for p in ("/x/1", "/x/y", "/a.gif", "/a.gif?q", "/")]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    allowed = lambda agent: [{r.url: r.allowed for r in acquire.robots_decision(pages, df, agent).collect()}[u] for u in urls]
    assert allowed("B/1.0") == [False, True, False, True, True] and allowed("other") == [False] * 5
    full = pages.selectExpr("url", "'' AS html")
    assert {r.posture for r in acquire.optout(full, df.withColumn("status", F.lit(404)), "other").collect()} == {"allowed"}
    assert {r.posture for r in acquire.optout(full, df.withColumn("content_type", F.lit("text/html")), "B").collect()} == {"unknown"}
    assert one(spark, acquire.meta_signals(F.lit("<meta content='x, NOAI' name=robots><meta name=\"tdm-reservation\" content=1>"))) == ["noai", "tdmrep"]


def test_shapes(spark):
    arts = spark.createDataFrame([("a", "http://x/1", "html", "h", "OK")], ARTIFACT)
    f = spark.createDataFrame([("r", i, "a" if i else "gone") for i in range(13)], "run string, seq long, artifact_id string")
    h = spark.createDataFrame([("r", "h1", 1, "high"), ("r", "h1", 2, "low")], "run string, hypothesis_id string, seq long, stakes string")
    r = gates.shape_budget(f, arts, h).first()
    assert (r.stakes, r.total, r.issues) == ("low", 12, "dangling-findings(1)")
    assert gates.shape_budget(f, arts, h.limit(0)).first().issues.startswith("stakes-undeclared")


def test_media(spark):
    segs = spark.createDataFrame([("loop", 0, 0.0, 9.0, "go " * 10, 0.1, -0.2), ("ok", 0, 0.0, 9.0, "one two three four five six seven", 0.1, -0.2), ("count", 0, 0.0, 9.0, "1 2 3 4 5 6 7", 0.1, -0.2)], "transcript_id string, idx int, start double, end double, text string, no_speech_prob double, avg_logprob double")
    clips = spark.createDataFrame([(k, 10.0, 0.05) for k in ("loop", "ok", "count", "none")], "transcript_id string, duration double, rms double")
    got = {r.transcript_id: (r.status, r.reason) for r in media.coverage(segs, clips).collect()}
    assert got == {"loop": ("DEGENERATE", "repeat_loop"), "ok": ("OK", None), "count": ("DEGENERATE", "tiny_tokens"), "none": ("NO_SPEECH_OR_MASKED", None)}
    frames = spark.createDataFrame([("c", 0, 0), ("c", 1, 7), ("c", 2, 255), ("c", 3, 254)], "clip string, idx int, hash long")
    assert [r.idx for r in media.kept_frames(frames).orderBy("idx").collect()] == [0, 2]
    for n in range(1, 40):
        many = spark.range(n).select(F.lit("c").alias("clip"), F.col("id").alias("idx"))
        for cap in (2, 3, 7):
            want = list(range(n)) if n <= cap else sorted({int(i * (n / cap)) for i in range(cap)})
            if n % 6 == cap % 6 or n == 5:
                assert [r.idx for r in media.thin(many, cap, "clip", "idx").orderBy("idx").collect()] == want
    assert media.thin(frames, 0, "clip", "idx").count() == 4
    pixels = spark.createDataFrame([("c", 0, 255, 0, 0), ("c", 0, 0, 0, 0), ("c", 0, 10, 200, 30), ("c", 0, 7, 8, 90)], "clip string, frame int, r int, g int, b int")
    import colorsys

    for r in pixels.select("r", "g", "b", media.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect():
        h, s_, v = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        assert abs(r.x.h - h * 255) < 1.01 and abs(r.x.s - s_ * 255) < 1.01 and r.x.v == round(v * 255)
    assert media.colour_statistics(pixels).first().brightness == round((255 + 0 + 200 + 90) / 4, 1)
    lumas = spark.createDataFrame([("c", 0, i, 200 if i in (0, 5, 63) else 10) for i in range(64)], "clip string, idx int, i int, luma int")
    assert media.average_hash(lumas).first().hash == (1 | 1 << 5 | 1 << 63) - (1 << 64)
    assert media.best_of(spark.createDataFrame([("a", False, 0.81, False, "m"), ("a", False, 0.84, True, "l"), ("a", True, 0.99, True, "x")], "transcript_id string, degenerate boolean, coverage_ratio double, is_strong boolean, model string")).first().model == "l"
    lines = spark.createDataFrame([("a", 0, "Hello."), ("a", 1, "Thanks for watching!"), ("a", 2, "x"), ("a", 3, "x")], "transcript_id string, idx int, text string")
    assert media.strip_boilerplate(lines, ["thanks for watching"]).count() == 3 and media.collapse_repeats(lines).count() == 3
    reads = spark.createDataFrame([("c", 0, "SALE now", 0.9), ("c", 1, "sale 50", 0.9), ("c", 2, "lost", 0.1)], "clip string, idx int, text string, confidence double")
    assert [r.term for r in media.ocr_terms(reads).orderBy("ord").collect()] == ["SALE", "now"]
    assert media.palette(pixels, 1).first().weight == 0.25 and round(media.loudness(spark.createDataFrame([("c", 0.6), ("c", -0.8)], "clip string, sample double")).first().rms, 6) == round(0.5**0.5, 6)


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"k": "a", "n": 1}\n\nnot json\n{"k": "b", "n": 2}\n{"k": "a", "n":', encoding="utf-8")
    rows = jsonl.read_lines(spark, str(path), "k string, n int")
    assert [(r.k, r.n) for r in rows.orderBy("seq").collect()] == [("a", 1), ("b", 2)]
    assert jsonl.read_array(spark, str(tmp_path / "none.json"), "k string").count() == 0
    jsonl.append_lines(rows.select("k", "n"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    """A file that is read in many parts, after one that comes before it by name."""
    (tmp_path / "b.jsonl").write_text("".join(f'{{"k": {i}, "pad": "{"x" * 90}"}}\n' for i in range(3000)), encoding="utf-8")
    (tmp_path / "a.jsonl").write_text('{"k": -1}\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path), "k int")
        assert rows.rdd.getNumPartitions() > 3 and [r.k for r in rows.orderBy("seq").collect()] == [-1, *range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_other_kinds(spark, tmp_path):
    assert jsonl.read_lines(spark, str(tmp_path / "none.jsonl"), "k int").columns == ["seq", "k"] and jsonl.read_lines(spark, str(tmp_path / "none.jsonl"), "k int").count() == 0
    for region in ("KR", "US"):
        (tmp_path / f"chart_{region}.jsonl").write_text('{"rank": 1}\n', encoding="utf-8")
    assert {(r.region, r["rank"]) for r in jsonl.read_charts(spark, str(tmp_path), "rank int").collect()} == {("KR", 1), ("US", 1)}
    for name, content in (("list", '[{"task_id": "a"}]'), ("object", '{"cards": [{"task_id": "a"}]}'), ("other", '{"x": 1}')):
        (tmp_path / f"{name}.json").write_text(content, encoding="utf-8")
    assert [r.task_id for n in ("list", "object") for r in jsonl.read_cards(spark, str(tmp_path / f"{n}.json"), "task_id string").collect()] == ["a", "a"]
    with pytest.raises(Exception, match="neither a list"):
        jsonl.read_cards(spark, str(tmp_path / "other.json"), "task_id string").collect()
    assert [r.violation for r in producers.frontier_rows(spark.createDataFrame([("a", "open"), (" ", "open"), ("b", "jump")], "item string, op string")).collect()] == [None, "empty item", "unknown operation"]
    texts = spark.createDataFrame([("v", 0, 1, "10"), ("v", 3600, 2, "n/a"), ("v", 7200, 3, " 30 ")], "id string, s long, seq long, views string").withColumn("at", F.timestamp_seconds("s"))
    assert [r.per_hour for r in trends.velocity_series(texts).collect()] == [10.0]


def test_runs_are_read_once(spark, tmp_path):
    for run in ("r_a", "research/r_b"):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "ledger.jsonl").write_text('{"k": 1}\n{"k": 2}\n', encoding="utf-8")
    (tmp_path / "r_empty").mkdir()
    rows = jsonl.read_runs(spark, f"{tmp_path}/./", "k int")
    assert [(r.run, r.k) for r in rows.orderBy("seq").collect()] == [("r_a", 1), ("r_a", 2), ("r_b", 1), ("r_b", 2)]
    assert jsonl.read_runs(spark, str(tmp_path / "none"), "k int").count() == 0
    assert {r.path.rsplit("/", 1)[1] for r in jsonl.read_documents(spark, f"{tmp_path}/r_a/*").collect()} == {"ledger.jsonl"}
    assert jsonl.newest(spark, f"{tmp_path}/r_a").first().path.endswith("ledger.jsonl")


def test_sound(spark, tmp_path):
    import math
    import wave

    for name, level in (("loud", 16384), ("silent", 0)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"".join(int(level * (1 if i % 2 else -1)).to_bytes(2, "little", signed=True) * 2 for i in range(1000)))
    (tmp_path / "broken.wav").write_bytes(b"RIFFnothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert math.isclose(got["loud.wav"].rms, 0.5) and got["loud.wav"].frames == 1000 and got["loud.wav"].channels == 2 and got["silent.wav"].rms == 0.0 and got["broken.wav"].rms is None


def test_transcript_writers(spark):
    segs = spark.createDataFrame([("a", 0, 0.0, 1.5, " hi "), ("a", 1, 61.25, 62.0, "there")], "transcript_id string, idx int, start double, end double, text string")
    assert transcripts.segments_json(segs).first().content == '[{"start":0.0,"end":1.5,"text":" hi "},{"start":61.25,"end":62.0,"text":"there"}]'
    lines = [r.line for r in transcripts.transcript_lines(segs, F.lit("gate=OK")).orderBy("idx").collect()]
    assert lines == ["# gate=OK", "[    0.00 -->     1.50] hi", "[   61.25 -->    62.00] there"]
    srt = spark.createDataFrame([("s", "1\r\n00:00:01,000 --> 00:00:02,000\r\nhello\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\nhello\r\n42\r\nworld\r\n"), ("n", None)], "transcript_id string, content string")
    assert {r.transcript_id: r.text for r in transcripts.plain_text(srt).collect()} == {"s": "hello world", "n": ""}


def test_parser_failures_stay_on_their_page(spark):
    pages = spark.createDataFrame([("a", "1,2"), ("b", "x"), ("c", None)], "url string, body string")
    got = {r.url: r for r in acquire.parsed(pages, lambda url, body: [{"n": int(x)} for x in body.split(",")], "n: int").collect()}
    assert not got["a"].parse_failed and [r.n for r in got["a"].rows] == [1, 2] and got["b"].parse_failed and "c" not in got


def test_near_pairs_against_all_pairs(spark):
    """Also with a shingle that every text of a group has, copies, and texts without words."""
    import random

    random.seed(3)
    words = [w for w in ("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(60))]
    texts = [" ".join(["common", "shared", "opening", *(random.choice(words[:12]) for _ in range(random.randrange(1, 9)))]) for _ in range(120)]
    texts += [texts[0]] * 5 + ["", "a b c", "wordone wordtwo"]
    rows = [(i % 2, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, n int, text string")

    def shingles(t):
        ws = t.split() if len(t) > 5 else []
        return {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) >= 3 else set(ws)

    for least in (0.4, 0.6, 1.0):
        want = {(g, a, b) for g, a, x in rows for h, b, y in rows if g == h and a < b and shingles(x) and len(shingles(x) & shingles(y)) >= least * len(shingles(x) | shingles(y)) > 0}
        assert {(r.g, r.a, r.b) for r in evidence.near_pairs(df, ["g"], "n", "text", least).collect()} == want
        first = {}
        for _, a, b in want:
            first[b] = min(first.get(b, a), a)
        assert {r.n: r.first for r in evidence.first_earlier(df, ["g"], "n", "text", least).collect()} == first


def test_transcripts(spark):
    vtt = "WEBVTT\n\n00:01.500 --> 00:00:03,25\nhello\nthere\n\n00:04.000 --> 00:05.000\n\n"
    plain = "# gate=OK\n[00:01 -> 00:02] one\nnoise\n[1:00:00 --> 1:00:01] two"
    df = spark.createDataFrame([("v", vtt), ("p", plain)], "transcript_id string, content string")
    got = sorted((r.transcript_id, r.start, r.end, r.text) for r in transcripts.parse_timed(df).collect())
    assert got == [("p", 1.0, 2.0, "one"), ("p", 3600.0, 3601.0, "two"), ("v", 1.5, 3.25, "hello there")]
    assert {r.transcript_id: r.quality_label for r in transcripts.quality_label(df).collect()} == {"p": "OK", "v": "UNKNOWN"}
    assert one(spark, transcripts.stamp(F.lit(3661.5))) == "01:01:01.500"


def test_producers(spark):
    ids = spark.createDataFrame([("https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/abcdefghij_", "abcdefghij_"), ("abcdefghijk", "abcdefghijk"), ("short", None)], "u string, v string")
    assert all(r.v == r.got for r in ids.withColumn("got", producers.video_id(F.col("u"))).collect())
    assert one(spark, producers.duration_seconds(F.lit("PT1H2M3S"))) == 3723 and one(spark, producers.scrubbed(F.lit("k=abc"), F.lit("abc"))) == "k=***"
    # A recon stamp with reasons is not recognised, as it never was.
    assert [one(spark, producers.run_stamp(F.lit(x))) for x in ("[ALPHA] [RECON]", "[RECON]", "[RECON: thin]")] == ["ALPHA", "RECON", "unlabeled"]
    std = spark.createDataFrame([("a", 3, 2, 1.5, ["traceability"], ["web"]), ("b", 1, 2, 0.5, ["breadth", "typo"], ["sound"]), ("c", None, None, None, None, None)], "standard_id string, min_distinct_hosts int, min_independent_sources int, dup_similarity double, fatal_domains array<string>, required_modalities array<string>")
    texts = spark.createDataFrame([("a", "breadth", "[]"), ("b", '["typo"]', '["web"]'), ("c", "[]", None)], "standard_id string, fatal_domains string, required_modalities string").withColumns({c: F.lit(1.0) for c in ("min_distinct_hosts", "min_independent_sources", "dup_similarity")})
    assert {r.standard_id: r.warnings for r in producers.standard_warnings(texts).collect()} == {"a": "fatal_domains_not_list", "b": "fatal_domains_unknown", "c": "fatal_set_trivial"}
    known = spark.createDataFrame([("a1", "http://x")], "artifact_id string, source string")
    dates = spark.createDataFrame([(1, "a1", "2024-01-01"), (2, "a1", "soon"), (3, "zz", "2024-01-01")], "seq int, artifact_id string, published_at string")
    assert {r.seq: r.violation for r in producers.pubdate_violations(dates, known).collect()} == {2: "no date", 3: "unknown artifact"}
    anchored = spark.createDataFrame([(1, 0.5, "2025-01-01", "a1"), (2, 0.5, "2025-01-01", "zz"), (3, 0.5, "2025-01-01", None)], "prediction_id int, stated_confidence double, resolve_by string, anchor_artifact_id string")
    assert {r.prediction_id: r.violation for r in producers.prediction_violations(anchored, known).collect()} == {2: "unknown anchor"}
    assert producers.research_rows(spark.createDataFrame([("g", 1), ("g", 2)], "goal string, seq int")).collect() == [("g", 1, "r_" + __import__("hashlib").sha256(b"g").hexdigest()[:10])]
    measures = spark.createDataFrame([(1, "a1", "t"), (2, "a1", " "), (3, "zz", "t")], "seq int, artifact_id string, truth string")
    assert {r.seq for r in producers.measure_violations(measures, known).collect()} == {2, 3}
    assert {r.standard_id: r.warnings for r in producers.standard_warnings(std).collect()} == {"a": "volume_bar_incoherent,fatal_set_trivial,dup_similarity_range", "b": "fatal_domains_unknown,required_modalities_invalid", "c": ""}
    items = spark.createDataFrame([(0, "video", "x")], "ord int, kind string, id string")
    new = spark.createDataFrame([(0, "video", "x"), (1, "channel", "y"), (2, "video", "y")], "ord int, kind string, id string")
    assert [(r.kind, r.id) for r in producers.watch(items, new).orderBy("ord").collect()] == [("video", "x"), ("channel", "y")]
    assert producers.watch(items, new, items).count() == 1
    preds = spark.createDataFrame([(1, 1.0, "2025-1-1"), (2, 1.1, "2025-01-01"), (3, 0.5, "soon")], "prediction_id int, stated_confidence double, resolve_by string")
    assert {r.prediction_id for r in producers.prediction_violations(preds).collect()} == {2, 3}
    theses = producers.hypothesis_rows(spark.createDataFrame([("t", "high", "debunk"), (" ", "", "discover"), ("u", "urgent", None)], "thesis string, stakes string, mode string")).collect()
    assert [r.violation for r in theses] == [None, "empty thesis", "unknown stakes"] and theses[0].hypothesis_id.startswith("hyp_")


def test_undated_runs_survive_since(spark):
    runs = spark.createDataFrame([("a", "2024-05-01T00:00:00Z"), ("b", None), ("c", ""), ("d", "2023-01-01")], "run string, created string")
    rows = spark.createDataFrame([("b", "2024-06-01"), ("b", "2024-07-01")], "run string, ts string")
    dated = gates.created(runs, rows)
    assert {r.run: r.created for r in dated.collect()}["b"] == "2024-06-01"
    assert {r.run for r in gates.since(dated, "2024-01-01").collect()} == {"a", "b", "c"}


def test_states_of_stamped_documents(spark):
    block = lambda *ls: "---\n" + "\n".join(ls) + "\n---\nbody\nlast_verified: 2024-05-01\n"
    cases = {
        "quoted": (block('last_verified: "2024-06-01"'), "fresh"), "single": (block("last_verified: '2024-6-1'"), "fresh"), "time": (block("last_verified: 2024-06-01T00:00"), "invalid-date"), "ahead": (block("last_verified: 2030-01-01"), "fresh"),
        "dated": (block("last_verified: 2024-06-01", "verified_by: date-stamp-unverified"), "stamped-unverified"), "old": (block("last_verified: 2024-05-02", "verified_by: date-stamp-unverified"), "stale"), "day": (block("last_verified: 2024-02-30"), "invalid-date"),
        "twice": (block("last_verified: soon", "last_verified: 2024-06-01"), "fresh"), "indented": (block("  last_verified: 2024-06-01"), "missing"), "bare": ("no block", "missing"), "by": (block("last_verified: 2024-06-01", "verified_by: 'date-stamp-unverified'"), "stamped-unverified"),
    }
    files = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("null", None)], "path string, content string")
    states = gates.skill_staleness(files, "2024-06-01")
    assert {r.path: r.state for r in states.collect()} == {k: v[1] for k, v in cases.items()} | {"null": "missing"}
    only = lambda *ks: states.filter(F.col("path").isin(*ks))
    assert [gates.staleness_gate(only("quoted", "dated"), strict).first().passed for strict in (False, True)] == [True, False]
    fixed = {r.path: r for r in gates.restamped(files, "2024-06-01").collect()}
    assert fixed["bare"].content == "---\nlast_verified: 2024-06-01\nverified_by: date-stamp-unverified\n---\n\nno block" and fixed["quoted"].content == cases["quoted"][0] and not fixed["quoted"].fixed
    assert fixed["time"].content == block("last_verified: 2024-06-01", "verified_by: date-stamp-unverified") and fixed["time"].fixed
    again = {r.path: r.state for r in gates.skill_staleness(spark.createDataFrame([(r.path, r.content) for r in fixed.values()], "path string, content string"), "2024-06-01").collect()}
    assert set(again.values()) == {"fresh", "stamped-unverified"}


def test_hosts_of_odd_addresses(spark):
    """Against the standard library's splitting, for addresses that stricter readers refuse."""
    from urllib.parse import urlparse

    urls = ["http://a_b.example.com/x", "http://x.com/a b", "http://u:p@Host.org:8080/p?q#f", "//h.net/x", "mailto:x@y.z", "http:///x", " http://s.com/x", "http://ho\tst.com", "h.com/x", "ftp+x://a.b?c", "http://x.com:y/", "http://a@b@c.com/", "", "1x://h.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.host_name(F.col("u")).alias("h"), web.path_and_query(F.col("u")).alias("p"))
    for r in df.collect():
        parts = urlparse(r.u)
        assert r.h == (parts.hostname or ""), r.u
        if r.h:
            assert r.p == (parts.path or "/") + ("?" + parts.query if parts.query else ""), r.u
    assert one(spark, web.registrable(F.lit("http://a_b.example.com/x"))) == "example.com"


def test_a_repeated_forecast_counts_once(spark):
    preds = spark.createDataFrame([("p", 0.1, "2024-01-01", 1), ("p", 0.9, "2024-01-01", 2), ("q", 0.5, "2024-01-01", 3)], "prediction_id string, stated_confidence double, created string, seq long")
    res = spark.createDataFrame([("p", 1, "hit", True, "2024-02-01")], "prediction_id string, seq long, outcome string, anchored boolean, ts string")
    r = scoring.calibration(preds, res).first()
    assert (r.n_predictions, r.n_resolved, r.brier_all, r.worst_bucket_gap) == (2, 1, 0.01, 0.1)
    assert [tuple(x) for x in scoring.reliability(preds, res).collect()] == [(4, 1, 0.9, 1.0, 0.1)]


def test_samples_of_issues(spark):
    rows = spark.createDataFrame([(i, str(v), "N/A" if i % 4 == 0 else "x") for i, v in enumerate([5, -3, 200, "1,500", "z", -1, -2, -9, None, " "])], "i int, n string, t string")
    rules = {"n": {"type": "int", "min": 0, "max": 100}, "t": {"reject_regex": "^n/a$"}, "gone": {"min": 1, "type": "int"}, "bad": 3, "i": {"reject_regex": "("}}
    got = {(r.field, r.issue, r.place): r.value for r in validate.samples(rows, rules, ["i"]).collect()}
    assert got == {("n", "below_min", 1): "-3", ("n", "below_min", 2): "-1", ("n", "below_min", 3): "-2", ("n", "above_max", 1): "200", ("n", "above_max", 2): "1,500", ("t", "junk", 1): "N/A", ("t", "junk", 2): "N/A", ("t", "junk", 3): "N/A"}
    assert validate.samples(rows.limit(0), rules, ["i"]).count() == 0 and validate.samples(rows, {}, ["i"]).count() == 0
    plan = validate.samples(rows, rules, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan  # the first few are kept before the shuffle


def test_known_values(spark):
    """Functions on values that the tables don't hold."""
    cases = [
        (web.registrable, {"http://[2001:0db8:0:0:0:0:0:1]:80/x": "2001:db8::1", "https://www.news.bbc.co.uk/": "bbc.co.uk", "http://10.0.0.1/": "10.0.0.1", "http://a.com.mx": "a.com.mx", "nonsense": ""}),
        (web.closed_host, {"169.254.169.254": True, "8.8.8.8": False, "::1": True, "": True, "example.com": False}), (web.open_path, {"/home/../etc/passwd": False, "refs/a.html": True}),
        (tx.first_number, {"costs 1,234 won": 1234.0, "-5 then 6": -5.0, "1,2,3": 1.0, "2e3 m": 2000.0, "none": None}), (producers.run_stamp, {"[ALPHA] [RECON]": "ALPHA", "[RECON: thin]": "unlabeled"}),
        (producers.video_id, {"https://youtu.be/abcdefghijk?t=1": "abcdefghijk", "abcdefghijk": "abcdefghijk", "short": None}), (scoring.abstains, {" Unknown ": True, "모름": True, "not found": False}),
    ]
    for f, want in cases:
        got = spark.createDataFrame([(x,) for x in want], "x string").select("x", f(F.col("x")).alias("y"))
        assert {r.x: r.y for r in got.collect()} == want


def test_whole_files_keep_their_lines(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: x\n---\nbody\n")
    (tmp_path / "b.json").write_text('[{"k": 1},\n {"k": 2}]\n')
    assert [r.content for r in jsonl.read_documents(spark, str(tmp_path / "a.md")).collect()] == ["---\nname: x\n---\nbody\n"]
    assert [r.k for r in jsonl.read_array(spark, str(tmp_path / "b.json"), "k int").collect()] == [1, 2]


def test_bench_never_broadcasts_its_clips(spark, tmp_path):
    """Small files hold many rows, so what is estimated from them must not send a row for each clip by way of the driver."""
    spark.createDataFrame([(1, "raw", "m", "ab"), (1, "vocals", "m", None)], "clip int, source string, model string, text string").write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    matrix = scoring.bench_matrix(scoring.bench_grid(runs, ["raw", "vocals"], ["m", "n"]), "m")
    for df in (matrix, scoring.bench_report(matrix), scoring.error_matrix(runs, "m")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    lines = {(r.source, r.part, r.model): r.line for r in scoring.bench_report(matrix).collect()}
    assert lines["raw", 4, "m"] == "| m | 0.0 | 0.0 |" and lines["raw", 5, "m"] == "- **m**: ab" and lines["raw", 4, "n"] == "| n | ERROR ||" and ("raw", 5, "n") not in lines
    assert len(lines) == 1 + 2 * 3 + 4 + 1


def test_numbers_of_conflicts_by_their_exact_value(spark):
    rows = [(1, 1, "a", "card 90819894045335504 given"), (1, 2, "b", "card 2.00005 given 9" + "9" * 400)]
    found = spark.createDataFrame(rows, "conclusion_id int, seq int, artifact_id string, quote string")
    assert [r.numbers for r in evidence.numeric_conflicts(found).collect()] == ["2.0000,90819894045335504.0000,inf"]


def test_known_values_of_every_function(spark):
    """Every function of single values is in the query, on values of the table's every key."""
    from tidemark.plans import registry

    found = registry.queries()["known_values"](spark, "/root/testdata/sf0.001").groupBy("f").count().collect()
    assert {r.f for r in found} == {"video", "closed", "path", "scrubbed", "abstains", "host", "number", "date", "begins", "status", "stamp"}
    keys = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert all(r["count"] % keys == 0 for r in found)


def test_lines_are_made_once(spark, tmp_path):
    """Ranges are found in a pass of their own, which must not make the lines anew; nor must a digest's headings."""
    seen = spark.sparkContext.accumulator(0)

    def said(x: int) -> str:
        seen.add(1)
        return f"line {x}"

    made = spark.range(100).select(F.lit("1-evidence").alias("section"), F.lpad(F.col("id").cast("string"), 20, "0").alias("ord"), F.udf(said, "string")("id").alias("line"))
    lines.write_lines(ledger.digest_document(made, "x"), ["section", "ord"], "line", str(tmp_path / "out"))
    assert seen.value == 100
    got = [r.line for r in lines.read_ordered(spark, str(tmp_path / "out")).orderBy("line_no").collect()]
    assert got == ["# RESEARCH DIGEST: x", "## evidence (100)", *[f"- line {i}" for i in range(100)]]


def test_near_copies_move_no_groups_and_no_words(spark):
    """Shingles are counted by one number each, and words are cut out, not looked around; the results stay those of all pairs."""
    a = "alpha bravo charlie delta echoes foxtrot golfing hotels"
    rows = [(1, 1, a), (1, 2, a + " india"), (2, 3, a), (None, 4, a), (None, 5, a + " india"), (1, 6, ""), (1, 7, None), (1, 8, "ab Été x über 中文 ab1cdefg with")]
    items = spark.createDataFrame(rows, "g int, n int, text string")
    own = evidence.shingle_sets(items, ["g"], "n", "text")
    assert [tuple(r)[:3] for r in evidence.near_classes(own, ["g"], 0.6).collect()] == [(1, 1, 2)]
    words = items.select("n", tx.tokens(F.col("text")).alias("t"))
    assert {r.n: r.t for r in words.collect()}[8] == ["été", "über", "中文", "cdefg"]
    assert "regexp_extract_all" not in words._jdf.queryExecution().analyzed().toString().lower()


def test_copies_are_linked_by_their_number_not_their_pairs(spark):
    """What is only to be connected takes few of the pairs that are alike, and leaves none apart."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for text in range(3):
        base = [word() for _ in range(60)]
        for i in range(40):
            words = list(base)
            words[rng.randrange(60)] = word()
            rows.append((1, 100 * text + i, " ".join(words)))
    # A chain of which only neighbours are alike, and the same texts in another group.
    long = [word() for _ in range(400)]
    rows += [(g, 1000 + i, " ".join(long[8 * i : 8 * i + 60])) for g in (1, 2) for i in range(40)]
    items = spark.createDataFrame(rows, "g int, n int, text string")
    own = evidence.shingle_sets(items, ["g"], "n", "text")
    sets = evidence.different_sets(own, ["g"])
    every = evidence.near_classes(own, ["g"], 0.6, sets)
    texts = {(g, n): {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for g, n, t in rows for w in [t.split()]}
    want = {(g, a, b) for g, a in texts for h, b in texts if g == h and a < b and len(texts[g, a] & texts[g, b]) / len(texts[g, a] | texts[g, b]) >= 0.6}
    assert {(r.g, r.a, r.b) for r in every.collect()} == want and len(want) > 2000
    few = {(r.g, r.a, r.b) for r in evidence._near_sets(sets, ["g"], 0.6, linking=True, few=0).collect()}
    assert few <= want and len(few) < 3 * len(rows)
    assert {tuple(r) for r in evidence.distinct_texts(items, "g", "n", "text").collect()} == {(1, 160, 4), (2, 40, 1)}
    none = spark.createDataFrame([(1, 1, "alpha bravo charlie delta"), (1, 2, "")], "g int, n int, text string")
    assert [tuple(r) for r in evidence.distinct_texts(none, "g", "n", "text").collect()] == [(1, 2, 2)]
