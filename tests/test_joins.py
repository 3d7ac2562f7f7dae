"""Joins that must not list all pairs, against listing them."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import acquire, evidence
from tidemark.plans import registry
from tidemark.sources import storage
from tidemark.sources.tables import Tables


def test_conflicts_against_all_pairs(spark):
    rng = random.Random(12)
    words = ["price", "growth", "export", "import", "tariff"]
    rows = []
    for i in range(260):
        said = [*rng.sample(words, rng.randrange(0, 4)), *(str(rng.choice([1, 2, 30, "4,000", "2.50"])) for _ in range(rng.randrange(0, 3)))]
        rng.shuffle(said)
        rows.append((rng.choice([0, 0, 0, 1, 2]), 1000 - i, f"a{i}", " ".join(said)))
    rows += [(None, 5000 + i, "n", f"price {i}") for i in range(3)] + [(1, 6000, "n", None)]
    df = spark.createDataFrame(rows, "conclusion_id int, seq long, artifact_id string, quote string")
    told = {r.seq: (r.conclusion_id, tuple(r.n), frozenset(r.w)) for r in df.select("conclusion_id", "seq", tx.numbers(F.col("quote")).alias("n"), tx.tokens(F.col("quote")).alias("w")).collect()}
    own = {s: v for s, v in told.items() if v[0] is not None and v[1]}
    want = {}
    for s, (g, n, w) in own.items():
        met = [o for o, (h, m, v) in own.items() if h == g and m != n and v & w]
        same = [o for o, v in own.items() if v == (g, n, w)]
        want[s] = (min(same), len(met), min(met, default=None))
    for chunk in (7, 40, 4096):
        got = {r.seq: (r.class_seq, r.n_links, r.first_seq) for r in evidence.conflict_links(df, chunk=chunk).collect()}
        assert got == want
    pairs = {(r.conclusion_id, r.a_seq, r.b_seq) for r in evidence.numeric_conflicts(df).collect()}
    assert {r.conclusion_id: r.conflicts for r in evidence.conflict_counts(df).collect()} == {g: n for g in range(3) if (n := sum(p[0] == g for p in pairs))}
    assert evidence.conflict_links(df.limit(0)).count() == 0


def test_a_word_that_all_findings_hold(spark):
    """50,000 findings of one conclusion share a word: over a thousand million pairs, counted and not listed."""
    n = 50_000
    quote = F.concat(F.lit("price "), F.col("id").cast("string"), F.lit(" item"), F.translate((F.col("id") % 500).cast("string"), "0123456789", "abcdefghij"))
    df = spark.range(n).select(F.lit("c").alias("conclusion_id"), F.col("id").alias("seq"), F.lit("a").alias("artifact_id"), quote.alias("quote"))
    assert evidence.conflict_counts(df).first().conflicts == n * (n - 1) // 2


def test_many_rules_and_pages(spark):
    """1,000 rules and 20,000 pages of one host, against trying all rules on a part of the pages."""
    rng = random.Random(13)
    rules = [f"/{'abc'[i % 3]}{i % 37}/{'x' * (i % 5)}{i}" for i in range(960)] + [f"/b{i}/*q{i % 7}$" for i in range(20)] + [f"/*.{e}" for e in ("pdf", "js")] + ["/$", "/a1/*", "/c3/\\d+", "/c4/(", "*", "/b5/*q"]
    kinds = [rng.choice(["Allow", "Disallow"]) for _ in rules]
    robots = spark.createDataFrame([("h.com", "User-agent: *\n" + "\n".join(f"{k}: {v}" for k, v in zip(kinds, rules, strict=True)))], "host string, text string")
    paths = ["/", ""] + [rng.choice(rules).strip("$*") + rng.choice(["", "/y", "q3", ".pdf", "?a=.js"]) for _ in range(400)]
    urls = sorted({f"http://h.com{p}" for p in paths if "\\" not in p and "(" not in p})
    far = spark.range(20_000).select(F.concat(F.lit("http://h.com/far/"), "id").alias("url"))
    got = {r.url: r.allowed for r in acquire.robots_decision(spark.createDataFrame([(u,) for u in urls], "url string").unionByName(far), robots, "bot").collect()}
    assert len(got) == len(urls) + 20_000

    import re

    def allowed(path):
        best = max(((len(v), k == "Allow") for k, v in zip(kinds, rules, strict=True) if re.match("".join(".*" if c == "*" else re.escape(c) for c in v.removesuffix("$")) + ("$" if v.endswith("$") else ""), path)), default=(0, True))
        return best[1]

    assert {u: got[u] for u in urls} == {u: allowed(u[12:] if u[12:].startswith("/") else f"/{u[12:]}") for u in urls}


class _Metas(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            d = {k: v or "" for k, v in attrs}
            name = next((d[k] for k in ("name", "property", "http-equiv") if d.get(k)), "").lower()
            if name:
                self.found.append((name, d.get("content", "").lower()))


def test_meta_tags_against_the_standard_parser(spark):
    rng = random.Random(14)
    values = ["noai", '"NoAI, index"', "'a>b'", '"x > y"', '"say \'no\'"', "1", '""', "a/b", '" sp "', "noml"]
    bits = [
        "<!-- <meta name=robots content=noai> -->", "<script>var s = '<meta name=robots content=noml>';</script>", "<style>a>b{}</style>", "<p class='a>b'>text > more</p>", "a < b <3 c", "<br/>", "<!DOCTYPE html>",
        "<script src=\"a>b\">if (a < b) { '</scrip' }</script>", "<metadata name=robots content=noai>", "<title>t</title>", "</p>", "\n", "<a title='<meta name=robots content=no>'>x</a>",
    ]

    def meta():
        attrs = [f"{rng.choice(['name', 'NAME', 'property', 'http-equiv', 'content', 'content', 'data-name', 'x'])}{rng.choice(['=', ' = ', '='])}{rng.choice(values)}" for _ in range(rng.randrange(0, 5))]
        return f"<{rng.choice(['meta', 'META', 'Meta'])} {' '.join(attrs + rng.choice([[], ['checked']]))}{rng.choice(['>', ' />', ' >'])}"

    pages = ["".join(meta() if rng.random() < 0.5 else rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: [(m["name"], m["content"]) for m in r.m] for r in df.select("i", acquire.meta_tags(F.col("html")).alias("m")).collect()}
    for i, page in enumerate(pages):
        parser = _Metas()
        parser.feed(page)
        assert got[i] == parser.found, page
    assert spark.createDataFrame([(None,), ("<p " + "a='b' " * 2000 + "><meta name=x content='" + "y" * 100_000 + "'>",)], "html string").select(F.size(acquire.meta_tags(F.col("html"))).alias("n")).collect() == [(0,), (1,)]


def test_shingles_are_moved_in_long_rows(spark, monkeypatch):
    """Near copies over many small parts against all pairs, and no shuffle with a row for each shingle."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    texts = [" ".join(["common", "shared", "opening", *rng.choices(words[:9], k=rng.randrange(0, 12))]) for _ in range(300)]
    texts += [*texts[:9], "", "wordone wordtwo", *[" ".join(rng.choices(words, k=900)) for _ in range(6)]]
    rows = [(i % 3, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, n int, text string")
    shingles = {n: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} if len(t.split()) > 2 else set(t.split()) for _, n, t in rows}
    alike = lambda x, y: shingles[x] and len(shingles[x] & shingles[y]) >= 0.6 * len(shingles[x] | shingles[y])
    want = {(g, a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a < b and alike(a, b)}
    monkeypatch.setattr(evidence, "ROWS", 300)
    assert {(r.g, r.a, r.b) for r in evidence.near_pairs(df, ["g"], "n", "text").collect()} == want
    parent = {n: n for _, n, _ in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for _, a, b in want:
        parent[root(a)] = root(b)
    assert {r.g: (r.n, r.n_distinct) for r in evidence.distinct_texts(df, "g", "n", "text").collect()} == {g: (sum(h == g for h, _, _ in rows), len({root(n) for h, n, _ in rows if h == g})) for g in range(3)}
    # The sets are grouped once, and what is moved by shingle are arrays.
    monkeypatch.setattr(evidence, "ROWS", 1 << 21)
    made = []
    sets_of, dealt = evidence.different_sets, evidence._dealt
    monkeypatch.setattr(evidence, "different_sets", lambda *a: made.append(1) or sets_of(*a))
    evidence.distinct_texts(df, "g", "n", "text").collect()
    assert len(made) == 1
    n = 10_000
    long_rows = dealt(np.arange(n), {"k": np.arange(n), "size": np.arange(n)}, 8)
    assert long_rows.num_rows == 8 and sorted(evidence._gathered(iter([long_rows.slice(0, 3), long_rows.slice(3)]))["k"]) == list(range(n))


def test_texts_compared_once_for_all_who_ask(spark):
    """What is asked of finer groups gives the same from one comparison as from a comparison of its own."""
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 20]))) for _ in range(260)]
    texts += [f"{t} {rng.choice(words)}" for t in texts if len(t) > 60] + texts[:40]
    rows = [(rng.choice(["h", "h", "i"]), n, rng.choice(["confirms", "disconfirms", "neutral"]), rng.choice(["1", "2"]), t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "hypothesis_id string, seq long, polarity string, resolve_by string, text string")
    like = evidence.alike(df, ["hypothesis_id"], "seq", "text")
    yes, finer = df.filter("polarity = 'confirms'"), df.withColumn("_g", F.struct("hypothesis_id", "polarity"))
    same = lambda of: sorted(map(tuple, of(None).collect())) == sorted(map(tuple, of(like).collect()))
    assert same(lambda x: evidence.distinct_texts(finer, "_g", "seq", "text", like=x).select("_g.*", "n", "n_distinct"))
    assert same(lambda x: evidence.first_earlier(df, ["hypothesis_id", "resolve_by"], "seq", "text", like=x))
    assert same(lambda x: evidence.echo_members(yes, like=x)) and evidence.echo_members(yes, like=like).count() > 9
    assert same(lambda x: evidence.echo_clusters(yes, chained=True, like=x))


@pytest.mark.parametrize("name", ["digest_lines", "run_gate", "verdict_debunk"])
def test_queries_shingle_their_texts_once(spark, monkeypatch, name):
    made, of = [], tx.hashed_shingles
    monkeypatch.setattr(tx, "hashed_shingles", lambda *a: made.append(1) or of(*a))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def _shuffle_files(spark):
    return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_what_is_cut_leaves_no_shuffle_files(spark):
    """Shuffles behind a cut go at once, and what is dropped goes from the shared folder."""
    before = _shuffle_files(spark)
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    made = storage.cut(df)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert made.count() == 1000 and df.count() == 1000  # what was cut can be run again
    at = made._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    assert storage.exists(spark, at)
    storage.dropped(made)
    assert not storage.exists(spark, at)


def test_equal_sets_are_written_once_and_pairs_are_compared_in_cells(spark, monkeypatch):
    """Copies and near copies in one large group, against all pairs, with cells of a few sets; of equal sets one holds the shingles, and none are left."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    base = rng.sample(words, 30)
    texts = [" ".join(base[: rng.randrange(20, 31)]) for _ in range(200)] + [" ".join(rng.choices(words, k=12)) for _ in range(60)] + ["", "wordone"]
    rows = [(None if i % 50 == 49 else i % 2, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, n long, text string").repartition(5)
    shingles = {n: frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, n, t in rows}
    made, cut = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda d: made.append(cut(d)) or made[-1])
    monkeypatch.setattr(evidence, "CELL", 100)
    gone, dropped = [], evidence.dropped
    monkeypatch.setattr(evidence, "dropped", lambda d: gone.append((d, d.filter("s IS NOT NULL").count() if "s" in d.columns else 0)) or dropped(d))
    like = evidence.alike(df, ["g"], "n", "text")
    k = {r.n: r.k for r in like.members.collect()}
    own = [(g, n) for g, n, _ in rows if shingles[n]]
    assert len({k[n] for _, n in own}) == len({(g, shingles[n]) for g, n in own})
    assert max(n for _, n in gone) == len({(g, s) for g, n, t in rows if (s := shingles[n] or t)})
    assert [d for d, _ in gone if d is made[0]]
    alike = lambda x, y: len(shingles[x] & shingles[y]) >= 0.6 * len(shingles[x] | shingles[y])
    want = {frozenset((k[a], k[b])) for g, a in own for h, b in own if g is not None and g == h and k[a] != k[b] and alike(a, b)}
    got = [frozenset(r) for r in like.pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_what_is_asked_of_predictions_moves_no_texts(spark):
    plan = Tables(spark, "/root/testdata/sf0.001").predictions().select("prediction_id", "hypothesis_id")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "ascii" not in joined and "ascii" in plan


@pytest.mark.parametrize("name", ["independence_gate"])
def test_queries_leave_no_shingles_behind(spark, monkeypatch, name):
    """What the comparison has written of whole sets is gone before the rest of the query runs, and was written once."""
    made, cut = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda d: made.append(cut(d)) or made[-1])
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    whole = [d._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get() for d in made if "s" in d.columns]
    assert len(whole) == 2 and not any(storage.exists(spark, x) for x in whole)  # all sets, and those in pairs
