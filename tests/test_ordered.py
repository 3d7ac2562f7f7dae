"""Operators whose results depend on order, against going through the rows one by one."""

import random

from pyspark.sql import functions as F

from tidemark.operators import evidence, graph, media


def greedy(nodes, linked):
    """Clusters of one pass in order: each member's seed."""
    seeds, seed = [], {}
    for n in nodes:
        near = [s for s in seeds if linked(s, n)]
        if near:
            seed[n] = near[0]
        else:
            seeds.append(n)
    return seed


def test_seeds_of_a_chain(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 3, 2), ("g", 3, 4), ("g", 4, 3), ("g", 2, 2), (None, 1, 2), ("g", None, 2)], "g string, a long, b long")
    for few in (0, 100):
        got = {(r.g, r.node, r.seed) for r in graph.first_seeds(edges, ["g"], few).collect()}
        assert got == {("g", 2, 1), ("g", 4, 3)}
    assert graph.first_seeds(edges.limit(0), ["g"]).count() == 0


def test_seeds_of_random_graphs(spark):
    """500 graphs at once, each a group, of all densities; in rounds, in one task, and in both."""
    rng = random.Random(8)
    rows, want = [], set()
    for g in range(500):
        n, p = rng.randrange(2, 14), rng.random() ** 2
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p}
        rows += [(g, *(e if rng.random() < 0.5 else e[::-1])) for e in edges for _ in range(rng.randrange(1, 3))]
        want |= {(g, k, s) for k, s in greedy(range(n), lambda s, k, edges=edges: (s, k) in edges).items()}
    df = spark.createDataFrame(rows, "g int, a int, b int")
    for few in (0, 1500, 10**6):
        assert {(r.g, r.node, r.seed) for r in graph.first_seeds(df, ["g"], few).collect()} == want


def test_echoes_are_greedy_in_order(spark):
    """Of a chain of four, each like the next only, there are two clusters; as components there is one."""
    words = [f"word{'abcdefghijklmnop'[i]}" for i in range(16)]
    chain = [" ".join(words[i : i + 10]) for i in (0, 2, 4, 6)]
    rows = [("h", i, t) for i, t in enumerate(chain)] + [("h", 10, chain[1]), ("h", 11, "prices rise"), ("h", 12, "prices rise fast"), ("h", 13, ""), ("h", 14, None), ("k", 15, chain[0]), ("k", 16, "rise prices"), (None, 17, chain[0])]
    df = spark.createDataFrame(rows, "hypothesis_id string, seq long, text string")
    assert {tuple(r) for r in evidence.echo_members(df, least=0.5).collect()} == {("h", 1, 0), ("h", 3, 2), ("h", 10, 0), ("h", 12, 11)}
    assert {tuple(r) for r in evidence.echo_clusters(df, least=0.5).collect()} == {("h", 3)}
    assert {tuple(r) for r in evidence.echo_clusters(df, least=0.5, chained=True).collect()} == {("h", 2)}


def test_echoes_against_one_pass(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = [(h, 100 * h + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 5, 6])))) for h in range(12) for i in range(30)]

    def alike(a, b):
        a, b = a.split(), b.split()
        if min(len(a), len(b)) >= 3:
            a, b = ([tuple(x[i : i + 3]) for i in range(len(x) - 2)] for x in (a, b))
        a, b = set(a), set(b)
        return bool(a and b) and len(a & b) >= 0.6 * len(a | b)

    want = set()
    for h in range(12):
        texts = {s: t for k, s, t in rows if k == h}
        want |= {(h, n, s) for n, s in greedy(sorted(texts), lambda a, b, texts=texts: alike(texts[a], texts[b])).items()}
    df = spark.createDataFrame(rows, "hypothesis_id int, seq long, text string")
    assert {tuple(r) for r in evidence.echo_members(df).collect()} == want


def test_frames_against_one_pass(spark):
    rng = random.Random(10)
    rows = []
    for clip in range(6):
        h = rng.getrandbits(64)
        for i in range(120):
            for _ in range(rng.choice([0, 1, 2, 3, 9])):
                h ^= 1 << rng.randrange(64)
            rows.append((clip, i, h - (1 << 64) if h >> 63 else h))
    rows += [(0, 500, None), (0, 501, None), (1, 502, 0), (1, 503, -1)]
    df = spark.createDataFrame(rows, "clip int, idx long, hash long")
    for radius, least in ((4, 7), (4, 256), (0, 256)):
        want = {(0, 500, None), (0, 501, None)}
        for clip in range(6):
            kept = []
            for i, h in sorted((i, h) for c, i, h in rows if c == clip and h is not None):
                if all(((h ^ k) & (2**64 - 1)).bit_count() > radius for k in kept):
                    kept.append(h)
                    want.add((clip, i, h))
        assert {tuple(r) for r in media.kept_frames(df, radius, least=least).collect()} == want
    assert media.kept_frames(df.limit(0)).count() == 0


def test_a_long_still_clip(spark):
    """100,000 frames of two scenes that only differ by noise: no round compares them all with one another."""
    bit = lambda salt: f"shiftleft(1L, cast(pmod(xxhash64(id, {salt}), 64) AS int))"
    noise = F.expr(f"{bit(1)} ^ {bit(2)}")
    scene = F.when(F.col("id") < 40_000, F.lit(0)).otherwise(F.lit(-1)).cast("long")
    df = spark.range(100_000).select(F.lit("c").alias("clip"), F.col("id").alias("idx"), F.when(F.col("id") % 40_000 == 0, scene).otherwise(scene.bitwiseXOR(noise)).alias("hash"))
    assert {(r.idx, r.hash) for r in media.kept_frames(df).collect()} == {(0, 0), (40_000, -1)}


def _longest(words):
    best = run = 0
    for i, w in enumerate(words):
        run = run + 1 if i and words[i - 1] == w else 1
        best = max(best, run)
    return best


def test_runs_against_one_pass(spark):
    """1,000 transcripts, of segments that may be empty and whose places have gaps; merged two and three at a time too."""
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(1000):
        segments = [[rng.choice("aab") * rng.choice([1, 1, 1, 2]) for _ in range(rng.choice([0, 0, 1, 2, 5]))] for _ in range(rng.randrange(1, 12))]
        place = rng.randrange(-50, 50)
        for s in segments:
            place += rng.choice([1, 1, 7])
            rows.append((k, place, " ".join(s) + rng.choice(["", ".", " - "])))
        if words := [w for s in segments for w in s]:
            want[k] = _longest(words)
    df = spark.createDataFrame(rows, "transcript_id int, idx int, text string")
    for fan in (2, 3, 1024):
        assert {r.transcript_id: r.longest for r in media.longest_run(df, fan=fan).collect()} == want
    assert media.longest_run(df.limit(0)).count() == 0


def test_a_transcript_of_a_million_words(spark):
    """One run goes on over 300 of 100,000 segments."""
    text = F.when(F.col("id").between(5000, 5299), "go go go go go go go go go go").otherwise("one two three four five six seven eight nine ten")
    df = spark.range(100_000).select(F.lit("t").alias("transcript_id"), F.col("id").cast("int").alias("idx"), text.alias("text"))
    assert media.longest_run(df, fan=64).first().longest == 3000


def test_components_of_random_graphs(spark):
    """In rounds, in one task, and in one task after some rounds."""
    rng = random.Random(17)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {(n, root(n)) for n in list(parent) if root(n) != n}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 340, 10**6):
        assert {(r.node, r.root) for r in graph.components(df, few=few).collect()} == want
