"""Token files, spelling variants and centroid clustering against brute force, and in odd cases."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, queries, sortmeans, spelling, tokenfiles

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="session")
def path():
    return queries.tokenizer_file()


@pytest.fixture(scope="session")
def tk(path):
    return tokenizers.Tokenizer.from_file(path)


# Token files


def test_grammar_round_trip():
    rng = random.Random(5)
    runs = [[], [7], [7, 7], [1] * 1001, [1, 2] * 500, [1, 1, 2] * 333 + [1], [rng.randrange(4) for _ in range(5000)], [rng.randrange(50_257) for _ in range(3000)], [0, 2**31 - 5] * 50]
    for ids in runs:
        for least, rounds in ((2, 1), (2, 50), (4, 8)):
            made = tokenfiles.re_pair(np.array(ids, "u4"), least, rounds)
            back = tokenfiles.Grammar.from_bytes(made.to_bytes())
            assert back.tokens().tolist() == ids
            assert back.lengths(back.symbols).sum() == len(ids)
            assert [len(back.expanded(np.array([back.first + i]))) for i in range(len(back.spans))] == back.spans.tolist()
            for _ in range(30):
                a, n = rng.randrange(len(ids) + 2), rng.randrange(len(ids) + 2)
                assert back.tokens(a, n).tolist() == ids[a : a + n]
    made = tokenfiles.re_pair(np.array([1, 2] * 500, "u4"), 2, 50)
    assert len(made.symbols) + 2 * len(made.left) < 40
    with pytest.raises(ValueError, match="torn"):
        tokenfiles.Grammar.from_bytes(made.to_bytes()[:-4])


def test_symbols_are_not_sorted_to_be_expanded(monkeypatch):
    """A shard is decoded in passes over its symbols, none of which puts them in order; any symbols expand, in any order."""
    rng = random.Random(9)
    made = tokenfiles.Grammar.from_bytes(tokenfiles.re_pair(np.array([rng.choice([1, 1, 2, 3]) for _ in range(4000)], "u4")).to_bytes())
    one = {s: made.expanded(np.array([s])).tolist() for s in [*range(4), *range(made.first, made.first + len(made.left))]}
    monkeypatch.setattr(np, "unique", None)
    monkeypatch.setattr(np, "searchsorted", None)
    for n in (0, 1, 7, 500):
        symbols = np.array([rng.choice(sorted(one)) for _ in range(n)], "u4")
        assert made.expanded(symbols).tolist() == [x for s in symbols.tolist() for x in one[s]]


def test_grammar_replaces_frequent_pairs_first():
    """A rule stands for a pair that occurs as often as asked for, and no frequent pair is left where rounds suffice."""
    rng = random.Random(6)
    ids = np.array([rng.choice([1, 1, 1, 2, 3]) for _ in range(4000)], "u4")
    made = tokenfiles.re_pair(ids, 4, 200)
    assert (made.left[:1].tolist(), made.right[:1].tolist()) == ([1], [1])
    left = Counter(zip(made.symbols[:-1].tolist(), made.symbols[1:].tolist(), strict=True))
    apart = {p: n for p, n in left.items() if p[0] != p[1]}
    assert max(apart.values()) < 16  # under four, but for pairs that only overlapped others when their turn came


def test_runs_are_looked_for_in_few_texts(monkeypatch):
    """Texts of ordinary words aren't searched character by character; runs are found wherever they begin."""
    from tidemark.llm import packing

    rng = random.Random(8)
    full, searched = packing.LONG_RUN, []

    class Seen:
        def search(self, text):
            searched.append(text)
            return full.search(text)

    monkeypatch.setattr(packing, "LONG_RUN", Seen())
    for _ in range(400):
        pad, n = "ab " * rng.randrange(1000), rng.choice([1000, 1998, 1999, 2000, 2001, 5000])
        text = pad + rng.choice(["x", "\u4e2d", " ", "\n\t", "\u2003", "\x1f", "\u200b"]) * n + rng.choice(["", " ", "y", " ab" * rng.randrange(900)])
        assert packing.long_run(text) == bool(full.search(text))
    searched.clear()
    assert not packing.long_run("word and word, " * 4000) and not packing.long_run("x" * 1999) and not packing.long_run("")
    assert not searched


def _told(tk, rows):
    start, out = 0, []
    for i, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path, path, tk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = _told(tk, rows)
    at = str(tmp_path / "ids")
    tokenfiles.write(docs, at, path, block=20_000)
    assert sorted(tuple(r) for r in tokenfiles.checksums(spark, at).collect()) == [w[:4] for w in want]
    assert {r.doc_id: list(r.ids) for r in tokenfiles.documents(spark, at).collect()} == {w[0]: w[4] for w in want}
    stream = [i for w in want for i in w[4]]
    rng = random.Random(1)
    asked = [(rng.randrange(len(stream)), rng.randrange(1, 60_000)) for _ in range(20)] + [(0, len(stream)), (len(stream) - 1, 9), (len(stream), 3), (5, 0)]
    got = {(r.start, r.length): list(r.ids) for r in tokenfiles.stretches(spark, at, spark.createDataFrame(asked, "start long, length long")).collect()}
    assert got == {(a, n): stream[a : a + n] for a, n in asked if n and a < len(stream)}


def test_token_files_odd(spark, tmp_path, path, tk):
    texts = ["", None, "same", "same", "x" * 30_000, "<|endoftext|> and 日本 \U0001f600\n\n  end", "word " * 3000]
    rows = [(i if i != 3 else None, t, 9, 9, "s") for i, t in enumerate(texts)] + [(2, "same", 9, 9, "s")] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, start long, docs long, part string")
    at = str(tmp_path / "odd")
    tokenfiles.write(odd, at, path)
    got = sorted((tuple(r) for r in tokenfiles.checksums(spark, at).collect()), key=lambda r: r[1])
    want = _told(tk, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == [w[:4] for w in want]
    tokenfiles.write(odd.limit(0), at, path)
    assert tokenfiles.checksums(spark, at).count() == 0 and tokenfiles.documents(spark, at).count() == 0


def test_op11_query(spark, tk):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op11_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == [w[:4] for w in _told(tk, rows)]


# Nearest neighbours


def test_repeated_rows_take_one_place(spark):
    """30 rows of one id beside others, some with the same vector: every other id is found, each once."""
    rows = [(1, [1.0, 0.5])] * 30 + [(2, [1.0, 0.5]), (3, [1.0, 0.5]), (4, [0.9, 0.4]), (5, [0.2, 0.1]), (6, [-1.0, 0.3]), (0, [1.0, 0.4]), (0, [1.0, 0.4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string").repartition(4)
    got = [(r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_from_another_folder(tmp_path):
    """Workers find the package wherever the driver was started."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        f"for n in ('op4_multiprobe_ann', 'op11_token_files', 'op12_spelling', 'op13_sort_means'): assert e.queries()[n](s, '{SF}').count(), n\n"
        "print('all ran')"
    )
    root = __file__.rsplit("/tests/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=500)
    assert "all ran" in done.stdout, done.stderr[-2000:]


# Spelling variants


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(counts, factor=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if _one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[w] = (n, len(near), form, counts.get(form))
    root = {}
    for w in counts:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        root[w] = at
    return {w: (*v, root[w]) for w, v in out.items()}


def _seen(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abàÿ") for _ in range(rng.randrange(0, 7))): int(10 ** rng.uniform(0, 5)) for _ in range(900)}
    words |= {"a" * n: n * n for n in range(1, 30)} | {"ab" * 20: 3, "ab" * 20 + "a": 40, "ab" * 10 + "b" + "ab" * 10: 500}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, id string")
    assert _seen(spelling.variants(df)) == _variants(words)
    with pytest.raises(ValueError, match="over 1"):
        spelling.variants(df, 1)


def test_variants_odd(spark):
    long = "xy" * 50_000
    rows = [(None, 3), ("lone", None), ("word", 2), ("word", 3), ("ward", 50), ("", 1), ("q", 10), (long, 2), (long + "z", 20), ("wax\U0001f600", 2), ("wax\U0001f601", 30)]
    df = spark.createDataFrame(rows, "word string, n long")
    counts = Counter()
    for w, n in rows:
        if w is not None and n is not None:
            counts[w] += n
    assert _seen(spelling.variants(df)) == _variants(counts)
    assert spelling.variants(df.limit(0)).count() == 0


def test_collisions_fall_out():
    """Words that only share a hash are not near each other."""
    assert spelling.near_in_group([(1, "abcdef", 5, 2, 2), (2, "uvwxyz", 9, 2, 2), (3, "abXdef", 7, 2, 2)]) == {1: (1, 7, "abXdef"), 3: (1, 5, "abcdef")}


def test_deletion_keys():
    words = ["", "a", "aab", "ab", "abb", "éa\U0001f600"]
    number, key, lo, hi = spelling.deletion_keys(words)
    strings = {}
    for i, k, a, b in zip(number.tolist(), key.tolist(), lo.tolist(), hi.tolist(), strict=True):
        made = {words[i]} if a < 0 else {words[i][:p] + words[i][p + 1 :] for p in range(a, b + 1)}
        assert len(made) == 1
        strings.setdefault(made.pop(), set()).add(k)
    assert all(len(k) == 1 for k in strings.values()) and len({k for s in strings.values() for k in s}) == len(strings)
    assert set(strings) == {w for w in words} | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}


def _counted(rows):
    low, n = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_word_counts(spark):
    rows = [(1, "Garden GARDENS gardens × garden÷s, ÉCLAIRS éclairs Éclairs"), (1, "gardens gardens"), (None, "gardens " * 40), (3, None), (4, ""), (5, "k" * 20_000 + " " + "k" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, n int, w string")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == _counted(rows)
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_op12_query(spark):
    """The whole query on the smallest tables, near words by an index of its own."""
    counts = _counted([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    left = {}
    for w in counts:
        for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            left.setdefault(s, set()).add(w)
    near = {w: set() for w in counts}
    for group in left.values():
        for a, b in itertools.combinations(group, 2):
            if _one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    got = _seen(queries.op12_spelling(spark, SF))
    assert set(got) == set(counts)
    for w, (n, n_near, form, form_n, root) in got.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        best = best if best is not None and counts[best] >= 10 * counts[w] else None
        assert (n, n_near, form, form_n) == (counts[w], len(near[w]), best, counts.get(best))
        assert root == (w if form is None else got[form][4])


# Centroid clustering


def _lloyd(rows, k, rounds, seed, dims, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        told = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, at) in zip(kept, told, strict=True) if at == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sums = Counter()
    for d, j in told:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(kept, told, strict=True))


def test_clusters_against_all_distances(spark):
    rng = random.Random(4)
    rows = [(i % 250 - 20, [rng.choice([-1, 0, 0.25, 1.5]) + rng.gauss(0, 0.02) * (i % 3) for _ in range(5)]) for i in range(400)]
    rows += [(7, [0.5] * 5)] * 200 + [(None, [0.1] * 5), (1, None), (2, [0.0] * 4), (3, [0.0, None, 1.0, 1.0, 1.0]), (4, [math.nan] * 5), (5, [math.inf] + [0.0] * 4), (6, [])]
    df = spark.createDataFrame([(*r, 3, "z") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    for k, rounds, seed in ((12, 5, 2), (1, 2, 3), (3000, 1, 2)):
        got = Counter(tuple(r) for r in sortmeans.cluster(df, k, rounds, seed, 5).collect())
        assert got == _lloyd(rows, k, rounds, seed, 5)
    assert sortmeans.cluster(df.limit(0), dims=5).count() == 0


def test_sort_means_looks_at_fewer():
    rng = np.random.default_rng(1)
    homes = rng.integers(-3000, 3000, (30, 8))
    x = (homes[rng.integers(0, 30, 4000)] + rng.integers(-40, 40, (4000, 8))).astype("i8")
    c = np.concatenate([homes[:29], homes[3:4]]).astype("i8")  # two equal ones: the smaller number wins
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for was in (d.argmin(axis=1), rng.integers(0, 30, 4000), np.full(4000, 29)):
        label, best, taken = sortmeans.nearest(x, was, c)
        assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert sortmeans.nearest(x, d.argmin(axis=1), c)[2] < 0.3 * d.size


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_sort_means"])
    got = queries.op13_sort_means(spark, SF).select(want.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
