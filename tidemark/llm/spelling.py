"""Spelling variants: words that one edit turns into another, and the frequent form that each leads to.

Two words are one edit apart if one is the other less a letter, or if both less a letter at the same place are
equal.  So each word is given an integer key for itself and one for each string that deleting a letter leaves, made
from polynomial hashes of its prefixes and suffixes for a whole batch of words at once.  Keys are dealt by their
upper bits and sorted; only those that meet another word's are looked up as strings, where chance collisions fall out.
Words of one deletion string and place are all near each other, so counts and the best word come from the group as
it stands and its pairs are never listed.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base of the polynomial, odd, and what it times its inverse is 1 modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Code points of words whose keys are made at once; a longer word is a batch of its own.
BATCH_CHARS = 1 << 20
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, drop_every: int | None = 31, least_chars: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of letters of all whole texts, lower-cased (A to Z only) and counted: ``word, n``.

    With ``drop_every``, runs whose crc32 of ``<id>:<run>`` it divides lose the letter at that number modulo their
    length.  Words of fewer code points or occurrences are left out.  Null texts have no runs, a null id is an
    empty string, repeated rows count again.
    """
    runs = docs.select(F.col(f"`{id_col}`").cast("string").alias("d"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("w"))
    low = runs.select("d", F.translate("w", _UPPER, _LOWER).alias("w"))
    word: Column = F.col("w")
    if drop_every:
        low = low.withColumn("h", F.crc32(F.concat(F.coalesce("d", F.lit("")), F.lit(":"), "w").cast("binary")))
        p = F.pmod(F.col("h"), F.length("w")).cast("int")
        word = F.when(F.col("h") % drop_every == 0, F.concat(F.expr("left(w, p)"), F.expr("substring(w, p + 2)"))).otherwise(F.col("w"))
        low = low.withColumn("p", p)
    counted = low.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and of what is left of them by one deletion: ``word number, key, lo, hi``.

    A letter that repeats gives one string wherever it is deleted from; ``lo`` to ``hi`` are those places, -1 and -1 for
    the word itself.  The key of a prefix and a suffix put together is the prefix's hash plus the suffix's shifted by
    one place.
    """
    sizes = np.array([len(w) for w in words], "i8")
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(words)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - begins[word]
    power = np.full(int(sizes.max(initial=0)) + 1, BASE, "u8")
    power[0] = 1
    power = np.cumprod(power)
    term = _mixed(flat.astype("u8") + np.uint64(1)) * power[place]
    ends = np.concatenate([np.zeros(1, "u8"), np.cumsum(term, dtype="u8")])
    total = ends[begins + sizes] - ends[begins]
    prefix = ends[:-1] - ends[begins][word]
    suffix = total[word] - prefix - term
    left = _mixed(prefix + suffix * np.uint64(INVERSE) + _mixed(sizes[word].astype("u8")))
    whole = _mixed(total + _mixed(sizes.astype("u8") + np.uint64(1)))
    first = place == 0
    first[1:] |= flat[1:] != flat[:-1]
    at = np.flatnonzero(first)
    until = np.append(at[1:], len(flat)) - 1
    none = np.full(len(words), -1)
    return np.concatenate([word[at], np.arange(len(words))]), np.concatenate([left[at], whole]).view("i8"), np.concatenate([place[at], none]), np.concatenate([place[until] if len(until) else place[at], none])


def _keyed(vocab: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            room = np.cumsum([len(w) for w in words]) // BATCH_CHARS if words else []
            for _, block in itertools.groupby(range(len(words)), key=lambda i: room[i]):  # noqa: B023
                mine = list(block)
                number, key, lo, hi = deletion_keys([words[i] for i in mine])
                yield pa.RecordBatch.from_arrays([pa.array(names[mine][number]), pa.array(key), pa.array(lo), pa.array(hi)], names=["id", "key", "lo", "hi"])

    return vocab.select("id", "word").mapInArrow(run, "id long, key long, lo long, hi long")


def _by_key(df: DataFrame) -> DataFrame:
    """Rows dealt by the upper bits of their keys, and sorted by key within."""
    return df.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut so that no key is split; a key has few rows, as many as one letter can be put into one string."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(batch.schema.get_field_index("key"))[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose key belongs to two words at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            keys, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            most, least = np.maximum.reduceat(ids, begin), np.minimum.reduceat(ids, begin)
            met = np.repeat(most != least, np.diff(np.append(begin, len(keys))))
            yield from table.filter(pa.array(met)).combine_chunks().to_batches()

    return _by_key(keyed).mapInArrow(run, keyed.schema)


def near_in_group(members: list[tuple[int, str, int, int, int]]) -> dict[int, tuple[int, int, str]]:
    """For the words ``id, word, n, lo, hi`` of one key: how many are near each of them, and the most frequent of these.

    Strings are compared, so words that only share a hash don't meet.
    """
    strings: dict[str, list] = defaultdict(list)
    for m in members:
        strings[m[1] if m[3] < 0 else m[1][: m[3]] + m[1][m[3] + 1 :]].append(m)
    found: dict[int, tuple[int, int, str]] = {}

    def add(to: int, count: int, n: int, word: str) -> None:
        was = found.get(to)
        best = (n, word) if was is None or (-n, word) < (-was[1], was[2]) else was[1:]
        found[to] = ((was[0] if was else 0) + count, *best)

    for group in strings.values():
        if len(group) < 2:
            continue
        whole = next((m for m in group if m[3] < 0), None)
        longer = [m for m in group if m[3] >= 0]
        if whole is not None and longer:
            best = min(longer, key=lambda m: (-m[2], m[1]))
            add(whole[0], len(longer), best[2], best[1])
            for m in longer:
                add(m[0], 1, whole[2], whole[1])
        # Words with a letter each at one place of the same string: no two share more than one place.
        places: dict[int, list] = defaultdict(list)
        if len(longer) > 1:
            for m in longer:
                for p in range(m[3], m[4] + 1):
                    places[p].append(m)
        for at in places.values():
            if len(at) > 1:
                first, second = sorted(at, key=lambda m: (-m[2], m[1]))[:2]
                for m in at:
                    best = second if m[0] == first[0] else first
                    add(m[0], len(at) - 1, best[2], best[1])
    return found


def _near(shared: DataFrame) -> DataFrame:
    """What each key says of its words: ``id, n_near, best_n, best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            rows = zip(*(table.column(c).to_pylist() for c in ("key", "id", "word", "n", "lo", "hi")), strict=True)
            out = [(i, *found) for _, group in itertools.groupby(rows, key=lambda r: r[0]) for i, found in near_in_group([r[1:] for r in group]).items()]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_near", "best_n", "best"])

    return _by_key(shared).mapInArrow(run, "id long, n_near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """The last form that each word with a form leads to, by jumps that double: ``word, root``.

    Forms are ten times as frequent as their words, so chains are short, and a handful of jumps ends them.
    """
    hops = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = common.cut(hops.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        hops = met.select("word", "root")
        if not met.filter("moved").limit(1).count():
            return hops


def variants(words: DataFrame, factor: int = 10, word_col: str = "word", count_col: str = "n") -> DataFrame:
    """Near words and forms of counted words: ``word, n, n_near, form, form_n, root``.

    Two words are near if one inserted, deleted or replaced code point parts them.  A word's form is its near word of
    largest count, ties to the smallest by code points, if that is at least ``factor`` (over 1) times its own; else
    null.  Words of any length, empty ones too, take part; null words and counts don't.  Rows of one word are added up.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1, or forms could go round in a circle")
    spark = words.sparkSession
    common.importable(spark)
    counted = words.select(F.col(f"`{word_col}`").alias("word"), F.col(f"`{count_col}`").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n"))
    vocab = common.cut(counted.withColumn("id", F.monotonically_increasing_id()))
    told = _near(_shared(_keyed(vocab)).join(vocab, "id").select("key", "id", "word", "n", "lo", "hi"))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    facts = told.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    met = vocab.join(facts, "id", "left").withColumn("ok", F.coalesce(-F.col("b.m") >= F.col("n") * factor, F.lit(False)))
    judged = common.cut(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("b.w")).alias("form"), F.when(F.col("ok"), -F.col("b.m")).alias("form_n")))
    roots = _roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
