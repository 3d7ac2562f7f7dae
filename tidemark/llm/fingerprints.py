"""Homomorphic multiset fingerprints of documents, with DataFrame expressions only.

A text is the multiset of its passages (lines, and within them sentences and clauses, separators
kept).  Every passage is hashed to a wide vector and the vectors are added up lane by lane modulo a
power of two: ``SUMS`` lanes of 32 bits that tell multisets apart, and ``LANES`` counters modulo 2**20 of
how many passages have a hash bit set.  Addition makes the fingerprint independent of order, and
inserting or deleting a passage adds or subtracts its vector (``combine``).  The counters, taken from
their mean, are random-sign projections of the multiset, so the cosine of two of them estimates how
alike the multisets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Where passages end: after a line feed, and after a stop or comma with a space.
PASSAGES = r"(?<=\n)|(?<=[.!?,;:] )"
#: 32-bit sums; words of three 20-bit counters with a guard bit each; hashes that feed the counters.
SUMS, PER_HASH, HASHES = 8, 21, 2
LANES = 3 * PER_HASH * HASHES
_ONES = 1 | 1 << 21 | 1 << 42
_KEPT = 0xFFFFF | 0xFFFFF << 21 | 0xFFFFF << 42
_LOW = 0xFFFFFFFF
#: Documents of about this many neighbouring ids are put side by side in one task.
NEIGHBOURS = 256
#: Quantiles of the ids that place the ranges, the root of it, and how exact they are.
KNOTS, ROOT, EXACT = 1024, 32, 20_000


def _passage_vector(h: Column) -> Column:
    """Of the struct of a passage's hashes: a count, the summed lanes, and the counted bits."""
    sums = [c for i in range(SUMS // 2) for c in (h[f"s{i}"].bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h[f"s{i}"], 32))]
    bits = [F.shiftrightunsigned(h[f"s{i}"], s).bitwiseAND(F.lit(_ONES)) for i in range(HASHES) for s in range(PER_HASH)]
    return F.array(F.lit(1).cast("long"), *sums, *bits)


def _limits() -> list[int]:
    return [(1 << 40) - 1, *[_LOW] * SUMS, *[_KEPT] * (HASHES * PER_HASH)]


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets."""
    kept = F.array(*[F.lit(x).cast("long") for x in _limits()])
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), kept, lambda x, m: x.bitwiseAND(m))


def without(a: Column, b: Column) -> Column:
    """The fingerprint that is left of ``a`` when the passages of ``b`` are taken out."""
    borrow = [1 << 40, *[1 << 32] * SUMS, *[1 << 20 | 1 << 41 | 1 << 62] * (HASHES * PER_HASH)]
    lent = F.array(*[F.lit(x).cast("long") for x in borrow])
    kept = F.array(*[F.lit(x).cast("long") for x in _limits()])
    return F.zip_with(F.zip_with(F.zip_with(a, lent, lambda x, y: x + y), b, lambda x, y: x - y), kept, lambda x, m: x.bitwiseAND(m))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as ``array<bigint>``; a null text counts as empty, an empty one has no passages."""
    passages = F.filter(F.split(F.coalesce(text, F.lit("")), PASSAGES), lambda u: u != "")
    hashed = F.transform(passages, lambda u: F.struct(*[F.xxhash64(F.lit(i), u).alias(f"s{i}") for i in range(max(SUMS // 2, HASHES))]))
    zero = F.array(*[F.lit(0).cast("long")] * len(_limits()))
    kept = F.array(*[F.lit(x).cast("long") for x in _limits()])
    # The limits are applied with every addition, so that no lane ever reaches its neighbour or overflows.
    return F.aggregate(hashed, zero, lambda acc, h: F.zip_with(F.zip_with(acc, _passage_vector(h), lambda x, y: x + y), kept, lambda x, m: x.bitwiseAND(m)))


def digest(vector: Column) -> Column:
    """The summed lanes as hexadecimal digits: equal for equal multisets."""
    return F.lower(F.concat(*[F.lpad(F.hex(vector[1 + i]), 8, "0") for i in range(SUMS)]))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the centred counters, 1 for equal fingerprints, 0 for opposed ones."""

    def products(u: Column, v: Column) -> Column:
        """Sum over all counters of the centred values' products."""
        n, m = u[0], v[0]
        first = SUMS + 2

        def one(x: Column, y: Column) -> Column:
            part = lambda c, k, s: F.shiftrightunsigned(c, k).bitwiseAND(F.lit(0xFFFFF)).cast("double") * 2 - s
            return sum((part(x, k, n) * part(y, k, m) for k in (21, 42)), part(x, 0, n) * part(y, 0, m))

        each = F.zip_with(F.slice(u, first, PER_HASH * HASHES), F.slice(v, first, PER_HASH * HASHES), one)
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(products(a, a) * products(b, b))
    return F.when(F.slice(a, 1, SUMS + 1) == F.slice(b, 1, SUMS + 1), F.lit(1.0)).when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), products(a, b) / size))).otherwise(F.lit(0.0))


def _upper_of(buckets: DataFrame) -> DataFrame:
    """For each bucket in use the next higher one in use, and for the highest the lowest: ``bucket``, ``upper``.

    Two levels keep the one task that sees a whole level to a 4096th of the buckets.
    """
    level = buckets.withColumn("top", F.floor(F.col("bucket") / 4096).cast("long"))
    tops = level.groupBy("top").agg(F.min("bucket").alias("lowest"))
    above = Window.orderBy("top")
    tops = tops.select("top", F.coalesce(F.lead("lowest").over(above), F.first("lowest").over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("after"))
    inside = Window.partitionBy("top").orderBy("bucket")
    return level.withColumn("up", F.lead("bucket").over(inside)).join(tops, "top").select("bucket", F.coalesce("up", "after").alias("upper"))


def _place(key: Column, tie: Column, knots: list[int], parts: int) -> tuple[Column, Column]:
    """The range of a row in the order of rising keys and falling ties, given quantiles of the keys in rising order.

    It comes in two steps: first a struct of how many quantiles are below the key and how many up to it, from which
    (as columns) the second makes the range.

    Between two quantiles a range takes an even share of the keys; a key that holds several quantiles has its rows
    dealt by their ties over as many ranges as its quantiles have.  So neither outliers nor a key that many rows
    share makes a range large.
    """
    every, top = F.lit(knots), F.lit(knots[::ROOT])

    def at(op: str) -> Column:
        """How many quantiles are less than (or equal to) the key; looked up in two steps."""
        less = (lambda x: x < key) if op == "<" else (lambda x: x <= key)
        block = F.size(F.filter(top, less))
        return F.when(block == 0, 0).otherwise((block - 1) * ROOT + F.size(F.filter(F.slice(every, (F.greatest(block, F.lit(1)) - 1) * ROOT + 1, ROOT), less)))

    low, high = F.col("_low_at"), F.col("_high_at")
    below, above = F.get(every, low - 1).cast("double"), F.get(every, low).cast("double")
    share = F.when(above > below, (key.cast("double") - below) / (above - below)).otherwise(0.0)
    many = (high - low - 1) * parts
    own = F.greatest(F.least(F.floor((0.5 - tie.cast("double") / float(1 << 64)) * many), many), F.lit(0)).cast("long")
    # A key on a quantile begins the ranges up to the next one.
    placed = F.when(high > low, low.cast("long") * parts + own).otherwise((low.cast("long") - 1) * parts + F.least(F.floor(share * parts), F.lit(parts - 1)).cast("long"))
    return F.struct(at("<").alias("_low_at"), at("<=").alias("_high_at")), placed


def placed(docs: DataFrame, id_col: str, carried: tuple[str, ...], neighbours: int) -> DataFrame:
    """The ``carried`` columns with ``_key``, ``_tie`` and the ``_bucket`` that holds about ``neighbours`` documents.

    Ties are told by the first two carried columns, so that finding the ranges in use computes no other.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    sketch = F.percentile_approx(key, [0.0, 1 / EXACT, *(i / (KNOTS - 4) for i in range(1, KNOTS - 4)), 1 - 1 / EXACT, 1.0], EXACT)
    quantiles, n = docs.agg(sketch, F.count("*")).first()
    knots = [-(1 << 63), *sorted(quantiles or [])[:: max(1, KNOTS * neighbours // max(n, 1))]]
    found, place = _place(F.col("_key"), F.col("_tie"), knots, -(-n // (KNOTS * neighbours)) or 1)
    rows = docs.select(*carried, key.alias("_key"), F.xxhash64(*carried[:2]).alias("_tie")).select(*carried, "_key", "_tie", found.alias("_at")).select(*carried, "_key", "_tie", "_at.*")
    return rows.withColumn("_bucket", place).drop("_low_at", "_high_at")


def with_next(docs: DataFrame, id_col: str = "doc_id", carried: tuple[str, ...] = ("text",), neighbours: int = NEIGHBOURS) -> DataFrame:
    """Each document with the id and the ``carried`` columns of the next one by descending id, as ``next_<column>``.

    After the last document comes the first; a single one is its own next.  Null ids come last; rows of
    one id stand by a hash of what they carry, whatever their number.  Documents are shuffled once, by ranges
    between quantiles of the ids: the heads of the ranges need the same columns as all rows, so both read one exchange.
    """
    carried = (id_col, *carried)
    ready = placed(docs, id_col, carried, neighbours)
    order = Window.partitionBy("_bucket").orderBy(F.desc("_key"), "_tie")
    side = ready.withColumns({f"_next_{c}": F.lead(c).over(order) for c in carried} | {"_last": F.lead("_key").over(order).isNull(), "_first": F.lag("_key").over(order).isNull()})
    upper = _upper_of(common.cut(ready.select(F.col("_bucket").alias("bucket")).distinct()))
    # A left join, as an inner one would put a filter on one of the two readers of the exchange.
    heads = side.filter("_first").join(upper, F.col("_bucket") == F.col("bucket"), "left").select(F.col("upper").alias("_upper"), *[F.col(c).alias(f"_head_{c}") for c in carried])
    met = side.join(heads, (F.col("_bucket") == F.col("_upper")) & F.col("_last"), "left")
    return met.select(*carried, *[F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}") for c in carried])


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its second half replaced by the next one's beginning).

    Null texts count as empty.  Repeated rows count as documents of their own.  An empty table gives an
    empty result; other columns are not read.
    """
    own = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("vector", fingerprint(F.col("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(own, id_col, ("text", "vector")).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.left("next_text", half)))
    made = edited.select(id_col, f"next_{id_col}", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "vector", "next_vector", fingerprint(F.col("edited")).alias("edited_vector"))
    return made.select(
        id_col, "n_chars", "edited_sha256", digest(F.col("vector")).alias("fingerprint"), digest(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"), f"next_{id_col}",
    )
