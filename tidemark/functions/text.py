"""Column functions over text: tokens, shingles, similarity, numbers, error rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing of a text's subject; a parameter wherever tokens are made.
FILLERS = tuple(
    "about according after also around been before between could during from have here including into just like made make more most only over posted reached reported said says should some still such than that"
    " their them then there these they this those very were what when where which while will with within would your"
    " 그러나 그런 그리고 까지 된다 됩니다 또는 라고 보다 부터 없다 에게 에서 에요 예요 으로 이고 이다 이라 이런 이며 이에요 입니다 있다 저런 처럼 하는 하지만 한다 합니다 했다".split()
)
WORD = r"[\p{L}\p{Nl}\p{No}]{2,}"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
#: Tokens of a shingle, and the similarity from which texts count as near copies.
SHINGLE, NEAR = 3, 0.6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Content words in order: letter runs of two or more, lower case, without fillers; ASCII ones have four letters or more."""
    # Cut at what is no letter, which is much faster than looking around each letter for words to be kept.
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nl}\p{No}]+")
    long = lambda w: (F.length(w) >= 4) | ((F.length(w) >= 2) & (F.octet_length(w) > F.length(w)))
    return F.filter(runs, (lambda w: long(w) & ~w.isin(*fillers)) if fillers else long)


def hashed_shingles(words: Column, size: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the runs of ``size`` words, of fewer words those of each word."""

    def of(ws: Column) -> Column:
        runs = F.arrays_zip(*[F.slice(ws, F.lit(i + 1), F.greatest(F.size(ws) - size + 1, F.lit(0))).alias(f"w{i}") for i in range(size)])
        return F.when(F.size(ws) >= size, F.transform(runs, lambda x: F.xxhash64(x))).otherwise(F.transform(ws, lambda w: F.xxhash64(w)))

    return F.sort_array(F.array_distinct(let(words, of)))


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` words, space-joined; of fewer words each word is one."""

    def of(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.array_join(F.slice(ws, i + 1, size), " "))
        return F.array_distinct(F.when(F.size(ws) >= size, runs).otherwise(ws))

    return let(words, of)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_similarity(a: Column, b: Column, size: int = SHINGLE) -> Column:
    """Jaccard similarity of the shingles of two token arrays, or of their words if either is shorter than a shingle."""
    short = (F.size(a) < size) | (F.size(b) < size)
    return F.when(short, jaccard(F.array_distinct(a), F.array_distinct(b))).otherwise(jaccard(shingles(a, size), shingles(b, size)))


def numbers(text: Column) -> Column:
    """Sorted distinct numbers of a text as doubles; a comma counts only before three digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))))


def four_places(values: Column) -> Column:
    """Doubles as text with four places, comma-joined, by their exact value: Java's formats round the shortest digits that tell a double from others."""
    return F.udf(lambda xs: ",".join(["%.4f" % x for x in xs]), "string", useArrow=True)(values)


def error_rate(truth: Column, heard: Column) -> Column:
    """Character error rate against ``truth``: edit distance over its length, 0 for an empty truth."""
    return F.when(F.length(truth) == 0, F.lit(0.0)).otherwise(F.round(F.levenshtein(truth, heard) / F.length(truth), 4))


def agreement(a: Column, b: Column) -> Column:
    """Percent agreement of two transcripts, the same from either side."""
    return 100 * (1 - (error_rate(a, b) + error_rate(b, a)) / 2)


def squeezed(text: Column) -> Column:
    """Trimmed, lower case, any white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def spoken_key(text: Column) -> Column:
    """Only Hangul syllables, a-z and digits, for comparing transcripts."""
    return F.regexp_replace(F.lower(text), "[^가-힣a-z0-9]", "")


def first_number(text: Column) -> Column:
    """The first number of a text, with sign, groups of thousands and exponent; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?", 0)
    return F.regexp_replace(found, ",", "").try_cast("double")


def deloop(text: Column, most: int = 2) -> Column:
    """A text with runs of one word cut to ``most`` repetitions; words are joined by single spaces."""
    def of(words: Column) -> Column:
        def keep(i: Column) -> Column:
            before = F.slice(words, F.greatest(i - most + 1, F.lit(1)), F.lit(most))
            return (i < most) | F.exists(before, lambda w: w != F.element_at(words, i + 1))

        kept = F.filter(F.sequence(F.lit(0), F.size(words) - 1), keep)
        return F.when(F.size(words) == 0, text).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(words, i + 1)), " "))

    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), of)
