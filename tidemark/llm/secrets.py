"""Secret scan: candidate strings, judged by a random forest, with DataFrame expressions only.

Candidates are values of six or more characters given to a key word, keys that begin as those of a known
issuer, private keys over several lines, and long runs of key-like characters with a digit.  Length, character transitions, the share
that dictionary words cover, the path of the text and the neighbouring words make up the features; the
forest, trained from labelled findings, tells secrets from the hashes, names, numbers and addresses
that look like them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The neighbourhood of a candidate in characters; the score at or above which it is a secret.
BEFORE, AFTER, THRESHOLD = 48, 24, 0.5
MASK = "[SECRET]"
#: Trees of the forest, their depth, and the labelled findings that are made to train it.
TREES, DEPTH, FINDINGS = 24, 9, 9000

# Words by what they say of a candidate beside or around them.
KEY_WORDS = "token secret password passwd pwd pass key apikey api_key access auth bearer credential credentials private aws login signature sas".split()
OTHER_WORDS = "sha sha1 sha256 md5 commit checksum digest hash integrity uuid guid revision rev etag blob image png jpg isbn phone card order invoice serial version id nonce build".split()
SIGNS = "! @ # $ % ^ & * ~ ?".split()
PLACEHOLDERS = "example sample test dummy fake placeholder changeme your xxxx todo redacted".split()
DICTIONARY = (
    "about account address admin after all and api app archive article asset assets author back base blog body book build button cache card cat category center class cloud code com common component"
    " config content controller core css data date de default demo dev dist doc docs document domain download edit email en error event example export file files font footer for form forum from game get"
    " google group header help home host html http https icon id image images img import in index info input item java js json key lang large library link list local log login mail main manager map media"
    " member menu message min mobile model module my name net new news node note of old on online open order org package page part path pdf photo php picture plugin png portal post print product profile"
    " project public query read release report request resource rest root sale script search section server service session set setting settings shop site size small source src static stats status store"
    " style support system table tag temp template test text the theme time title to tool tools type upload url user users util value version video view web widget with word work www xml year"
).split()
TEST_PATHS = r"(?i)(^|[/_.-])(tests?|spec|fixtures?|examples?|samples?|docs?|mock|demo|vendor|node_modules|lock)([/_.-]|$)"

PREFIXES = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abprs]-|AIza|SG\.|eyJ|npm_|hf_|dop_v1_)"
#: What stands before a value that is given to a key word; the first part, a short look back, spares most places the second.
GIVEN = r"(?<=[=:>][\s\"'`]{0,3})(?<=(?i:" + "|".join(sorted(KEY_WORDS, key=len, reverse=True)) + r")[A-Za-z0-9_-]{0,12}[\"'`\])]{0,2}\s{0,3}(?:=|:|=>|:=)\s{0,2}[\"'`]?)"
#: What a candidate looks like: a value to its closing quote, one without quotes, a key of an issuer, a long run with a digit.
VALUE = r"(?:(?<=\")[^\s\"]{6,}(?=\")|(?<=')[^\s']{6,}(?=')|(?<=`)[^\s`]{6,}(?=`)|[^\s\"'`]{5,}[^\s\"'`,;)\]}>])"
#: A private key over several lines.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s:,.-]{20,}?-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
CANDIDATE = (
    KEY_BLOCK + "|" + GIVEN + VALUE + r"|(?<![A-Za-z0-9_+/.-])" + PREFIXES + r"[A-Za-z0-9_+/.-]{12,}={0,2}"
    r"|(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9_+/.-]{16,}={0,2}"
)

FEATURES = [
    "length", "transitions", "digits", "upper", "lower", "other", "hexadecimal", "distinct", "covered", "vowels", "separators", "key_word", "assigned", "quoted", "other_word", "placeholder", "test_path",
    "prefix", "numeric", "given", "signs", "word",
]


#: Places are summed up in blocks of this many parts, so that texts with very many candidates take time by their number only.
_BLOCK = 1000


def candidates(docs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """One row for each candidate: ``key``, its offsets ``start`` and ``end`` in code points, and its neighbourhood.

    Null and empty texts have none.  A text is cut at its candidates, and each candidate takes along the ends of the
    parts around it only; the whole text is read twice, however many candidates it has.
    """
    of = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)], F.col(f"`{text_col}`").alias("t"))
    keys = [f"k{i}" for i in range(len(key))]
    found = of.select(*keys, F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("c"), "t").filter(F.size("c") > 0)
    # What stands between candidates gives their places, also where the same string stands outside of them.
    cut = found.select(*keys, "c", F.split("t", CANDIDATE, -1).alias("s"))
    parts = F.expr("concat(flatten(zip_with(slice(s, 1, size(c)), c, (x, y) -> array(x, y))), slice(s, -1, 1))")
    cut = cut.select(*keys, "c", parts.alias("p"))
    cut = cut.select(*keys, "c", F.expr(f"transform(p, x -> left(x, {AFTER}))").alias("h"), F.expr(f"transform(p, x -> right(x, {BEFORE}))").alias("r"), F.expr("transform(p, x -> length(x))").alias("n"))
    blocks = F.expr(f"transform(sequence(0, (size(n) - 1) div {_BLOCK}), b -> slice(n, b * {_BLOCK} + 1, {_BLOCK}))")
    sums = "aggregate({}, array({}), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    cut = cut.select(*keys, "c", "h", "r", blocks.alias("b"))
    cut = cut.select(*keys, "c", "h", "r", "b", F.expr(sums.format("transform(b, x -> aggregate(x, 0L, (a, y) -> a + y))", "0L")).alias("o"))
    starts = F.expr(f"flatten(transform(b, (x, i) -> slice({sums.format('x', 'element_at(o, i + 1)')}, 1, size(x))))")
    each = cut.select(*keys, "c", "h", "r", starts.alias("at")).select(*keys, "h", "r", "at", F.posexplode("c").alias("i", "candidate"))
    # Candidates have six characters or more, so this many parts reach as far as the neighbourhood does.
    back, ahead = 2 * (BEFORE // 6) + 1, 2 * (AFTER // 6) + 1
    start = F.expr("element_at(at, cast(2 * i + 2 as int))")
    before = F.expr(f"right(array_join(slice(r, cast(greatest(2 * i + 2 - {back}, 1) as int), cast(least(2 * i + 1, {back}) as int)), ''), {BEFORE})")
    after = F.expr(f"left(array_join(slice(h, cast(2 * i + 3 as int), {ahead}), ''), {AFTER})")
    made = each.select(*keys, start.alias("start"), (start + F.length("candidate")).alias("end"), "candidate", before.alias("before"), after.alias("after"))
    return made.select(*[F.col(k).alias(c) for k, c in zip(keys, key, strict=True)], "start", "end", "candidate", "before", "after")


def _listed(words: list[str]) -> Column:
    """An array of words as one literal, which keeps plans small."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def _share(pattern: str) -> Column:
    c = F.col("candidate")
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def features(found: DataFrame, path_col: str | None = None) -> DataFrame:
    """The forest's features of candidates, null-safe, as columns named in ``FEATURES``."""
    c, before, after = F.col("candidate"), F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit(""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    word = lambda ws: r"(?i)(^|[^a-z])(" + "|".join(ws) + r")([^a-z]|$)"
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    words = F.split(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")), r"[^a-z]+")
    known = F.aggregate(words, F.lit(0), lambda n, w: n + F.when((F.length(w) > 1) & F.array_contains(_listed(DICTIONARY), w), F.length(w)).otherwise(0))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    made = {
        "length": F.log1p(F.length(c)),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(c),
        "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "lower": _share("[a-z]"), "other": _share("[^A-Za-z0-9]"),
        "hexadecimal": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "covered": known / F.length(c),
        "vowels": _share("[aeiouyAEIOUY]"), "separators": _share("[/._-]"),
        "key_word": flag(before.rlike(word(KEY_WORDS))),
        "assigned": flag(before.rlike(r"[A-Za-z_\"'](\s*(=|:|=>|:=)\s*|\s+)[\"'`]?$") & before.rlike(r"[=:>][\s\"'`]*$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "other_word": flag(before.rlike(word(OTHER_WORDS))),
        "placeholder": flag(F.concat(c, F.lit(" "), before).rlike("(?i)" + "|".join(PLACEHOLDERS))),
        "test_path": flag(path.rlike(TEST_PATHS)),
        "prefix": flag(c.rlike("^(?:-----BEGIN |" + PREFIXES + ")")),
        "numeric": flag(c.rlike("^[0-9.+/-]+$")),
        "given": flag(before.rlike(GIVEN + "$")), "signs": _share(r"[^A-Za-z0-9/._:,-]"), "word": flag(c.rlike(r"^\p{L}?[^\p{Lu}\P{L}]*$|^\p{Lu}+$")),
    }
    return found.withColumns(made)


# Templates of findings: parts apart by ~, each a letter and what belongs to it.  ``=`` is text as it stands, ``c`` one of
# several texts, h d m u l s so many random characters (hexadecimal, digits, mixed, upper, capitals, with signs), w W a
# dictionary word, k a key word, o another word, x a sign.
_PROSE = "w~= ~w~= "
_NAMED = _PROSE + '~k~c = ",=",: ",=,: , = \',:, => "'
_OTHER = _PROSE + '~o~c ,: ,=, = ",-'
_UUID = "h8~=-~h4~=-4~h3~=-a~h3~=-~h12"
_SECRET = [
    ("=AKIA~u16", _PROSE), ("=AKIA~u16", _NAMED), ("=ghp_~m36", _PROSE), ("=sk_live_~m24", _NAMED), ("h40", _NAMED), ("h18", _NAMED), ("h32", _NAMED), ("m40", _NAMED), ("m22", _NAMED), ("h64", _NAMED),
    ("=xoxb-~d12~=-~m24", _PROSE), ("=eyJhbGciOiJIUzI1NiJ9.~m40~=.~m43", _NAMED), ("=AIza~m35", _PROSE), ("h20", _NAMED), ("=AKIA~l16", _PROSE), ("=ghp_~l36", _NAMED), ("m6", _NAMED), ("m9", _NAMED), ("m12", _NAMED),
    ("=-----BEGIN RSA PRIVATE KEY-----\n~m64~=\n~m64~=\n~m40~=\n-----END RSA PRIVATE KEY-----", _PROSE), ("=-----BEGIN PRIVATE KEY-----\n~m64~=\n~m20~=\n-----END PRIVATE KEY-----", "w~=\n"),
    ("s8", _NAMED), ("s12", _NAMED), ("s24", _NAMED), ("w~d1~h3~d1", _NAMED), ("w~x~w~d2", _NAMED), ("W~d3~x", _NAMED), ("cp@ss,P4ss,s3cr3t,adm1n,qw3rty~x~m5", _NAMED),
]
_HARMLESS = [
    ("h40", _OTHER), ("h64", _OTHER), ("h32", _OTHER), ("h40", _PROSE), (_UUID, _OTHER), (_UUID, _PROSE), ("cmail,www,smtp,cdn,img~d1~=.~w~c,example,site~=.~ccom,org,net", "w~=.~d2~=@"),
    ("=/~w~=/~w~d4~=/~w~=-~w~=.~chtml,js,css,png,php", _PROSE), ("w~=_~w~=_~w~=_v~d2", _PROSE), ("w~=-~w~=-~w~=-~d3", _PROSE), ("w~=.~w~=.~w~d1~=.~w", _PROSE), ("=20~d2~=-0~d1~=-1~d1~=T0~d1~=.~d6", _PROSE),
    ("d16", _PROSE), ("d19", _OTHER), ("d4~=-~d4~=-~d4~=-~d4", _OTHER), ("d1~=.~d2~=.~d3~=-~w~=.~d2~=.~w", _PROSE), ("=EXAMPLE~u12~=1", _NAMED), ("=your-~k~=-here-~d3", _NAMED), ("w~w~w~w~d1", _PROSE), ("=test~d2~=xxxxxxxxxxxxxxxx", _NAMED),
    ("w", _NAMED), ("W", _NAMED), ("crequired,optional,string,process,undefined,function,everything,important,please,another,between,because", _NAMED), ("w~=.~w", _NAMED), ("w~=_~w", _NAMED), ("w~=(~w~=)", _NAMED), ("=http://~w~=.com/~w", _NAMED),
    ("=${~w~=_~w~=}", _NAMED), ("=changeme~d2", _NAMED), ("w~=,~w", _NAMED), ("w~=-~w", _NAMED), ("=process.env.~w", _NAMED), ("=<~w~=-~w~=>", _NAMED),
]


def _filled(template: Column, salt: str) -> Column:
    """A template with its parts filled in by hashes of ``id``."""

    def part(p: Column, i: Column) -> Column:
        z = F.sha2(F.concat_ws(":", "id", F.lit(salt), i), 512)
        kind, arg, b = F.left(p, F.lit(1)), F.substring(p, 2, 999), F.base64(F.unhex(z))
        first = lambda x: F.left(x, arg.try_cast("int"))
        pick = lambda xs: F.element_at(xs, (F.pmod(F.xxhash64(z), F.size(xs)) + 1).cast("int"))
        return (
            F.when(kind == "=", arg).when(kind == "h", first(z)).when(kind == "d", first(F.translate(z, "abcdef", "123456"))).when(kind == "m", first(F.translate(b, "+/=", "aB7")))
            .when(kind == "u", F.upper(first(F.translate(b, "+/=abcdef01", "XYZQRSTUV29")))).when(kind == "l", first(F.translate(F.upper(b), "+/=0123456789", "XYZQRSTUVGHJK")))
            .when(kind == "s", first(F.translate(b, "aeiouAEIOU+/=", "@$!%#~^&*?!$@"))).when(kind == "w", pick(_listed(DICTIONARY))).when(kind == "W", F.initcap(pick(_listed(DICTIONARY))))
            .when(kind == "k", pick(_listed(KEY_WORDS))).when(kind == "o", pick(_listed(OTHER_WORDS))).when(kind == "x", pick(_listed(SIGNS))).otherwise(pick(F.split(arg, ",")))
        )

    return F.array_join(F.transform(F.split(template, "~"), part), "")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings with their label: ``candidate, before, after, path, label``, made by rule from hashes of numbers.

    Secrets are keys of common issuers and random strings given to a key word; the others are what scans
    report falsely: digests, identifiers, addresses, paths, versions, numbers, dates, placeholders.
    """
    half = max(1, n // 2)
    secret = F.col("id") < half
    of = lambda xs, k: F.element_at(_listed([x[k] for x in xs]), (F.pmod("id", F.lit(len(xs))) + 1).cast("int"))
    either = lambda k: F.when(secret, of(_SECRET, k)).otherwise(of(_HARMLESS, k))
    made = spark.range(0, 2 * half, 1, 4).select("id", secret.cast("double").alias("label"), _filled(either(0), "candidate").alias("candidate"), _filled(either(1), "before").alias("before"))
    closing = F.when(F.col("before").rlike("[\"']$"), F.substring("before", -1, 1)).otherwise(F.lit(""))
    path = F.when(F.pmod(F.xxhash64(F.lit("path"), "id"), F.lit(10)) < F.when(F.col("label") == 1, 1).otherwise(3), F.lit("tests/fixtures/data.txt")).otherwise(F.lit("src7"))
    return made.filter(F.length("candidate") >= 6).select("candidate", "before", F.concat(closing, F.lit(" "), _filled(F.lit("w"), "after")).alias("after"), path.alias("path"), "label")


def _assembled(found: DataFrame, path_col: str | None) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(features(found, path_col))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Train the forest from labelled findings (``candidate, before, after, path, label``).

    The features are made once and read again by every pass of the training.  Findings without a candidate or label
    take no part; repeated ones count as often as they stand; none at all, or of one label only, is an error of the trainer.
    """
    ready = _assembled(findings.filter("candidate != '' AND label IS NOT NULL"), "path").select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, maxBins=64).fit(common.cut(ready))


def scan(docs: DataFrame, model: RandomForestClassificationModel, key: list[str], text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """All candidates of whole texts with their score: ``key, start, end, kind, score, predicted`` and the string itself.

    Null texts and texts without candidates give no rows.  Repeated rows give repeated findings; an
    empty table gives an empty result; columns not named are not read, and keys may be named like features.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    path = F.lit("") if path_col is None else F.col(f"`{path_col}`").cast("string")
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, key, strict=True)], path.alias("_path"), F.col(f"`{text_col}`").alias("_text"))
    found = candidates(plain, [*keys, "_path"], "_text")
    kind = F.when(F.col("candidate").rlike("^A[KS]IA"), "cloud_key").when(F.col("prefix") == 1, "issuer_token").when(F.col("hexadecimal") == 1, "hexadecimal").otherwise("string")
    scored = model.transform(_assembled(found, "_path"))
    score = vector_to_array("probability")[1]
    return scored.select(*[F.col(k).alias(c) for k, c in zip(keys, key, strict=True)], "start", "end", kind.alias("kind"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "candidate")


def redact(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """The documents with every secret replaced by ``MASK``; all rows and columns stay, ``count_col`` is set to the new length.

    Rows without candidates are passed on as they are; only the others, a small part, are shuffled.  Rows meet their
    findings by 128 bits of hash of their text, path and plain columns, so copies with ids of their own are spread.
    Null texts stay null, repeated rows stay as often as they stand, columns may have any names; an empty table stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: n for n, c in zip(names, docs.columns, strict=True)}
    text, path, count = at[text_col], at.get(path_col), at.get(count_col)
    hashed = [c for c, kind in plain.dtypes if c != count and not any(x in kind for x in ("map<", "variant", "geometry", "geography"))]
    has = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    row = [F.xxhash64(F.lit(i), *hashed).alias(f"h{i}") for i in (1, 2)]
    keyed = plain.filter(has).select("*", *row)
    found = scan(keyed, model, ["h1", "h2"], text, path).groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", "predicted"))).alias("found"))
    hits = found.filter(F.exists("found", lambda x: x["predicted"] == 1)).withColumn("hits", F.transform("found", lambda x: x["predicted"] == 1)).drop("found")
    between, found_in = F.split(F.col(text), CANDIDATE, -1), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(found_in, lambda x, i: F.when(F.get("hits", i), F.lit(MASK)).otherwise(x))
    masked = F.array_join(F.flatten(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda x, y: F.array(x, y))), "")
    changed = keyed.join(hits, ["h1", "h2"], "left").withColumn(text, F.when(F.col("hits").isNull(), F.col(text)).otherwise(masked))
    if count:
        changed = changed.withColumn(count, F.when(F.col("hits").isNull(), F.col(count)).otherwise(F.length(text).cast(plain.schema[count].dataType)))
    return plain.filter(~has).unionByName(changed.select(*names)).toDF(*docs.columns)
