"""Labels of timed transcripts, the relational residue of recorded media, and image operators over decoded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.storage import cut

from . import graph


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)[^\w가-힣]", " "), r"\s+"), lambda w: w != "")


#: A run summary that of nothing; ``lead`` and ``tail`` are the lengths of the first and the last run.
_NO_RUN = "named_struct('n', 0L, 'first', cast(null AS string), 'lead', 0L, 'last', cast(null AS string), 'tail', 0L, 'longest', 0L)"


def run_summary(words: Column) -> Column:
    """The runs of equal words of an array in short: how many words, first and last run, and the longest."""

    def step(x: Column, w: Column) -> Column:
        same = F.coalesce(x["last"] == w, F.lit(False))
        tail = F.when(same, x["tail"] + 1).otherwise(F.lit(1).cast("long"))
        lead = F.when((x["n"] == x["lead"]) & (same | (x["n"] == 0)), x["lead"] + 1).otherwise(x["lead"])
        return F.struct((x["n"] + 1).alias("n"), F.coalesce(x["first"], w).alias("first"), lead.alias("lead"), w.alias("last"), tail.alias("tail"), F.greatest(x["longest"], tail).alias("longest"))

    return F.aggregate(words, F.expr(_NO_RUN), step)


def merged_runs(x: Column, y: Column) -> Column:
    """The summary of two stretches of words, one after the other, from theirs; any grouping in order gives the same."""
    meet = F.coalesce(x["last"] == y["first"], F.lit(False))
    lead = F.when(meet & (x["lead"] == x["n"]), x["n"] + y["lead"]).otherwise(x["lead"])
    tail = F.when(meet & (y["tail"] == y["n"]), y["n"] + x["tail"]).otherwise(y["tail"])
    longest = F.greatest(x["longest"], y["longest"], F.when(meet, x["tail"] + y["lead"]).otherwise(F.lit(0).cast("long")))
    both = F.struct((x["n"] + y["n"]).alias("n"), x["first"].alias("first"), lead.alias("lead"), y["last"].alias("last"), tail.alias("tail"), longest.alias("longest"))
    return F.when(x["n"] == 0, y).when(y["n"] == 0, x).otherwise(both)


def longest_run(segments: DataFrame, key: str = "transcript_id", fan: int = 1024) -> DataFrame:
    """The longest run of one word in each transcript (``key, idx, text``), across segments too: ``key, longest``.

    Each segment is summarised where it is read, and summaries of neighbours are merged in order, ``fan`` places of
    ``idx`` at a time, until a transcript is one; so a transcript of any length is dealt over tasks.
    """
    parts = segments.select(key, F.col("idx").cast("long").alias("p"), run_summary(_words(F.col("text"))).alias("r")).filter("r.n > 0")
    low, high = segments.agg(F.min("idx").cast("long"), F.max("idx").cast("long")).first()
    spread = 0 if low is None else high - low
    parts = parts.withColumn("p", F.col("p") - F.lit(low or 0))
    while True:
        block = F.floor(F.col("p") / F.lit(fan)).cast("long")
        inner = F.aggregate(F.array_sort(F.collect_list(F.struct("p", "r"))), F.expr(_NO_RUN), lambda x, y: merged_runs(x, y["r"]))
        parts, spread = parts.groupBy(key, block.alias("q")).agg(inner.alias("r")).withColumnRenamed("q", "p"), spread // fan
        if not spread:
            return parts.select(key, F.col("r.longest").alias("longest"))


def degeneracy(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Why a transcript is garbage, null if it isn't: ``key, n_words, reason``.  Under six words nothing is judged."""
    words = segments.select(key, F.explode(_words(F.col("text"))).alias("word"))
    tiny = F.col("word").rlike(r"^\d+$") | (F.length("word") <= 1)
    facts = words.groupBy(key).agg(F.count("*").alias("n_words"), F.count_distinct("word").alias("n_distinct"), F.count_if(tiny).alias("n_tiny")).join(longest_run(segments, key), key)
    n = F.col("n_words")
    reason = F.when(n < 6, None).when(F.col("n_tiny") / n > 0.5, "tiny_tokens").when(F.col("longest") >= F.greatest(F.lit(8), F.floor(n * 0.25)), "repeat_loop").when(F.col("n_distinct") / n < 0.35, "low_diversity")
    return facts.select(key, "n_words", reason.alias("reason"))


def coverage(segments: DataFrame, clips: DataFrame, key: str = "transcript_id") -> DataFrame:
    """The status of each clip (``key, duration, rms``): how much is voiced, how sure, and whether it is garbage."""
    voiced = F.col("no_speech_prob") < 0.5
    facts = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum(F.when(voiced, F.col("end") - F.col("start"))).alias("v"), F.avg(F.when(voiced, F.col("avg_logprob"))).alias("l"))
    met = clips.join(facts, key, "left").join(degeneracy(segments, key).select(key, "reason"), key, "left")
    v = F.round(F.coalesce("v", F.lit(0.0)), 6)  # sums of floats differ in their last digits with the order of rows
    ratio = F.when(F.coalesce("duration", F.lit(0.0)) > 0, F.round(v / F.col("duration"), 3)).otherwise(0.0)
    sure = F.round("l", 3)
    status = (
        F.when(v < 0.8, F.when(F.col("rms") > 0.02, "NO_SPEECH_OR_MASKED").otherwise("SILENT")).when((ratio < 0.5) & (F.col("rms") > 0.02), "COVERAGE_GAP").when(sure < -1.0, "LOW_CONFIDENCE").otherwise("OK")
    )
    final = F.when(F.col("reason").isNotNull() & status.isin("OK", "LOW_CONFIDENCE"), "DEGENERATE").otherwise(status)
    return met.select(key, F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.round(v, 1).alias("voiced_sec"), ratio.alias("coverage_ratio"), sure.alias("mean_logprob"), "reason", final.alias("status"))


def best_of(candidates: DataFrame, key: str = "transcript_id") -> DataFrame:
    """The better candidate of each clip: not garbage, then coverage to a tenth, then the stronger model."""
    order = Window.partitionBy(key).orderBy(F.col("degenerate").asc(), F.round("coverage_ratio", 1).desc(), F.col("is_strong").desc(), F.col("model"))
    return candidates.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def strip_boilerplate(segments: DataFrame, phrases: list[str]) -> DataFrame:
    """Segments without those that are exactly a known phrase, compared by letters and digits."""
    known = F.array(*[tx.spoken_key(F.lit(p)) for p in phrases])
    return segments.filter(~F.array_contains(known, tx.spoken_key(F.col("text"))))


def collapse_repeats(lines: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Lines without those equal to the line before."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("idx"))
    return lines.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("text"))).drop("_b")


def thin(rows: DataFrame, most: int, key: str, order: str) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in order: the places that multiples of their distance fall on.

    Without a limit (0 or less) all rows stay.
    """
    if most <= 0:
        return rows
    w = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    step, i = F.col("_n") / most, F.col("_i")
    near = F.ceil(i / step)
    falls = [(near + d >= 0) & (near + d < most) & (F.floor((near + d) * step) == i) for d in (-1, 0, 1)]  # whatever the rounding
    return placed.filter((F.col("_n") <= most) | falls[0] | falls[1] | falls[2]).drop("_i", "_n")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ocr_terms(reads: DataFrame, least: float = 0.5, key: str = "clip") -> DataFrame:
    """Distinct Latin terms of confident reads (``clip, idx, text, confidence``), first seen first: ``clip, term, ord``."""
    good = reads.filter((F.col("confidence") >= least) & (F.length(F.trim("text")) >= 2))
    each = good.select(key, "idx", F.posexplode(F.split("text", r"[^A-Za-z]+")).alias("p", "term")).filter(F.length("term") >= 2)
    firsts = each.groupBy(key, F.lower("term").alias("_k")).agg(F.min(F.struct("idx", "p", "term")).alias("f"))
    return firsts.select(key, F.col("f.term").alias("term"), F.row_number().over(Window.partitionBy(key).orderBy("f.idx", "f.p")).alias("ord"))


def hamming_pairs(a: DataFrame, b: DataFrame, radius: int, key: str) -> DataFrame:
    """Pairs of a key's 64-bit hashes (``key, hash``) that differ by ``radius`` bits at most: ``key, x, y``.

    Two hashes that near agree on one of ``radius`` + 1 blocks of bits, so only those that share a block are compared.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft("hash", 64 - hi), 64 - hi + lo).alias("v")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])  # noqa: B905
    side = lambda df, name: df.select(key, F.col("hash").alias(name), F.explode(blocks).alias("block"))
    return side(a, "x").join(side(b, "y"), [key, "block"]).filter(hamming(F.col("x"), F.col("y")) <= radius).select(key, "x", "y").distinct()


def kept_frames(frames: DataFrame, radius: int = 4, key: str = "clip", least: int = 256) -> DataFrame:
    """Frames (``clip, idx, hash``) that differ from every kept frame before by more than ``radius`` bits.

    Frames without a hash are all kept.  Of equal hashes the first counts.  In a round the first few undecided frames
    of every clip are decided among themselves, in order (``graph.first_seeds``), and of the rest those near a kept one
    go; kept frames are far from one another, so a long still scene is gone after one comparison.  The number of frames
    looked at grows while most of them are kept.  No clip is gathered anywhere: what a round takes of it is bounded.
    """
    left = cut(frames.filter("hash IS NOT NULL").groupBy(key, "hash").agg(F.min("idx").alias("idx")))
    kept, most = frames.filter("hash IS NULL").select(key, "idx", "hash"), least
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy(key).orderBy("idx", "hash"))
        looked = cut(left.withColumn("_r", rank).filter(F.col("_r") <= most).select(key, "idx", "hash"))
        named = lambda x: looked.select(key, F.col("hash").alias(x), F.struct("idx", "hash").alias({"x": "a", "y": "b"}[x]))  # noqa: B023, E731
        edges = hamming_pairs(looked, looked, radius, key).filter("x != y").join(named("x"), [key, "x"]).join(named("y"), [key, "y"]).filter("a < b").select(key, "a", "b")
        members = graph.first_seeds(edges, [key]).select(key, F.col("node.hash").alias("hash"))
        chosen = cut(looked.join(members, [key, "hash"], "left_anti"))
        near = hamming_pairs(chosen, left, radius, key).select(key, F.col("y").alias("hash")).distinct()
        left = cut(left.join(near, [key, "hash"], "left_anti").join(looked, [key, "hash"], "left_anti"))
        share = chosen.count() / looked.count()
        most = min(4 * most, 64 * least) if share > 0.5 else least
        kept = kept.unionByName(chosen.select(key, "idx", "hash"))
    return kept


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue, saturation and value of a colour, each from 0 to 255."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = top - low
    sixth = F.when(span == 0, 0.0).when(r == top, F.pmod((g - b) / span, F.lit(6.0))).when(g == top, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.struct(F.floor(sixth / 6 * 255).cast("int").alias("h"), F.when(top == 0, 0).otherwise(F.floor(span / top * 255)).cast("int").alias("s"), top.cast("int").alias("v"))


def colour_statistics(pixels: DataFrame, key: str = "clip") -> DataFrame:
    """Mean brightness, saturation and contrast of each clip's frames (``clip, frame, r, g, b``): contrast is the deviation of values within a frame."""
    c = hsv(F.col("r"), F.col("g"), F.col("b"))
    frames = pixels.groupBy(key, "frame").agg(F.avg(c["v"]).alias("v"), F.avg(c["s"]).alias("s"), F.stddev_pop(c["v"]).alias("d"))
    return frames.groupBy(key).agg(F.count("*").alias("frames"), F.bround(F.avg("v"), 1).alias("brightness"), F.bround(F.avg("s"), 1).alias("saturation"), F.bround(F.avg("d"), 1).alias("contrast"))


def average_hash(lumas: DataFrame, key: str = "clip") -> DataFrame:
    """A 64-bit hash of each frame's 64 luma values (``clip, idx, i, luma``): a bit is set where a value is over the mean."""
    mean = lumas.groupBy(key, "idx").agg(F.avg("luma").alias("_m"))
    bit = F.when(F.col("luma") > F.col("_m"), F.expr("shiftleft(1L, cast(i as int))")).otherwise(F.lit(0).cast("long"))
    return lumas.join(mean, [key, "idx"]).groupBy(key, "idx").agg(F.bit_or(bit).alias("hash"))


def palette(pixels: DataFrame, k: int = 6, key: str = "clip", step: int = 32) -> DataFrame:
    """The ``k`` most frequent colours of each clip's pixels (``clip, r, g, b``) on a coarse grid, with their weight."""
    grid = lambda c: (F.floor(F.col(c) / step) * step + step // 2).cast("int")
    counts = pixels.groupBy(key, grid("r").alias("r"), grid("g").alias("g"), grid("b").alias("b")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key)
    ranked = counts.withColumns({"weight": F.round(F.col("n") / F.sum("n").over(order), 4), "rank": F.row_number().over(order.orderBy(F.desc("n"), "r", "g", "b"))})
    return ranked.filter(F.col("rank") <= k).select(key, "rank", F.format_string("#%02x%02x%02x", "r", "g", "b").alias("colour"), "weight")


def loudness(samples: DataFrame, key: str = "clip") -> DataFrame:
    """Root mean square of each clip's samples (-1 to 1)."""
    return samples.groupBy(key).agg(F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("rms"))


def colour_report(pixels: DataFrame, k: int = 6, key: str = "clip") -> DataFrame:
    """The colours of each clip in one row: its statistics and ``palette``, the ``k`` most frequent colours with their share, as text.

    Shares have three digits; a palette has ``k`` entries at most, so nothing unbounded meets in a row.
    """
    entry = F.concat("colour", F.lit(":"), F.round("weight", 3).cast("string"))
    colours = palette(pixels, k, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), " ").alias("palette"))
    return colour_statistics(pixels, key).join(colours, key)
