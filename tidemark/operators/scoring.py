"""Scoring: forecast calibration, benchmark cards, transcript error matrices, conformance tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import web
from tidemark.sources.storage import cut

from . import evidence, ledger

# Answers that abstain, and kinds of answers that are numbers.
ABSTAIN = ("", "abstain", "n/a", "none", "unknown", "모름", "확인불가")
NUMERIC = ("api-number", "count", "on-screen-price")


def of_last(predictions: DataFrame) -> DataFrame:
    """The last row of each prediction, where they have an order; a repeated id is one prediction."""
    return ledger.latest(predictions, ["prediction_id"]) if "seq" in predictions.columns else predictions


def resolved(predictions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Predictions whose latest resolution is a hit or a miss: ``prediction_id, p, y, anchored, premature``."""
    predictions = of_last(predictions)
    last = ledger.latest(resolutions.select("prediction_id", "seq", "outcome", "anchored", "ts"), ["prediction_id"])
    met = predictions.join(last.filter("outcome IN ('hit', 'miss')"), "prediction_id")
    return met.select("prediction_id", F.col("stated_confidence").alias("p"), (F.col("outcome") == "hit").cast("double").alias("y"), "anchored", (F.col("ts") <= F.col("created")).alias("premature"))


def calibration(predictions: DataFrame, resolutions: DataFrame, like: evidence.Alike | None = None) -> DataFrame:
    """One row of totals, resolution rate, Brier scores over all and over anchored resolutions, and the greatest gap of a bucket.

    A repeated id is one forecast, as its last row has it.  Resolutions at or before the forecast count, and are reported as premature.  Distinct forecasts are counted where
    these have their claim, deadline and hypothesis.
    """
    predictions = of_last(predictions)
    done = cut(resolved(predictions, resolutions))
    error = F.pow(F.col("p") - F.col("y"), 2)
    scored = done.agg(F.count("*").alias("n_resolved"), F.count_if("premature").alias("n_premature"), F.round(F.avg(error), 4).alias("brier_all"), F.round(F.avg(F.when(F.col("anchored"), error)), 4).alias("brier_anchored"))
    met = predictions.agg(F.count("*").alias("n_predictions")).join(scored, how="cross")
    rate = F.when(F.col("n_predictions") > 0, F.round(F.col("n_resolved") / F.col("n_predictions"), 3)).otherwise(0.0)
    if {"claim", "resolve_by", "hypothesis_id"} <= set(predictions.columns):
        distinct = evidence.prediction_counts(predictions, like=like).agg(F.coalesce(F.sum("distinct_predictions"), F.lit(0)).alias("n_distinct"))
    else:
        distinct = predictions.sparkSession.range(1).select(F.lit(None).cast("long").alias("n_distinct"))
    worst = _buckets(done, 5).agg(F.max("gap").alias("worst_bucket_gap"))
    met = met.join(distinct, how="cross").join(worst, how="cross")  # of one row each
    return met.withColumns({"resolution_rate": rate, "brier_divergence": F.round(F.col("brier_all") - F.col("brier_anchored"), 4)})


def blind(cards: DataFrame) -> DataFrame:
    """What is asked of whoever answers: ``task_id, question``."""
    return cards.select("task_id", "question")


def reliability(predictions: DataFrame, resolutions: DataFrame, buckets: int = 5) -> DataFrame:
    """Mean confidence against hit rate in equal buckets; a confidence of 1 lies in the last, empty ones are left out."""
    return _buckets(resolved(predictions, resolutions), buckets)


def _buckets(done: DataFrame, buckets: int) -> DataFrame:
    bucket = F.least((F.col("p") * buckets).cast("int"), F.lit(buckets - 1))
    means = done.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("mc"), F.avg("y").alias("hr"))
    return means.select("bucket", "n", F.round("mc", 3).alias("mean_confidence"), F.round("hr", 3).alias("hit_rate"), F.round(F.abs(F.col("mc") - F.col("hr")), 3).alias("gap"))


def capture_error(measured: DataFrame) -> DataFrame:
    """Error rates of transcripts (``truth, heard``) against their truth; a blank truth is refused (left out)."""
    return measured.filter(F.trim("truth") != "").withColumn("cer", tx.error_rate(F.col("truth"), F.col("heard")))


def abstains(answer: Column) -> Column:
    return tx.squeezed(F.coalesce(answer, F.lit(""))).isin(*ABSTAIN)


def _word_in(gold: Column, answer: Column) -> Column:
    g, a = tx.squeezed(gold), tx.squeezed(answer)
    quoted = F.regexp_replace(g, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    bounded = F.concat(F.lit(r"(?<!\w)"), quoted, F.lit(r"(?!\w)"))
    return (g != "") & F.when(g.rlike(r"^[\x00-\x7F]+$"), F.regexp_like(a, bounded)).otherwise(a.contains(g))


def judged_cards(cards: DataFrame, results: DataFrame, today: str) -> DataFrame:
    """Valid cards with what came of them: ``answered, expired, passed``.

    A poison card passes by an explicit abstention; a numeric one within its tolerance; else the gold must
    stand in the answer, as words where it is ASCII.
    """
    valid = cards.filter((F.coalesce("task_id", F.lit("")) != "") & (F.coalesce("answer_kind", F.lit("")) != "") & F.col("gold_value").isNotNull())
    met = valid.join(results.select("task_id", "answer", F.lit(True).alias("_r")), "task_id", "left").withColumn("answered", F.coalesce("_r", F.lit(False))).drop("_r")
    age = F.date_diff(F.lit(today).cast("date"), web.date_of(F.col("captured_at")))
    expired = F.coalesce(age > F.floor(F.col("ttl_days").try_cast("double")), F.lit(False))
    near = F.abs(tx.first_number(F.col("answer")) - tx.first_number(F.col("gold_value"))) <= F.coalesce("tolerance", F.lit(0.0))
    silent = ~F.col("answered") | abstains(F.col("answer"))
    passed = F.when(F.coalesce("poison", F.lit(False)), F.col("answered") & abstains(F.col("answer"))).when(silent, False).when(F.col("answer_kind").isin(*NUMERIC), F.coalesce(near, F.lit(False))).otherwise(F.coalesce(_word_in(F.col("gold_value"), F.col("answer")), F.lit(False)))
    return met.withColumns({"expired": expired, "passed": passed})


def scorecard(cards: DataFrame, results: DataFrame, today: str) -> DataFrame:
    """One row of pass rates over live cards: all, stable, held out against the rest, and poison caught."""
    judged = judged_cards(cards, results, today)
    poison = F.coalesce("poison", F.lit(False))
    live = ~F.col("expired") & ~poison
    rate = lambda when: F.round(F.avg(F.when(when, F.col("passed").cast("double"))), 4)
    stable, held = F.coalesce("stable", F.lit(False)), F.coalesce("holdout", F.lit(False))
    out = judged.agg(
        F.count("*").alias("n_valid"), F.count_if("answered").alias("n_scored"), F.count_if("expired").alias("n_expired"), F.count_if(live).alias("n_live"), rate(live).alias("pass_rate"), rate(live & stable).alias("stable_pass_rate"),
        rate(live & ~held).alias("dev_rate"), rate(live & held).alias("holdout_rate"), rate(poison & ~F.col("expired")).alias("poison_caught_rate"),
    )
    return cards.agg(F.count("*").alias("n_cards")).join(out, how="cross").withColumn("holdout_gap", F.round(F.col("dev_rate") - F.col("holdout_rate"), 4))


def rates_by_kind(cards: DataFrame, results: DataFrame, today: str) -> DataFrame:
    """Pass rate of live cards by kind of answer."""
    live = judged_cards(cards, results, today).filter(~F.col("expired") & ~F.coalesce("poison", F.lit(False)))
    return live.groupBy("answer_kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


def _as_many(side: DataFrame) -> DataFrame:
    """A side of a join that has a row for each clip or more: what is estimated from small files is no reason to broadcast it."""
    return side.hint("merge")


def error_matrix(transcripts: DataFrame, reference: str) -> DataFrame:
    """Error rate of every model's transcript of a clip against the reference model's: ``clip, model, cer``; null for an empty reference."""
    key = transcripts.select("clip", "model", tx.spoken_key(F.col("text")).alias("t"))
    ref = _as_many(key.filter(F.col("model") == reference).select("clip", F.col("t").alias("r")))
    cer = F.when(F.length("r") > 0, F.round(F.levenshtein("r", "t") / F.length("r"), 3))
    return key.filter(F.col("model") != reference).join(ref, "clip").select("clip", "model", cer.alias("cer"))


def bench_grid(transcripts: DataFrame, sources: list[str], models: list[str]) -> DataFrame:
    """Every clip with every declared source and model: ``clip, source, model, text``, null where a run gave nothing.

    ``transcripts`` has (clip, source, model, text), one row a run; sources and models are short lists.
    """
    each = F.explode(F.array(*map(F.lit, sources))).alias("source")
    cells = transcripts.select("clip").distinct().select("clip", each).select("clip", "source", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return cells.join(_as_many(transcripts.select("clip", "source", "model", "text")), ["clip", "source", "model"], "left")


def bench_matrix(grid: DataFrame, reference: str, raw: str = "raw") -> DataFrame:
    """Error rates of each run against the reference model's transcript of the raw source and of its own: adds ``cer_raw, cer_same``.

    The reference is held against itself too.  A rate is null where the run or its reference has no text.
    """
    refs = grid.filter((F.col("model") == reference) & (F.coalesce("text", F.lit("")) != "")).select("clip", F.col("source").alias("_s"), F.col("text").alias("_t"))
    of_raw, same = refs.filter(F.col("_s") == raw).select("clip", F.col("_t").alias("_raw")), refs.select("clip", F.col("_s").alias("source"), F.col("_t").alias("_same"))
    met = grid.join(_as_many(of_raw), "clip", "left").join(_as_many(same), ["clip", "source"], "left")

    def rate(ref: str) -> Column:
        r, t = tx.spoken_key(F.col(ref)), tx.spoken_key(F.col("text"))
        return F.when(F.length(r) > 0, F.round(F.levenshtein(r, t) / F.length(r), 3))

    return met.select("clip", "source", "model", "text", rate("_raw").alias("cer_raw"), rate("_same").alias("cer_same"))


def bench_report(matrix: DataFrame) -> DataFrame:
    """The matrix as a document of tables, ``clip, source, part, model, line``, to be written in the order of the first four.

    A heading for each clip and source, a row for each model, and below the table what each has heard, by its first 300
    characters.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = lambda part, model, text: F.struct(F.lit(part).alias("part"), model.alias("model"), text.alias("line"))
    each = lambda df, source, *lines: df.select("clip", source.alias("source"), F.explode(F.array(*lines)).alias("l")).select("clip", "source", "l.*")
    none = F.lit("")
    heads = each(matrix.select("clip").distinct(), none, line(0, none, F.concat(F.lit("## "), F.col("clip").cast("string"))))
    titles = [F.concat(F.lit("### source = "), "source"), F.lit("| model | CER_raw | CER_same |"), F.lit("|---|---|---|")]
    tables = each(matrix.select("clip", "source").distinct(), F.col("source"), *[line(i + 1, none, x) for i, x in enumerate(titles)])
    cells = F.when(F.col("text").isNull(), F.concat(F.lit("| "), "model", F.lit(" | ERROR ||"))).otherwise(F.concat(F.lit("| "), "model", F.lit(" | "), shown("cer_raw"), F.lit(" | "), shown("cer_same"), F.lit(" |")))
    said = F.concat(F.lit("- **"), "model", F.lit("**: "), F.substring("text", 1, 300))
    # The rows of the matrix give both of their lines in one pass.
    rows = each(matrix, F.col("source"), line(4, F.col("model"), cells), line(5, F.col("model"), F.when(F.col("text").isNotNull(), said)))
    return heads.unionByName(tables).unionByName(rows.filter("part = 4 OR line IS NOT NULL"))


def mismatch_report(expected: DataFrame, actual: DataFrame, key: str, group: str) -> DataFrame:
    """A line for each scenario whose ``expected`` and ``actual`` differ: ``key, line``; one without a result is an error."""
    met = expected.join(actual.withColumn("_r", F.lit(True)), key, "left").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    status = F.when(F.col("_r").isNull(), "ERROR").otherwise("FAIL")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return met.select(key, F.concat(F.lit("["), status, F.lit(" "), text(group), F.lit("] "), text(key), F.lit(": expected "), text("expected"), F.lit(", got "), text("actual")).alias("line"))


def agreement_study(pairs: DataFrame) -> DataFrame:
    """Percent agreement of two transcripts (``a, b``) of each clip."""
    return pairs.withColumn("agreement", F.round(tx.agreement(tx.spoken_key(F.col("a")), tx.spoken_key(F.col("b"))), 1))


def conformance(expected: DataFrame, actual: DataFrame, key: str, group: str) -> DataFrame:
    """Tally of scenarios whose ``expected`` and ``actual`` columns agree, nulls too, by ``group``."""
    met = expected.join(actual, key, "left").withColumn("same", F.col("expected").eqNullSafe(F.col("actual")))
    return met.groupBy(group).agg(F.count("*").alias("n"), F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"))


def prediction_duplicates(predictions: DataFrame, least: float = tx.NEAR, like: evidence.Alike | None = None) -> DataFrame:
    """Predictions with the first earlier near copy of the same deadline and hypothesis, null if none."""
    names = predictions.withColumn("_h", F.coalesce(F.col("hypothesis_id").cast("string"), F.lit("")))
    earlier = evidence.first_earlier(names, ["_h", "resolve_by"], "seq", "claim", least, like).withColumnRenamed("first", "_first")
    found = predictions.select(F.col("seq").alias("_first"), F.col("prediction_id").alias("near_duplicate_of"))
    return predictions.select("seq", "prediction_id").join(earlier, "seq", "left").join(found, "_first", "left").select("seq", "prediction_id", "near_duplicate_of")
