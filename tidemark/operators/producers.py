"""What writers of event logs do: check rows before they are appended, derive ids, keep lists, take snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import web

from .ledger import stable_id

# Closed vocabularies.
OPERATIONS = ("open", "close", "visit", "note")
POLARITIES, STAKES, MODES, OUTCOMES, KINDS = ("confirms", "disconfirms", "neutral", ""), ("", "low", "med", "high"), ("discover", "debunk"), ("hit", "miss", "unresolved"), ("video", "channel")
DOMAINS = ("breadth", "recency", "consistency", "traceability", "source_type", "modality")
ARITHMETIC = ("breadth", "recency", "consistency")


def finding_violations(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Why findings may not be appended: ``seq, violation``; an unknown artifact, corroborator or polarity."""
    known = artifacts.select("artifact_id").distinct()
    loose = findings.join(known, "artifact_id", "left_anti").select("seq", F.lit("unknown artifact").alias("violation"))
    others = findings.select("seq", F.explode("corroborated_by").alias("artifact_id")).join(known, "artifact_id", "left_anti").select("seq", F.lit("unknown corroborator").alias("violation")).distinct()
    odd = findings.filter(~F.coalesce("polarity", F.lit("")).isin(*POLARITIES)).select("seq", F.lit("unknown polarity").alias("violation"))
    return loose.unionByName(others).unionByName(odd)


def frontier_rows(events: DataFrame) -> DataFrame:
    """Events of a frontier (``item, op``) with their violation, null if fit to append: a blank item or an unknown operation."""
    bad = F.when(F.trim(F.coalesce("item", F.lit(""))) == "", "empty item").when(~F.coalesce("op", F.lit("")).isin(*OPERATIONS), "unknown operation")
    return events.withColumn("violation", bad)


def hypothesis_rows(theses: DataFrame) -> DataFrame:
    """Hypotheses (``thesis, stakes, mode``) with their id and first violation, null if fit to append."""
    bad = F.when(F.trim(F.coalesce("thesis", F.lit(""))) == "", "empty thesis").when(~F.coalesce("stakes", F.lit("")).isin(*STAKES), "unknown stakes").when(~F.coalesce("mode", F.lit("discover")).isin(*MODES), "unknown mode")
    return theses.withColumns({"hypothesis_id": stable_id("hyp_", F.coalesce("thesis", F.lit("")), 12), "violation": bad})


def research_rows(goals: DataFrame) -> DataFrame:
    """Research runs (``goal, seq``) with the slug that their goal gives them, each created once."""
    return goals.groupBy("goal").agg(F.min("seq").alias("seq")).withColumn("slug", stable_id("r_", F.col("goal"), 10))


def pubdate_violations(pubdates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Publication dates that may not be appended: ``seq, violation``; of an unknown artifact, or no date."""
    known = artifacts.select("artifact_id").distinct().withColumn("_k", F.lit(True))
    bad = F.when(F.col("_k").isNull(), "unknown artifact").when(web.date_of(F.col("published_at")).isNull(), "no date")
    return pubdates.join(known, "artifact_id", "left").select("seq", bad.alias("violation")).filter("violation IS NOT NULL")


def measure_violations(measured: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Measurements of captures that may not be appended: ``seq, violation``; a blank truth, or an unknown artifact."""
    known = artifacts.select("artifact_id").distinct().withColumn("_k", F.lit(True))
    bad = F.when(F.trim(F.coalesce("truth", F.lit(""))) == "", "truth empty").when(F.col("_k").isNull(), "unknown artifact")
    return measured.join(known, "artifact_id", "left").select("seq", bad.alias("violation")).filter("violation IS NOT NULL")


def prediction_violations(predictions: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Forecasts whose confidence is no probability, or whose deadline is no date, or (given ``artifacts``) whose anchor is unknown: ``prediction_id, violation``."""
    p = F.col("stated_confidence")
    bad = F.when(p.isNull() | ~p.between(0, 1), "confidence out of range").when(web.date_of(F.col("resolve_by")).isNull(), "deadline is no date")
    if artifacts is not None:
        known = artifacts.select(F.col("artifact_id").alias("anchor_artifact_id")).distinct().withColumn("_k", F.lit(True))
        predictions = predictions.join(known, "anchor_artifact_id", "left")
        bad = bad.when((F.coalesce("anchor_artifact_id", F.lit("")) != "") & F.col("_k").isNull(), "unknown anchor")
    return predictions.select("prediction_id", bad.alias("violation")).filter("violation IS NOT NULL")


def standard_warnings(standards: DataFrame) -> DataFrame:
    """Warnings on declared standards (``standard_id`` and a column for each knob): ``standard_id, warnings``.

    Lists may also come as JSON text, of which anything but a list is warned of.
    """
    hosts, sources, dup = F.col("min_distinct_hosts"), F.col("min_independent_sources"), F.col("dup_similarity")
    names = lambda xs: F.array(*[F.lit(x) for x in xs])

    def listed(c: str) -> tuple[Column, Column]:
        """A list, and whether it is something else."""
        if standards.schema[c].dataType.simpleString() != "string":
            return F.col(c), F.lit(False)
        made = F.from_json(F.when(F.col(c).rlike(r"^\s*\["), F.col(c)), "array<string>")
        return made, F.col(c).isNotNull() & made.isNull()

    (fatal, odd_fatal), (needed, odd_needed) = listed("fatal_domains"), listed("required_modalities")
    trivial = [d for d in DOMAINS if d not in ARITHMETIC]
    found = F.array_compact(F.array(
        F.when(hosts > sources, "volume_bar_incoherent"), F.when(odd_fatal, "fatal_domains_not_list"), F.when(F.size(F.array_except(fatal, names(DOMAINS))) > 0, "fatal_domains_unknown"),
        F.when(F.size(F.array_except(fatal, names(trivial))) == 0, "fatal_set_trivial"), F.when(~((dup > 0) & (dup <= 1)), "dup_similarity_range"),
        F.when(odd_needed | (F.size(F.array_except(needed, names(sorted(web.MODALITIES)))) > 0), "required_modalities_invalid"),
    ))
    return standards.select("standard_id", F.array_join(found, ",").alias("warnings"))


def resolution_rows(resolutions: DataFrame, predictions: DataFrame, findings: DataFrame) -> DataFrame:
    """Resolutions with ``anchored`` (their evidence has an observed finding) and their violation."""
    seen = findings.filter("label = 'OBSERVED'").select(F.col("artifact_id").alias("evidence_artifact")).distinct().withColumn("_o", F.lit(True))
    known = predictions.select("prediction_id").distinct().withColumn("_k", F.lit(True))
    met = resolutions.join(seen, "evidence_artifact", "left").join(known, "prediction_id", "left")
    bad = F.when(F.col("_k").isNull(), "unknown prediction").when(~F.coalesce("outcome", F.lit("")).isin(*OUTCOMES), "unknown outcome")
    return met.withColumns({"anchored": F.coalesce("_o", F.lit(False)), "violation": bad}).drop("_o", "_k")


def watch(items: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """A watch list (``ord, kind, id``) after additions, each id once as first added, and removals."""
    shift = items.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    fresh = added.join(items.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord")).join(shift, how="cross")
    every = items.select("ord", "kind", "id").unionByName(fresh.select((F.col("ord") + F.col("_last") + 1).alias("ord"), "kind", "id"))
    return every if removed is None else every.join(removed.select("id"), "id", "left_anti").select("ord", "kind", "id")


def snapshot_rows(watched: DataFrame, payload: DataFrame) -> DataFrame:
    """One row for each watched id: its statistics, or ``missing`` where the payload lacks it."""
    return watched.select("id").join(payload.withColumn("_p", F.lit(True)), "id", "left").withColumn("missing", F.col("_p").isNull()).drop("_p")


def chart_rows(payload: DataFrame) -> DataFrame:
    """Ranked rows of chart payloads (``region, at, items array``): rank is the place in the payload, from 1."""
    return payload.select("region", "at", F.posexplode("items").alias("p", "item")).select("region", "at", (F.col("p") + 1).alias("rank"), "item")


def video_id(text: Column) -> Column:
    """The eleven-character id in a video address, or the text itself if it is one; null otherwise."""
    found = F.regexp_extract(text, r"(?:v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(found != "", found).when(text.rlike(r"^[A-Za-z0-9_-]{11}$"), text)


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO duration such as PT1H2M3S."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0).cast("long"))
    return part("H") * 3600 + part("M") * 60 + part("S")


def scrubbed(text: Column, secret: Column) -> Column:
    """A message without a key."""
    return F.when(secret != "", F.replace(text, secret, F.lit("***"))).otherwise(text)


def run_stamp(summary: Column) -> Column:
    """The stamp of a run's summary: alpha before recon, else unlabelled; a stamp with reasons after a colon is none."""
    return F.when(F.contains(summary, F.lit("[ALPHA]")), "ALPHA").when(F.contains(summary, F.lit("[RECON]")), "RECON").otherwise("unlabeled")
