"""Operators over append-only logs: first and latest rows, references, folds, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.sources.storage import cut

# Labels of captures that are none.
BAD_QUALITY = ("BOT_WALL", "JS_WALL", "LOGIN_WALL", "PAYWALL", "EMPTY", "HTTP_ERROR", "MALFORMED", "API_ERROR", "EXTRACT_FAILED", "COVERAGE_GAP", "LOW_CONFIDENCE", "DEGENERATE", "SILENT", "NO_SPEECH_OR_MASKED")


def latest(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key by log order.  A partial aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key by log order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def missing_from(known: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Insert-if-absent: the first new row of each key that is not known yet."""
    return first(new, keys, order).join(known.select(*keys), keys, "left_anti")


def stable_id(prefix: str, text: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def dangling(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows that refer to something unknown."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def frontier_state(events: DataFrame) -> DataFrame:
    """Fold open/close/visit events per item: ``item, is_open, is_closed, is_visited, opened_at, closed_at, visited_at``.

    An item is open if its last open or close is an open; one that was ever closed stays closed too.
    ``opened_at`` is the open that began its present stay, the other two are first occurrences.
    """
    at = lambda op: F.when(F.col("op") == op, F.col("seq"))
    closes = events.groupBy("item").agg(F.max(at("close")).alias("last_close"))
    met = events.join(closes, "item")
    since = F.when((F.col("op") == "open") & (F.col("last_close").isNull() | (F.col("seq") > F.col("last_close"))), F.col("seq"))
    folded = met.groupBy("item").agg(F.min(since).alias("opened_at"), F.min(at("close")).alias("closed_at"), F.min(at("visit")).alias("visited_at"))
    flags = [F.col(f"{c}_at").isNotNull().alias(f"is_{n}") for c, n in (("opened", "open"), ("closed", "closed"), ("visited", "visited"))]
    return folded.select("item", *flags, "opened_at", "closed_at", "visited_at")


def low_quality_citations(findings: DataFrame, artifacts: DataFrame, bad: tuple[str, ...] = BAD_QUALITY) -> DataFrame:
    """Findings that rest on a bad capture, with its label."""
    return findings.join(artifacts.filter(F.col("quality_label").isin(*bad)).select("artifact_id", "quality_label"), "artifact_id")


def fake_corroboration(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Findings said to be corroborated whose known sources lie on fewer than two hosts: ``seq, artifact_id, n_hosts``."""
    said = findings.filter(F.size("corroborated_by") > 0)
    cited = said.select("seq", "artifact_id", F.explode(F.array_union(F.array("artifact_id"), "corroborated_by")).alias("cited"))
    hosts = artifacts.select(F.col("artifact_id").alias("cited"), web.registrable(F.col("source")).alias("host"))
    counted = cited.join(hosts, "cited", "left").groupBy("seq", "artifact_id").agg(F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("n_hosts"))
    return counted.filter("n_hosts < 2")


def capture_errors(findings: DataFrame, measures: DataFrame) -> DataFrame:
    """Findings whose capture was measured, with the latest error rate of it."""
    return findings.join(latest(measures.select("artifact_id", F.col("seq").alias("_s"), "cer"), ["artifact_id"], "_s").select("artifact_id", "cer"), "artifact_id")


def integrity(artifacts: DataFrame, findings: DataFrame, present: DataFrame) -> DataFrame:
    """Counts of what breaks or weakens a log: one row.

    ``present`` has (artifact_id, actual_sha256) of the captures that can still be read.
    """
    met = artifacts.join(present, "artifact_id", "left")
    state = F.when(F.col("sha256").isNull() | F.col("actual_sha256").isNull(), "unverifiable").when(F.col("sha256") != F.col("actual_sha256"), "mismatch").otherwise("intact")
    hashes = met.agg(*[F.count_if(state == s).alias(s) for s in ("intact", "mismatch", "unverifiable")])
    loose = dangling(findings, artifacts, "artifact_id").agg(F.count("*").alias("dangling"))
    weak = low_quality_citations(findings, artifacts).agg(F.count("*").alias("low_quality"))
    fake = fake_corroboration(findings, artifacts).agg(F.count_distinct("artifact_id").alias("fake_corroborated"))
    report = hashes.join(loose, how="cross").join(weak, how="cross").join(fake, how="cross")
    return report.withColumn("ok", (F.col("mismatch") == 0) & (F.col("unverifiable") == 0) & (F.col("dangling") == 0))


def ingest(landed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Landed bodies (``seq, source, method, body, status``) as artifact rows, each logical key once.

    Types follow the source, JSON bodies under other types too; the label follows the body.
    """
    kind = web.detect_type(F.col("source"))
    structured = (kind == "json") | ((kind == "html") & F.col("body").rlike(r"^\s*[\[{]") & F.try_parse_json("body").isNotNull())
    label = F.when(structured, web.json_quality(F.col("body"), F.col("status"))).otherwise(web.web_quality(F.col("body"), F.col("status")))
    made = landed.select(
        "seq", F.concat_ws("|", "source", "method").alias("logical_key"), "source", "method", F.when(structured, "json").otherwise(kind).alias("type"), F.sha2("body", 256).alias("sha256"), label.alias("quality_label")
    ).withColumn("artifact_id", stable_id("a_", F.col("logical_key"), 16))
    return first(made, ["logical_key"]) if known is None else missing_from(known, made, ["logical_key"])


# What kind of evidence a type is to the seal; any other is structured data.
EVIDENCE_KINDS = {"html": "page_html", "image": "frame_screenshot", "ocr": "ocr_text", "transcript": "transcript_cue", "video": "transcript_cue"}
WARNING = " [WARN low-quality source]"


def seal_plan(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Ordered steps that would seal findings: a source is registered once, at its first finding, then anchored.

    The anchor is the quote, else the cue or frame of the ``locator``, else the text's beginning; what can't be sealed is
    in ``seal_skipped``.  Columns: ``seq, artifact_id, registers, anchor_kind, anchor, evidence_kind, claim``.
    """
    met = findings.join(artifacts.select("artifact_id", "source", "type", "quality_label"), "artifact_id").filter(F.col("source").rlike("^https?://"))
    firsts = met.groupBy("artifact_id").agg(F.min("seq").alias("first_seq"))
    said, at = F.coalesce(F.col("quote"), F.lit("")), F.coalesce(F.col("locator"), F.lit(""))
    kind = F.when(said != "", "text_span").when(at.rlike(r"^cue=\d+$"), "transcript_cue").when(at.startswith("frame="), "frame").otherwise("text_span")
    anchor = F.when(kind == "transcript_cue", F.substring(at, 5, 1 << 30)).when(kind == "frame", "0").when(said != "", said).otherwise(F.substring("text", 1, 120))
    of_type = F
    for name, evidence in EVIDENCE_KINDS.items():
        of_type = of_type.when(F.col("type") == name, evidence)
    evidence_kind = F.when(kind == "transcript_cue", "transcript_cue").when(kind == "frame", "frame_screenshot").otherwise(of_type.otherwise("structured_data"))
    claim = F.concat("text", F.when(F.col("quality_label").isin(*BAD_QUALITY), WARNING).otherwise(""))
    return met.join(firsts, "artifact_id").select("seq", "artifact_id", (F.col("seq") == F.col("first_seq")).alias("registers"), kind.alias("anchor_kind"), anchor.alias("anchor"), evidence_kind.alias("evidence_kind"), claim.alias("claim"))


def seal_skipped(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Findings that can't be sealed: ``seq, artifact_id, reason``; of unknown artifacts, or of sources that are no web addresses."""
    loose = dangling(findings, artifacts, "artifact_id").select("seq", "artifact_id", F.lit("dangling").alias("reason"))
    away = artifacts.filter(~F.coalesce(F.col("source").rlike("^https?://"), F.lit(False))).select("artifact_id")
    return loose.unionByName(findings.join(away, "artifact_id", "left_semi").select("seq", "artifact_id", F.lit("no_source_url").alias("reason")))


def audit(artifacts: DataFrame, findings: DataFrame, present: DataFrame, measures: DataFrame, frontier: DataFrame, conflicts: DataFrame, grades: DataFrame) -> DataFrame:
    """The whole report on a log, one row: ``integrity`` and what else is to be looked at.

    ``frontier`` is the folded state, ``conflicts`` the number of conflicting pairs of each conclusion, ``grades`` (seq, conclusion_id,
    standard_id, overall) all gradings, of which the last of each conclusion and standard counts.
    """
    bad = artifacts.filter(F.col("quality_label").isin(*BAD_QUALITY)).select("artifact_id")
    last = latest(grades.select("conclusion_id", "standard_id", "seq", "overall"), ["conclusion_id", "standard_id"])
    ungraded = findings.select("conclusion_id").filter("conclusion_id IS NOT NULL").distinct().join(grades.select("conclusion_id").distinct(), "conclusion_id", "left_anti")
    parts = [
        capture_errors(findings, measures).agg(F.count_distinct("artifact_id").alias("capture_errors")), conflicts.agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("numeric_conflicts")), frontier.agg(F.count_if("is_open").alias("open_at_stop")),
        findings.filter("hypothesis_id IS NOT NULL").join(bad, "artifact_id", "left_semi").agg(F.count_distinct("artifact_id").alias("signals_on_bad_capture")),
        last.agg(F.count("*").alias("graded"), F.count_if(F.col("overall") == "SHORTFALL").alias("shortfalls")), ungraded.agg(F.count("*").alias("ungraded_conclusions")),
    ]
    report = integrity(artifacts, findings, present)
    for part in parts:
        report = report.join(part, how="cross")  # of one row each
    return report


def digest_lines(artifacts: DataFrame, findings: DataFrame, frontier: DataFrame, hypotheses: DataFrame, predictions: DataFrame, calibration: DataFrame) -> DataFrame:
    """A report as rows ``section, ord, line``: evidence, findings by label, hypotheses with their verdict, predictions with their totals, open items.

    Findings are whole, theses shown by their first 90 characters, claims by their first 100.  ``hypotheses`` are judged ones with their ``thesis`` and triangulation, ``predictions`` have ``near_duplicate_of``, ``calibration`` is the one row of totals.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    seen = artifacts.select(F.lit("1-evidence").alias("section"), place("seq").alias("ord"), F.concat(F.lit("["), text("type"), F.lit("] "), text("source"), F.lit(" (gate="), text("quality_label"), F.lit(", sha="), F.substring(text("sha256"), 1, 12), F.lit(")")).alias("line"))
    found = findings.select(F.lit("2-findings"), F.concat_ws("|", "label", place("seq")), F.concat(F.lit("("), "label", F.lit(") "), F.coalesce("text", F.lit("")), F.lit(" <-"), text("artifact_id"), F.lit("@"), text("locator")))
    stamp = F.concat(F.when(F.col("warning") != "", F.concat(F.lit("[!"), "warning", F.lit("] "))).otherwise(""), F.lit("["), "label", F.when(F.col("reasons") != "", F.concat(F.lit(": "), "reasons")).otherwise(""), F.lit("]"))
    counts = [F.lit(" [confirm "), text("confirming"), F.lit(" (distinct "), text("confirming_claims"), F.lit(", hosts "), text("confirming_hosts"), F.lit(", modalities "), F.size("modalities").cast("string"), F.lit(") / disconfirm "), text("disconfirming"), F.lit(" / net "), text("net_hosts"), F.lit("] ")]
    bets = hypotheses.select(F.lit("3-hypotheses"), place("hypothesis_id"), F.concat(F.substring(F.coalesce("thesis", F.lit("")), 1, 90), *counts, stamp))
    totals = calibration.select(F.lit("4-predictions"), F.lit(""), F.concat(text("n_predictions"), F.lit(" made, "), text("n_distinct"), F.lit(" distinct, "), text("n_resolved"), F.lit(" resolved, "), text("n_premature"), F.lit(" premature, brier "), text("brier_all")))
    again = F.when(F.col("near_duplicate_of").isNotNull(), F.concat(F.lit(" (dup of "), text("near_duplicate_of"), F.lit(")"))).otherwise("")
    forecasts = predictions.select(F.lit("4-predictions"), place("seq"), F.concat(F.lit("(conf "), text("stated_confidence"), F.lit(", by "), text("resolve_by"), F.lit(") "), F.substring(F.coalesce("claim", F.lit("")), 1, 100), again))
    left = frontier.filter("is_open").select(F.lit("5-open"), place("opened_at"), F.col("item").cast("string"))
    return seen.union(found).union(bets).union(totals).union(forecasts).union(left)


# The headings of a digest's sections.
SECTIONS = {"1-evidence": "evidence", "2-findings": "findings", "3-hypotheses": "hypotheses", "4-predictions": "predictions", "5-open": "open"}


def digest_document(lines: DataFrame, goal: str) -> DataFrame:
    """The lines of a digest with its title and a heading for each section, which counts it: ``section, ord, line``, to be written in that order."""
    title = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    lines = cut(lines)  # counted and written, so made once
    entries = F.when(F.col("ord") != "", 1)
    headings = lines.groupBy("section").agg(F.count(entries).alias("n")).select("section", F.lit(" ").alias("ord"), F.concat(F.lit("## "), title[F.col("section")], F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    # A section's totals stand in the line without a place of its own, below the heading.
    body = lines.select("section", F.concat(F.lit("-"), "ord").alias("ord"), F.concat(F.lit("- "), F.regexp_replace("line", r"\s+", " ")).alias("line"))
    top = lines.sparkSession.range(1).select(F.lit("0-title").alias("section"), F.lit("").alias("ord"), F.lit(f"# RESEARCH DIGEST: {goal}").alias("line"))
    return top.union(headings).union(body)
