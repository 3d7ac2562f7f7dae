"""Gates over logs and registries: evidence shapes, harvest of gaps, freshness, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import web

from .producers import run_stamp

# How much evidence of which shapes a declared stake asks for.
BUDGETS = {
    "low": {"least": 12, "most": 20, "required": ("unstructured",), "per_shape": 3},
    "med": {"least": 30, "most": 50, "required": ("semi-structured", "structured", "unstructured"), "per_shape": 3},
    "high": {"least": 50, "most": 100, "required": ("ocr", "semi-structured", "structured", "unstructured", "video"), "per_shape": 5},
}
STAKES = ("low", "med", "high")
# What a record's status may be, those that say it isn't verified, and those of ill health.
STATUSES = ("announced", "dead", "degraded", "effective", "observed", "partially-verified", "unverified")
UNVERIFIED, UNHEALTHY = ("partially-verified", "unverified"), ("dead", "degraded")


def shape_counts(findings: DataFrame, artifacts: DataFrame, run: str = "run") -> DataFrame:
    """Findings of each run by shape of their artifact; those without one under ``dangling``."""
    known = artifacts.select("artifact_id", web.shape(F.col("type"), F.col("source")).alias("shape"))
    return findings.join(known, "artifact_id", "left").groupBy(run, F.coalesce("shape", F.lit("dangling")).alias("shape")).agg(F.count("*").alias("n"))


def declared_stakes(hypotheses: DataFrame, run: str = "run") -> DataFrame:
    """The highest stakes that any hypothesis of a run declares in its latest row; blank counts as low."""
    last = hypotheses.groupBy(run, "hypothesis_id").agg(F.max_by("stakes", "seq").alias("stakes"))
    rank = F.when(F.col("stakes") == "high", 2).when(F.col("stakes") == "med", 1).otherwise(0)
    return last.groupBy(run).agg(F.max(rank).alias("r")).select(run, F.element_at(F.array(*map(F.lit, STAKES)), F.col("r") + 1).alias("stakes"))


def shape_budget(findings: DataFrame, artifacts: DataFrame, hypotheses: DataFrame, run: str = "run") -> DataFrame:
    """Whether each run's evidence meets the budget of its stakes: ``run, stakes, total, issues, passed``."""
    counts = shape_counts(findings, artifacts, run)
    shapes = sorted({s for b in BUDGETS.values() for s in b["required"]})
    flat = counts.groupBy(run).agg(
        F.sum(F.when(F.col("shape") != "dangling", F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("shape") == "dangling", F.col("n")).otherwise(0)).alias("dangling"),
        *[F.sum(F.when(F.col("shape") == s, F.col("n")).otherwise(0)).alias(s) for s in shapes],
    )
    met = flat.join(declared_stakes(hypotheses, run), run, "left")
    stakes = F.coalesce("stakes", F.lit("low"))

    def issue(name: str, of: Column, bar: int) -> Column:
        return F.when(of < bar, F.concat(F.lit(f"{name}("), of.cast("string"), F.lit(f"<{bar})")))

    def of_budget(b: dict) -> Column:
        return F.array_compact(F.array(issue("total-candidates", F.col("total"), b["least"]), *[issue(s, F.col(s), b["per_shape"]) for s in b["required"]]))

    of = F.when(stakes == "high", of_budget(BUDGETS["high"])).when(stakes == "med", of_budget(BUDGETS["med"])).otherwise(of_budget(BUDGETS["low"]))
    issues = F.concat(
        F.array_compact(F.array(F.when(F.col("stakes").isNull(), F.lit("stakes-undeclared")), F.when(F.col("dangling") > 0, F.concat(F.lit("dangling-findings("), F.col("dangling").cast("string"), F.lit(")"))))), of
    )
    return met.select(run, stakes.alias("stakes"), "total", F.array_join(issues, ";").alias("issues"), (F.size(issues) == 0).alias("passed"))


def harvest(findings: DataFrame, artifacts: DataFrame, label: str = "CORRECTED", run: str = "run") -> DataFrame:
    """A profile of each run: findings, corrections, modalities used, and the known ones that are missing.

    The modality ``other`` is no gap and fills none.
    """
    known = artifacts.select("artifact_id", web.modality(F.col("type")).alias("modality"))
    used = findings.join(known, "artifact_id", "left").groupBy(run).agg(
        F.count("*").alias("findings"), F.count_if(F.col("label") == label).alias("corrections"), F.array_sort(F.collect_set(F.when(F.col("modality") != "other", F.col("modality")))).alias("used")
    )
    every = F.array(*[F.lit(m) for m in sorted(web.MODALITIES)])
    return used.select(run, "findings", "corrections", F.array_join("used", ",").alias("used"), F.array_join(F.array_except(every, "used"), ",").alias("gaps"))


def harvest_runs(runs: DataFrame, findings: DataFrame, artifacts: DataFrame, hypotheses: DataFrame, predictions: DataFrame) -> DataFrame:
    """A profile of each run (``run, created, summary``) that has hypotheses: its label, counts, and what it lacks or corrected.

    Columns: ``run, created, label, findings, n_modalities, n_hosts, has_prediction, has_disconfirm, gaps, corrections``.
    Gaps are those of unfinished runs, corrections those of finished ones.
    """
    known = artifacts.select("artifact_id", web.modality(F.col("type")).alias("modality"), web.registrable(F.col("source")).alias("host"))
    met = findings.join(known, "artifact_id", "left")
    facts = met.groupBy("run").agg(
        F.count("*").alias("findings"), F.count_distinct(F.when(F.col("modality") != "other", F.col("modality"))).alias("n_modalities"), F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("n_hosts"),
        F.bool_or(F.coalesce(F.col("polarity") == "disconfirms", F.lit(False))).alias("has_disconfirm"), F.count_distinct(F.coalesce("modality", F.lit("other"))).alias("_all"),
    )
    made = runs.join(hypotheses.select("run").distinct(), "run", "left_semi").join(facts, "run", "left").join(predictions.select("run").distinct().withColumn("has_prediction", F.lit(True)), "run", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("findings", "n_modalities", "n_hosts", "_all")}
    made = made.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("has_prediction", "has_disconfirm")}).withColumn("label", run_stamp(F.coalesce("summary", F.lit(""))))
    alpha, recon = F.col("label") == "ALPHA", F.col("label") == "RECON"
    gaps = F.array_compact(F.array(
        F.when(recon & (F.col("n_modalities") <= 1), "single-modality"), F.when(recon & ~F.col("has_prediction"), "no-prediction"), F.when(recon & ~F.col("has_disconfirm"), "no-disconfirm"), F.when(recon & (F.col("n_hosts") < 3), "thin-hosts"),
    ))
    corrections = F.array_compact(F.array(
        F.when(alpha & (F.col("n_modalities") >= 2) & (F.col("_all") >= 2), "modality-expansion"), F.when(alpha & F.col("has_disconfirm"), "disconfirm-added"), F.when(alpha & (F.col("n_hosts") >= 3), "host-diversification"),
    ))
    return made.select("run", "created", "label", "findings", "n_modalities", "n_hosts", "has_prediction", "has_disconfirm", gaps.alias("gaps"), corrections.alias("corrections"))


def harvest_counts(profiles: DataFrame) -> DataFrame:
    """How many runs have each label, gap and correction: ``what, name, n``."""
    labels = profiles.groupBy(F.lit("label").alias("what"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    each = [profiles.select(F.explode(c).alias("name")).groupBy(F.lit(c).alias("what"), "name").agg(F.count("*").alias("n")) for c in ("gaps", "corrections")]
    return labels.unionByName(each[0]).unionByName(each[1])


def run_theses(hypotheses: DataFrame, run: str = "run") -> DataFrame:
    """What a run is about: the thesis (its first 100 characters) and stakes of its last hypothesis row."""
    last = hypotheses.groupBy(run).agg(F.max_by(F.struct("thesis", "stakes"), "seq").alias("h"))
    return last.select(run, F.substring(F.coalesce("h.thesis", F.lit("")), 1, 100).alias("thesis"), F.coalesce("h.stakes", F.lit("")).alias("stakes"))


#: What a correction is said to have come to.
EFFECTS = {"modality-expansion": "reached ALPHA", "disconfirm-added": "adversarial pass completed"}


def correction_parts(profiles: DataFrame, findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What the corrections of finished runs consist of, a row for each part: ``run, type, part, place, value``.

    An expansion of modalities has the modality that most findings are of (``from``) and the ``added`` ones; a
    disconfirming pass its ``source`` hosts, in log order; more hosts the first five by findings (``host``) and their
    ``count``; the first two an ``effect``.  Equally frequent ones come in the order they were first seen.  Nothing is
    gathered into lists, so a run with any number of sources is dealt over tasks.
    """
    runs = profiles.select("run", "n_hosts", F.explode("corrections").alias("type"))
    of = lambda t: runs.filter(F.col("type") == t).select("run", "type")
    known = artifacts.select("artifact_id", web.modality(F.col("type")).alias("modality"), web.registrable(F.col("source")).alias("host"))
    met = findings.join(known, "artifact_id", "left").withColumn("modality", F.coalesce("modality", F.lit("other")))
    counts = met.groupBy("run", "modality").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), "s")) - 1  # a run has as many rows as there are modalities
    ranked = counts.withColumn("place", place).join(of("modality-expansion"), "run")
    row = lambda df, part, at, value: df.select("run", "type", part.alias("part"), at.cast("long").alias("place"), value.cast("string").alias("value"))
    expanded = row(ranked, F.when(F.col("place") == 0, "from").otherwise("added"), F.greatest("place", F.lit(1)), F.col("modality"))
    passes = met.filter("polarity = 'disconfirms' AND host != ''").join(of("disconfirm-added"), "run")
    hosts = top_hosts(findings, artifacts).join(of("host-diversification"), "run")
    total = runs.filter("type = 'host-diversification'")
    effect = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])
    told = runs.filter(F.col("type").isin(*EFFECTS))
    parts = [row(passes, F.lit("source"), F.col("seq"), F.col("host")), row(hosts, F.lit("host"), F.col("place"), F.col("host")), row(total, F.lit("count"), F.lit(1), F.col("n_hosts")), row(told, F.lit("effect"), F.lit(1), effect[F.col("type")])]
    for part in parts:
        expanded = expanded.unionByName(part)
    return expanded


def first_corrections(profiles: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` corrections by run and their order in it, with their effect: ``run, place, type, effect``."""
    effect = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])
    each = profiles.select("run", F.posexplode("corrections").alias("place", "type"))
    return each.select("run", (F.col("place") + 1).alias("place"), "type", F.coalesce(effect[F.col("type")], F.lit("")).alias("effect")).orderBy("run", "place").limit(k)


def top_hosts(findings: DataFrame, artifacts: DataFrame, k: int = 5, run: str = "run") -> DataFrame:
    """The ``k`` hosts that most findings of a run come from, first seen first among equals: ``run, place, host, n``."""
    known = artifacts.select("artifact_id", web.registrable(F.col("source")).alias("host"))
    counts = findings.join(known, "artifact_id").filter("host != ''").groupBy(run, "host").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    order = Window.partitionBy(run).orderBy(F.desc("n"), "_first")
    return counts.select(run, F.row_number().over(order).alias("place"), "host", "n").filter(F.col("place") <= k)


def created(runs: DataFrame, rows: DataFrame, run: str = "run") -> DataFrame:
    """When each run began: its own ``created``, else the earliest time of its rows, else empty."""
    earliest = rows.groupBy(run).agg(F.min("ts").alias("_first"))
    return runs.join(earliest, run, "left").withColumn("created", F.coalesce(F.nullif(F.col("created"), F.lit("")), "_first", F.lit(""))).drop("_first")


def since(runs: DataFrame, day: str) -> DataFrame:
    """Runs of a day (YYYY-MM-DD) or later by the text of their date; undated ones stay."""
    return runs.filter((F.col("created") == "") | (F.substring("created", 1, 10) >= day))


def freshness(facts: DataFrame, today: str) -> DataFrame:
    """The state of each fact: corrupt, pending, unverified, stale or fresh, with its age in days."""
    day = F.lit(today).cast("date")
    age = F.date_diff(day, web.strict_date(F.col("observed_at")))
    state = (
        F.when(age < 0, "corrupt").when(web.strict_date(F.col("effective_at")) > day, "pending").when(F.col("status").isin(*UNVERIFIED), "unverified")
        .when(age >= F.col("ttl_days"), "stale").otherwise("fresh")
    )
    return facts.select("id", age.alias("age_days"), state.alias("freshness"), "status")


def registry_warnings(facts: DataFrame, today: str) -> DataFrame:
    """Facts not to be relied on: those that aren't fresh, and fresh ones of ill health."""
    judged = freshness(facts, today)
    return judged.filter((F.col("freshness") != "fresh") | F.col("status").isin(*UNHEALTHY)).select("id", F.when(F.col("freshness") != "fresh", F.col("freshness")).otherwise(F.col("status")).alias("warning"))


def registry_check(facts: DataFrame, today: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """All warnings of a registry, ``ord, id, warning``: what is amiss with invalid records, and valid ones not to be relied on."""
    judged = valid_facts(facts, statuses)
    broken = judged.filter("issue IS NOT NULL").select("ord", "id", F.col("issue").alias("warning"))
    valid = judged.filter("issue IS NULL").drop("issue")
    return broken.unionByName(registry_warnings(valid, today).join(valid.select("id", "ord"), "id").select("ord", "id", "warning"))


def valid_facts(facts: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Each record with its first ``issue`` (null if valid); of repeated ids the first by ``ord`` counts, valid or not.

    Dates must be whole texts.  Source references and scope are looked at where the registry has them.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    firsts = facts.filter(~blank("id")).groupBy("id").agg(F.min("ord").alias("_first"))
    judged = facts.join(firsts, "id", "left")
    issue = F.when(blank("id"), "id missing").when(F.col("ord") > F.col("_first"), "duplicate id").when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "status unknown").when(blank("claim"), "claim missing")
    if "source_refs" in facts.columns:
        none = F.col("source_refs").isNull() | (F.size("source_refs") == 0)
        issue = issue.when(none, "source_refs empty").when(F.exists("source_refs", lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), "source_refs blank")
    if "scope" in facts.columns:
        issue = issue.when(blank("scope"), "scope missing")
    day = web.strict_date
    issue = issue.when(day(F.col("observed_at")).isNull(), "observed_at invalid").when((F.coalesce("effective_at", F.lit("")) != "") & day(F.col("effective_at")).isNull(), "effective_at invalid").when(F.coalesce(F.col("ttl_days") <= 0, F.lit(True)), "ttl_days invalid")
    return judged.withColumn("issue", issue).drop("_first")


#: Fixed value: the mark of a date that was written without looking at what it stands for.
UNLOOKED = "date-stamp-unverified"
_BLOCK = r"\A---\s*\n([\s\S]*?)\n---"


def front_matter(content: Column, field: str) -> Column:
    """A field of a document's front matter, trimmed; of repeated ones the last, empty if there is none.  Indented lines are no fields."""
    lines = F.filter(F.split(F.regexp_extract(F.coalesce(content, F.lit("")), _BLOCK, 1), "\n"), lambda x: x.contains(":") & ~x.startswith(" ") & (F.trim(F.split(x, ":", 2)[0]) == field))
    return F.coalesce(F.regexp_replace(F.split(F.try_element_at(lines, F.lit(-1)), ":", 2)[1], r"^\s+|\s+$", ""), F.lit(""))


def skill_staleness(files: DataFrame, today: str, ttl_days: int = 30) -> DataFrame:
    """State of documents by their front matter (``path, content``): ``path, name, age_days, state``.

    ``missing`` without a ``last_verified``; ``invalid-date`` if it is no whole date, which may stand in quotes; ``stale`` from
    ``ttl_days`` on; ``stamped-unverified`` where ``verified_by`` says that only the date was written; else ``fresh``, dates
    ahead too.
    """
    bare = lambda c: F.regexp_replace(c, r"""^['"]+|['"]+$""", "")
    stamp, by = front_matter(F.col("content"), "last_verified"), front_matter(F.col("content"), "verified_by")
    day = F.when(bare(stamp).rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), web.strict_date(bare(stamp)))
    age = F.date_diff(F.lit(today).cast("date"), day)
    state = F.when(stamp == "", "missing").when(age.isNull(), "invalid-date").when(age >= ttl_days, "stale").when(bare(by) == UNLOOKED, "stamped-unverified").otherwise("fresh")
    return files.select("path", bare(front_matter(F.col("content"), "name")).alias("name"), age.alias("age_days"), state.alias("state"))


def staleness_gate(states: DataFrame, strict: bool = False) -> DataFrame:
    """Whether all documents pass, one row: ``passed, checked`` and how many are in each state.

    With ``strict`` those whose date was written without a look at them fail too.
    """
    every = ("fresh", "stale", "missing", "invalid-date", "stamped-unverified")
    failing = every[1:] if strict else every[1:4]
    return states.agg((F.count_if(F.col("state").isin(*failing)) == 0).alias("passed"), F.count("*").alias("checked"), *[F.count_if(F.col("state") == x).alias(x.replace("-", "_")) for x in every])


def restamped(files: DataFrame, today: str, ttl_days: int = 30) -> DataFrame:
    """All documents, those that are stale, undated or dated wrongly with today's date and the mark of a date only; ``fixed`` says which.

    A document without front matter is given one.
    """
    judged = skill_staleness(files.select("path", "content"), today, ttl_days).select("path", F.col("state").isin("stale", "missing", "invalid-date").alias("fixed"))
    met = files.join(judged, "path")
    dated = with_field(with_field(met, "last_verified", F.lit(today)), "verified_by", F.lit(UNLOOKED))
    none = F.regexp_extract("content", _BLOCK, 0) == ""
    head = F.concat(F.lit(f"---\nlast_verified: {today}\nverified_by: {UNLOOKED}\n---\n\n"), F.coalesce("content", F.lit("")))
    # with_field works on its column, so both forms are made before one is chosen.
    both = dated.withColumnRenamed("content", "_d").join(met.select("path", "content"), "path")
    return both.withColumn("content", F.when(~F.col("fixed"), F.col("content")).when(F.coalesce(none, F.lit(True)), head).otherwise(F.col("_d"))).drop("_d")


def with_field(files: DataFrame, field: str, value: Column) -> DataFrame:
    """Documents with a front-matter field set: replaced where it stands, else added at the block's end."""
    line = F.concat(F.lit(f"{field}: "), value)
    block = r"\A(---\s*\n[\s\S]*?)(\n---)"
    has = F.regexp_extract("content", r"\A---\s*\n([\s\S]*?)\n---", 1).rlike(rf"(?m)^{field}:")
    replaced = F.regexp_replace("content", F.lit(rf"(?m)\A(---\s*\n(?:.*\n)*?){field}:.*$"), F.concat(F.lit("$1"), line))
    added = F.regexp_replace("content", F.lit(block), F.concat(F.lit("$1\n"), line, F.lit("$2")))
    return files.withColumn("content", F.when(has, replaced).otherwise(added))


def drift(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """What a mirror of files lacks or has besides: ``path, action`` (write, prune, same) by content hash."""
    a, b = source.select("path", F.md5("content").alias("ours")), mirror.select("path", F.md5("content").alias("theirs"))
    action = F.when(F.col("ours").isNull(), "prune").when(F.col("theirs").isNull() | (F.col("ours") != F.col("theirs")), "write").otherwise("same")
    return a.join(b, "path", "full").select("path", action.alias("action"))
