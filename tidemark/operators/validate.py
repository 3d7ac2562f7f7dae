"""Rule-driven validation of tables: one pass of aggregates for all fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("int", "float", "str")


def _number(text: Column, here: Column, kind: str) -> tuple[Column, Column, Column]:
    """The number that a cell's text is, whether it isn't finite, and the number if it is."""
    bare = F.trim(F.regexp_replace(text, ",", ""))
    number = bare.try_cast("double")
    number = F.when(here, F.when(bare.rlike(r"^[+-]?\d+$"), number) if kind == "int" else number)
    odd = F.isnan(number) | (F.abs(number) == float("inf"))
    return number, odd, F.when(~odd, number)


def samples(rows: DataFrame, rules: dict[str, dict], order: list[str], k: int = 3) -> DataFrame:
    """The first ``k`` values, in the order of some columns, of each issue that ``validate`` shows values of: ``field, issue, place, value``.

    These are values below the least, above the greatest, or that a rule rejects.  A row gives only the values that
    break a rule, and each task keeps the first few of them before the shuffle.
    """
    found = []
    for field, rule in rules.items():
        if not isinstance(rule, dict) or field not in rows.columns:
            continue
        raw = F.col(f"`{field}`")
        text = raw.cast("string")
        here = raw.isNotNull() & (F.trim(text) != "")
        broken = {}
        if rule.get("type") in ("int", "float"):
            fine = _number(text, here, rule["type"])[2]
            broken |= {issue: compare(fine, float(rule[bound])) for issue, bound, compare in (("below_min", "min", Column.__lt__), ("above_max", "max", Column.__gt__)) if rule.get(bound) is not None}
        if rule.get("reject_regex"):
            try:
                re.compile(rule["reject_regex"])
                broken["junk"] = here & text.rlike("(?i)" + rule["reject_regex"])
            except re.error:
                pass
        found += [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(issue).alias("issue"), text.alias("value"))) for issue, c in broken.items()]
    if not found:
        return rows.sparkSession.createDataFrame([], "field string, issue string, place int, value string")
    each = rows.select(F.struct(*order).alias("_o"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("_o", "f.*")
    place = F.row_number().over(Window.partitionBy("field", "issue").orderBy("_o", "value"))
    return each.withColumn("place", place).filter(F.col("place") <= k).select("field", "issue", "place", "value")


def validate(rows: DataFrame, rules: dict[str, dict], min_rows: int | None = None) -> DataFrame:
    """Issues of a table against per-field rules: ``field, issue, n``.

    A rule may hold type (int, float, str), required, max_empty_ratio, min, max, reject_regex, unique,
    allow_uniform, min_uniform_n.  Null and blank values are empty.  A bad rule is an issue of its own, never an
    error.  An empty table gives the one issue ``no_rows``.
    """
    aggs: list[Column] = [F.count("*").alias("n_rows")]
    plans: list[tuple[str, str, Column, Column]] = []  # field, issue, number, when
    for at, (field, rule) in enumerate(rules.items()):
        if not isinstance(rule, dict):
            plans.append((field, "bad_rule", F.lit(1).cast("long"), F.lit(True)))
            continue
        kind = rule.get("type")
        if kind is not None and kind not in TYPES:
            plans.append((field, "unknown_type", F.lit(1).cast("long"), F.lit(True)))
        raw = F.col(f"`{field}`") if field in rows.columns else F.lit(None).cast("string")
        text = raw.cast("string")
        here = raw.isNotNull() & (F.trim(text) != "")

        def add(name: str, agg: Column, at: int = at) -> Column:
            aggs.append(agg.alias(f"{name}_{at}"))
            return F.col(f"{name}_{at}")

        present = add("present", F.count_if(here))
        empty = F.col("n_rows") - present
        if "max_empty_ratio" in rule or rule.get("required"):
            plans.append((field, "empty_ratio", empty, empty > F.col("n_rows") * float(rule.get("max_empty_ratio", 0.0))))
        if kind in ("int", "float"):
            number, odd, fine = _number(text, here, kind)
            plans.append((field, "not_coercible", n := add("bad", F.count_if(here & number.isNull())), n > 0))
            plans.append((field, "non_finite", n := add("odd", F.count_if(F.coalesce(odd, F.lit(False)))), n > 0))
            if rule.get("min") is not None:
                plans.append((field, "below_min", n := add("low", F.count_if(fine < float(rule["min"]))), n > 0))
            if rule.get("max") is not None:
                plans.append((field, "above_max", n := add("high", F.count_if(fine > float(rule["max"]))), n > 0))
        elif kind == "str" and field in rows.columns and rows.schema[field].dataType.simpleString() != "string":
            plans.append((field, "not_str", present, present > 0))
        if rule.get("reject_regex"):
            try:
                re.compile(rule["reject_regex"])
                plans.append((field, "junk", n := add("junk", F.count_if(here & text.rlike("(?i)" + rule["reject_regex"]))), n > 0))
            except re.error:
                plans.append((field, "invalid_regex", F.lit(1).cast("long"), F.lit(True)))
        uniform = not rule.get("allow_uniform")
        if rule.get("unique"):
            distinct = add("distinct", F.count_distinct(F.when(here, text)))
            plans.append((field, "duplicates", present - distinct, present > distinct))
        if uniform:
            same = add("lowest", F.min(F.when(here, text))) == add("highest", F.max(F.when(here, text)))
            plans.append((field, "uniform", present, (present >= int(rule.get("min_uniform_n", 10))) & same))
    if min_rows is not None:
        plans.append(("_table", "min_rows", F.col("n_rows"), F.col("n_rows") < min_rows))
    measured = rows.agg(*aggs)
    filled = F.col("n_rows") > 0
    each = [F.when(F.coalesce(when, F.lit(False)) & filled, F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), n.cast("long").alias("n"))) for f, i, n, when in plans]
    none = F.when(~filled, F.struct(F.lit("_table").alias("field"), F.lit("no_rows").alias("issue"), F.lit(0).cast("long").alias("n")))
    return measured.select(F.explode(F.array_compact(F.array(none, *each))).alias("i")).select("i.*")
