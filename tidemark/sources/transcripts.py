"""Timed transcripts: bracketed lines, WebVTT, SubRip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d+))?"
BRACKETED = rf"^\s*\[\s*{STAMP}\s*(?:-->|->|-|–)\s*{STAMP}\s*\]\s*(.*)$"
CUE = rf"{STAMP}\s*-->\s*{STAMP}"


def _seconds(of: Column, pattern: str, first: int) -> Column:
    part = lambda i: F.regexp_extract(of, pattern, first + i)
    number = lambda c: F.when(c == "", 0.0).otherwise(c.try_cast("double"))
    fraction = F.when(part(3) == "", 0.0).otherwise(F.concat(F.lit("0."), part(3)).try_cast("double"))
    return number(part(0)) * 3600 + number(part(1)) * 60 + number(part(2)) + fraction


def parse_timed(texts: DataFrame, key: str = "transcript_id", text: str = "content") -> DataFrame:
    """Segments of transcripts: ``key, idx, start, end, text``.

    A text with ``-->`` outside brackets is WebVTT or SubRip: blocks apart by blank lines, of which those with a
    time line and words are cues.  Any other is read line by line.
    """
    cues = F.col(text).contains("-->") & ~F.col(text).rlike(rf"(?m){BRACKETED}")
    lines = texts.filter(~cues).select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("idx", "line")).filter(F.col("line").rlike(BRACKETED))
    plain = lines.select(key, "idx", _seconds(F.col("line"), BRACKETED, 1).alias("start"), _seconds(F.col("line"), BRACKETED, 5).alias("end"), F.trim(F.regexp_extract("line", BRACKETED, 9)).alias("text"))
    blocks = texts.filter(cues).select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n\s*\n")).alias("idx", "block")).filter(F.col("block").rlike(CUE))
    words = F.trim(F.regexp_replace(F.regexp_extract("block", rf"(?s){CUE}[^\n]*\n?(.*)$", 9), r"\s*\n\s*", " "))
    cued = blocks.select(key, "idx", _seconds(F.col("block"), CUE, 1).alias("start"), _seconds(F.col("block"), CUE, 5).alias("end"), words.alias("text")).filter("text != ''")
    return plain.unionByName(cued)


def plain_text(texts: DataFrame, key: str = "transcript_id", text: str = "content") -> DataFrame:
    """The words of SubRip texts: ``key, text``; numbers and times go, and lines equal to the one before."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n?|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    said = texts.select(key, F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.contains("-->")).alias("ls"))
    fresh = F.filter("ls", lambda x, i: (i == 0) | (x != F.get("ls", i - 1)))
    return said.select(key, F.array_join(fresh, " ").alias("text"))


def segments_json(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Segments of each transcript as one JSON list: ``key, content``.  A transcript's segments meet in one row."""
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "text"))).alias("ss"))
    return rows.select(key, F.to_json(F.transform("ss", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))).alias("content"))


def transcript_lines(segments: DataFrame, header: Column, key: str = "transcript_id") -> DataFrame:
    """The lines of a transcript file, header first: ``key, idx, line``; written in order they are what ``parse_timed`` reads."""
    lines = segments.select(key, "idx", F.concat(F.format_string("[%8.2f --> %8.2f] ", F.col("start"), F.col("end")), F.trim("text")).alias("line"))
    return segments.select(key).distinct().select(key, F.lit(-1).alias("idx"), F.concat(F.lit("# "), header).alias("line")).unionByName(lines)


def quality_label(texts: DataFrame, key: str = "transcript_id", text: str = "content") -> DataFrame:
    """The label that comment lines give a transcript: the last ``gate=`` token, else a failure, else unknown."""
    gates = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^#.*?\bgate=([A-Z_]+)"), F.lit(1))
    failed = F.col(text).rlike(r"(?m)^#.*FAILED")
    label = F.when(F.size(gates) > 0, F.element_at(gates, -1)).when(failed, "EXTRACT_FAILED").otherwise("UNKNOWN")
    return texts.select(key, label.alias("quality_label"))


def stamp(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS.mmm``."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def to_vtt(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """One WebVTT text for each transcript: ``key, content``."""
    cue = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    cues = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cs"))
    return cues.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cs", lambda c: c["cue"]), "\n")).alias("content"))


def vtt_lines(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """The lines of WebVTT files, ``key, idx, part, line``, for a transcript of any length: written in that order they are ``to_vtt``'s text.

    Line breaks in a segment's text are spaces, as a line is one.
    """
    cue = F.array(F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end"))), F.regexp_replace("text", r"\r\n|[\r\n]", " "), F.lit(""))
    cues = segments.select(key, F.col("idx").cast("long").alias("idx"), F.posexplode(cue).alias("part", "line"))
    head = segments.groupBy(key).agg((F.min("idx") - 1).cast("long").alias("idx")).select(key, "idx", F.posexplode(F.array(F.lit("WEBVTT"), F.lit(""))).alias("part", "line"))
    return head.unionByName(cues)
