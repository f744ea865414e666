"""Heading passages, and parts of notes by line, section or needle."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import fold

#: Fixed value: a heading, its level and its words.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def lines_of(notes: DataFrame, body_col: str = "body", first_line: Column | None = None) -> DataFrame:
    """(path, line, text, level, heading) of each line; level is 0 outside headings."""
    first = first_line if first_line is not None else F.lit(1)
    rows = notes.select("path", first.alias("first"), F.posexplode(F.split(F.col(body_col), "\n")).alias("pos", "text"))
    level = F.length(F.regexp_extract("text", HEADING, 1))
    return rows.select("path", (F.col("pos") + F.col("first")).cast("int").alias("line"), "text", level.alias("level"), F.regexp_extract("text", HEADING, 2).alias("heading"))


def split_passages(notes: DataFrame, body_col: str = "body", first_line: Column | None = None) -> DataFrame:
    """(path, heading, start_line, end_line, text): one passage for each heading, and one called
    Document for what stands before the first; those without text are left out."""
    order = Window.partitionBy("path").orderBy("line")
    rows = lines_of(notes, body_col, first_line).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(order))
    parts = rows.groupBy("path", "section").agg(F.max(F.when(F.col("level") > 0, F.col("heading"))).alias("heading"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_sort(F.collect_list(F.struct("line", "text", "level"))).alias("own"))
    body = F.array_join(F.transform(F.filter("own", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    text = F.regexp_replace(body, r"^\s+|\s+$", "")
    return parts.select("path", F.coalesce("heading", F.lit("Document")).alias("heading"), "start_line", "end_line", text.alias("text")).where("text <> ''")


def extract_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last, from 1, both included; what lies beyond the last line is left out."""
    if first <= 0 or last < first:
        raise ValueError("lines must be a positive range, the first no greater than the last")
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def extract_section(notes: DataFrame, name: str, body_col: str = "body") -> DataFrame:
    """(path, text) of the first section with that heading, in any case and accents, to the next
    heading that is no deeper."""
    rows = lines_of(notes, body_col)
    wanted = fold(F.lit(name))
    start = rows.where((F.col("level") > 0) & (fold(F.col("heading")) == wanted)).groupBy("path").agg(F.min(F.struct("line", "level")).alias("s"))
    inside = rows.join(start, "path").where("line >= s.line")
    end = inside.where("line > s.line AND level > 0 AND level <= s.level").groupBy("path").agg(F.min("line").alias("end"))
    kept = inside.join(end, "path", "left").where("end IS NULL OR line < end")
    joined = kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("own"))
    return joined.select("path", F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"))


def extract_snippet(notes: DataFrame, needle: str, context: int = 2, body_col: str = "body") -> DataFrame:
    """(path, line, text): the first line that holds the needle or all its words, in any case and
    accents, and its neighbours. Signs between the needle's words don't matter."""
    if context < 0:
        raise ValueError("context must not be negative")
    key = "".join(c for c in unicodedata.normalize("NFKD", needle.casefold()) if not unicodedata.combining(c))
    if not key:
        raise ValueError("the needle must not be empty")
    rows = lines_of(notes, body_col)
    line = fold(F.col("text"))
    hit = F.contains(line, F.lit(key))
    words = re.findall(r"\w+", key)
    every = F.lit(bool(words))
    for w in words:
        every = every & F.contains(line, F.lit(w))
    found = rows.where(hit | every).groupBy("path").agg(F.min("line").alias("at"))
    near = rows.join(found, "path").where(F.abs(F.col("line") - F.col("at")) <= context)
    out = near.groupBy("path").agg(F.min("at").alias("line"), F.array_sort(F.collect_list(F.struct(F.col("line").alias("l"), "text"))).alias("own"))
    return out.select("path", "line", F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"))
