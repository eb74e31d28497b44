"""Explaining a hit: windows of text, passages by position, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE_LONG, PASSAGE_LEAD, PASSAGE_WINDOW = 300, 110, 280
FALLBACK_LONG, FALLBACK_LEAD, FALLBACK_WINDOW = 260, 90, 250


def window(text: Column, at: Column, long: int = PASSAGE_LONG, lead: int = PASSAGE_LEAD, width: int = PASSAGE_WINDOW) -> Column:
    """A text of more than long characters cut to width from lead before a place (1-based; 0 for none), ends marked."""
    start = F.greatest(F.lit(1), at - lead)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(width)), F.when(start + width - 1 < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= long, text).otherwise(cut)


def first_place(text: Column, stem: str) -> Column:
    return F.instr(F.lower(text), stem)


def passage_at(passages: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(doc, place) with the last passage(doc, start, ...) that starts at or before the position: an as-of join.

    An equi-join on the document with a range filter, reduced by max_by before any shuffle of its own.
    """
    j = hits.join(passages, "doc").where(F.col("start") <= F.col("place"))
    return j.groupBy("doc", "place").agg(F.max("start").alias("start"), F.max_by("passage", F.struct("start", "passage")).alias("passage"), F.max_by("body", F.struct("start", "passage")).alias("body"))


def reasons(ordered: Column, most: int = 6) -> Column:
    """Distinct labels of an array of (ord, label), in order, the first of them."""
    return F.slice(F.array_distinct(F.transform(F.array_sort(ordered), lambda x: x["label"])), 1, most)
