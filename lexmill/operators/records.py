"""Records beside the documents: run outcomes and probes, notes of a page, featured pieces, a map's links, works and ring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: A work is drawn from so many citing documents on.
DRAWN = 2


def outcomes(cells: DataFrame, evaluations: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """cells with usable, calls, thinking and tokens: sums over the evaluation's outcomes, over the run's where there is none.

    evaluations and runs hold key and outcomes, an array of (thinking, tokens); a null array or number counts as none.
    """
    told = evaluations.select(key, F.lit(True).alias("usable"), F.col("outcomes").alias("told"))
    kept = runs.select(key, F.col("outcomes").alias("kept"))
    o = F.when(F.col("usable"), F.col("told")).otherwise(F.col("kept"))
    total = lambda part: F.coalesce(F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[part].cast("long"), F.lit(0))), F.lit(0))
    calls = F.when(o.isNull(), 0).otherwise(F.size(o)).cast("long")
    j = cells.join(told, key, "left").join(kept, key, "left")
    return j.select(*cells.columns, F.coalesce("usable", F.lit(False)).alias("usable"), calls.alias("calls"), total("thinking").alias("thinking"), total("tokens").alias("tokens"))


def first_probe(rows: DataFrame, cell: str, order: list[str], probed: Column, values: list[str]) -> DataFrame:
    """(cell, values): of each cell the first row that was probed. Combined before the shuffle, nothing is sorted."""
    first = rows.where(probed).groupBy(cell).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("x"))
    return first.select(cell, "x.*")


def last_reached(strip: Column) -> Column:
    """The last turn of a presence strip before its first blank; 0 where it begins with one."""
    return F.length(F.regexp_extract(strip, "^[^ ]*", 0))


def stopped_at(strip: Column, width: int = 60) -> Column:
    """The turn at which a run stopped short; null for a run that reached its end, and for one without turns."""
    n = last_reached(strip)
    return F.when((n > 0) & (n < width), n)


def merged_footnotes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, key, kept, number): notes(doc, key, pos, content) of equal content, white space aside, become their first one.

    number: merged notes count by their first reference in refs(doc, at, key); null where none points at them.
    """
    first = refs.groupBy("doc", "key").agg(F.min("at").alias("at"))
    n = notes.withColumn("sig", F.trim(T.collapse_space(F.col("content")))).join(first, ["doc", "key"], "left").repartition("doc")  # both windows reuse it
    same = Window.partitionBy("doc", "sig")
    n = n.withColumns({"kept": F.min_by("key", "pos").over(same), "at": F.min("at").over(same)})
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.col("at").asc_nulls_last()))
    return n.select("doc", "key", "kept", F.when(F.col("at").isNotNull(), rank).alias("number"))


def sidenotes(refs: DataFrame, notes: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, at, key, content): the note at each reference that stands in none of tables(doc, start, stop), ends excluded."""
    t = tables.select(F.col("doc").alias("in_doc"), "start", "stop")
    placed = refs.join(notes.where(F.trim("content") != "").select("doc", "key", "content"), ["doc", "key"])
    inside = (F.col("doc") == F.col("in_doc")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))
    return placed.join(t, inside, "left_anti").select("doc", "at", "key", "content")


def featured(chosen: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """posts that chosen(pos, key) names, in its order."""
    return chosen.select("pos", key).join(posts, key).orderBy("pos")


def known_hints(hints: list[str], vocabulary: DataFrame) -> DataFrame:
    """(term): suggested words that the vocabulary has; the words are literals, so only their rows are shuffled."""
    return vocabulary.where(F.col("term").isin(hints)).select("term").distinct()


def filter_links(links: DataFrame, nodes: DataFrame, keep: str = "all") -> DataFrame:
    """links(src, dst): all, "crossing" between two series, or "book", touching one, by nodes(node, series, kind)."""
    if keep == "all":
        return links
    end = lambda name: nodes.select(F.col("node").alias(name), F.col("series").alias(f"{name}_series"), F.col("kind").alias(f"{name}_kind"))
    j = links.join(end("src"), "src").join(end("dst"), "dst")
    crossing = ~F.col("src_series").eqNullSafe(F.col("dst_series"))
    touching = F.coalesce(F.col("src_kind") == "book", F.lit(False)) | F.coalesce(F.col("dst_kind") == "book", F.lit(False))
    return j.where({"crossing": crossing, "book": touching}[keep]).select(*links.columns)


def shown_works(works: DataFrame, layer: str = "all", least: int = DRAWN) -> DataFrame:
    """works(work, kind, n) that a layer shows: "all" or "books" cited often enough; "none"."""
    shown = {"all": F.lit(True), "books": F.col("kind") == "book", "none": F.lit(False)}[layer]
    return works.where(shown & (F.col("n") >= least))


def drawn_or_alone(cites: DataFrame, least: int = DRAWN) -> DataFrame:
    """(doc, drawn, alone): works that a document cites and that others cite as well, and works that it alone cites."""
    c = cites.select("doc", "work").distinct()
    often = c.groupBy("work").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("work", F.lit(True).alias("often"))
    j = c.join(often, "work", "left")
    return j.groupBy("doc").agg(F.count("often").alias("drawn"), F.count_if(F.col("often").isNull()).alias("alone"))


def ring(nodes: DataFrame, group: str, order: str, gap: int = 2) -> DataFrame:
    """nodes with slot and angle on a ring: groups in order, gap slots before each and behind the last, from the top on.

    Slots are running counts of two levels: over the groups' sizes, and within a group.
    """
    sizes = nodes.groupBy(group).agg(F.count("*").alias("size"))
    by = Window.orderBy(group)  # a row a group
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + gap * F.row_number().over(by)
    whole = Window.partitionBy()
    starts = sizes.select(F.col(group).alias("of"), before.alias("start"), (F.sum("size").over(whole) + gap * (F.count("*").over(whole) + 1)).alias("total"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    n = nodes.join(starts, F.col(group).eqNullSafe(F.col("of"))).withColumn("slot", slot)
    return n.select(*nodes.columns, "slot", (-math.pi / 2 + (F.col("slot") + 0.5) / F.col("total") * 2 * math.pi).alias("angle"))
