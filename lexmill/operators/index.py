"""Index tables of a collection: vocabulary, postings, positions, passages, lengths, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

ID, TEXT = "doc_id", "text"


def occurrences(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, term): a row for each index term of each document, repeats kept."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(T.terms(F.col(text_col))).alias("term"))


def postings(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, term, tf). Counts are combined before the shuffle."""
    return occurrences(docs, id_col, text_col).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(term, df). Terms are made distinct within a document before they are exploded, so one shuffle is enough."""
    own = docs.select(F.explode(T.distinct_terms(F.col(text_col))).alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Distinct terms; the order of terms is binary."""
    return document_frequency(docs, id_col, text_col).select("term")


def positions(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, pos, term): positions count every word of the document in one stream; only index terms are recorded."""
    w = docs.select(F.col(id_col).alias("doc"), F.posexplode(T.words(F.col(text_col))).alias("pos", "term"))
    return w.where(T.is_term(F.col("term")))


def lengths(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, dl): all words, stop words and short ones too."""
    return docs.select(F.col(id_col).alias("doc"), F.size(T.words(F.col(text_col))).cast("long").alias("dl"))


def line_passages(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, passage, start, n_words, body): non-empty lines with the position of their first word."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    p = docs.select(F.col(id_col).alias("doc"), F.posexplode(lines).alias("passage", "body"))
    p = p.withColumn("n_words", F.size(T.words(F.col("body"))).cast("long"))
    before = Window.partitionBy("doc").orderBy("passage").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("start", F.coalesce(F.sum("n_words").over(before), F.lit(0)))


def markdown_passages(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, passage, start, n_words, body) of Markdown bodies.

    A blank line ends a passage, a heading is one of its own, a footnote definition ends one and is dropped.
    """
    line = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(T.body_after_rule(F.col(text_col)), "\n")).alias("n", "line"))
    head, note, blank = F.col("line").rlike(r"^\s{0,3}#{1,6}\s"), F.col("line").rlike(r"^\[\^[^\]]+\]:"), F.trim("line") == ""
    order = Window.partitionBy("doc").orderBy("n")
    line = line.withColumn("breaks", head | note | blank).withColumn("after", F.lag(head | note | blank, 1, True).over(order))
    line = line.withColumn("g", F.sum((F.col("breaks") | F.col("after")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = line.where(~note & ~blank).groupBy("doc", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    kept = kept.withColumn("body", T.markdown_text(F.col("raw"))).where("body <> ''")
    rank = Window.partitionBy("doc").orderBy("g")
    kept = kept.withColumn("passage", F.row_number().over(rank) - 1).withColumn("n_words", F.size(T.words(F.col("body"))).cast("long"))
    start = F.coalesce(F.sum("n_words").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.select("doc", "passage", start.alias("start"), "n_words", "body")


def footnotes(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, key, note): definitions with their continuation lines, white space collapsed."""
    line = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    opens, blank = F.col("line").rlike(r"^\[\^[^\]]+\]:"), F.trim("line") == ""
    order = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("g", F.sum((opens | blank).cast("int")).over(order)).withColumn("opens", opens)
    g = line.where(~blank).groupBy("doc", "g").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"), F.max("opens").alias("opens"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), " ")
    g = g.where("opens").select("doc", F.regexp_extract(joined, r"^\[\^([^\]]+)\]:", 1).alias("key"), T.collapse_space(F.regexp_replace(joined, r"^\[\^[^\]]+\]:", "")).alias("note"))
    return g


def delta_encoded(pos: DataFrame) -> DataFrame:
    """positions -> (doc, term, runs): the first position, then differences."""
    g = pos.groupBy("doc", "term").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    return g.select("doc", "term", F.transform("at", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("at", i - 1))).alias("runs"))


def delta_decoded(runs: DataFrame) -> DataFrame:
    """Inverse of delta_encoded."""
    upto = Window.partitionBy("doc", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    steps = runs.select("doc", "term", F.posexplode("runs").alias("i", "step"))
    return steps.select("doc", "term", F.sum("step").over(upto).cast("int").alias("pos"))


def vectors(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, dim: int = T.VECTOR_DIM) -> DataFrame:
    """(doc, dim, v): signed hashed tf-idf, (1 + ln tf) * ln(1 + N / df) per dimension. Long form, one shuffle a step."""
    n = docs.agg(F.count("*").alias("n_docs"))
    p = postings(docs, id_col, text_col).join(document_frequency(docs, id_col, text_col), "term")
    hashed = p.crossJoin(F.broadcast(n)).select(
        "doc", T.dimension(F.col("term"), dim).alias("dim"), (T.sign(F.col("term")) * (1 + F.log("tf")) * F.log(1 + F.col("n_docs") / F.greatest("df", F.lit(1)))).alias("w")
    )
    return hashed.groupBy("doc", "dim").agg(F.sum("w").alias("v"))


def quantised(v: DataFrame) -> DataFrame:
    """(doc, dim, q): unit length, 127 steps a side, halves towards plus infinity; a zero vector stays zero."""
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc")))
    return v.select("doc", "dim", F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(F.col("v") / F.when(norm == 0, 1).otherwise(norm) * 127 + 0.5))).cast("int").alias("q"))


def first_hits(docs: DataFrame, terms: list[str], id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc, hit_at): the least position of any of the terms, for documents that have one. No shuffle."""
    w = T.words(F.col(text_col))
    at = F.array_min(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.nullif(F.array_position(w, t), F.lit(0)) - 1))
    return docs.select(F.col(id_col).alias("doc"), at.cast("int").alias("hit_at")).where("hit_at is not null")
