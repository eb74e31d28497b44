"""Data-quality gates: each gives the rows that break a rule, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_dates(df: DataFrame, date: str) -> DataFrame:
    text = F.col(date).cast("string")
    return df.where(F.col(date).isNull() | ~text.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(text, "yyyy-MM-dd").isNull())


def footnote_mismatches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, side): definitions without a reference and references without a definition.

    A marker that begins a line, blanks aside, and has a colon behind it is a definition; any other marker, also one
    before a colon within a sentence, is a reference.
    """
    keys = lambda text, pattern: docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("key")).distinct()
    definition, marker = r"(?<![^\n])[ \t]*\[\^([A-Za-z0-9]+)\]:", r"\[\^([A-Za-z0-9]+)\]"
    defs = keys(F.col(text_col), definition)
    refs = keys(F.regexp_replace(text_col, definition, ":"), marker)
    return defs.join(refs, ["doc", "key"], "left_anti").withColumn("side", F.lit("no reference")).union(refs.join(defs, ["doc", "key"], "left_anti").withColumn("side", F.lit("no definition")))


def leaks(pages: DataFrame, id_col: str, text_col: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(id, rule, n): how often each pattern, given with its name, stands in a page. One pass over the pages."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(p), F.lit(0))).cast("long").alias("n")) for name, p in patterns])
    return pages.select(F.col(id_col).alias("id"), F.explode(rules).alias("x")).select("id", "x.rule", "x.n").where("n > 0")


def off_target(got: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows of expected(key, want, tol) that got(key, value) misses by more than tol, or lacks."""
    return expected.join(got, key, "left").where(F.col("value").isNull() | (F.abs(F.col("value") - F.col("want")) > F.col("tol") + 1e-9))


def featured_faults(chosen: DataFrame, posts: DataFrame, key: str, drafts: bool = False) -> DataFrame:
    """(key, fault): chosen keys that are no post, or, unless drafts are let pass, one that is not published."""
    p = posts.select(key, F.coalesce("published", F.lit(False)).alias("published"))
    fault = F.when(F.col("published").isNull(), "no post").when(~F.col("published") & F.lit(not drafts), "not published")
    return chosen.select(key).distinct().join(p, key, "left").select(key, fault.alias("fault")).where("fault is not null")


def set_faults(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, fault): keys that only one side has. One shuffle of both sides."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(actual.select(key, F.lit(0), F.lit(1)))
    g = both.groupBy(key).agg(F.max("e").alias("e"), F.max("a").alias("a")).where("e <> a")
    return g.select(key, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("fault"))


#: Fixed patterns: kinds of files that do not belong, words and numbers that may not stand in a text.
SCOPE_FILES = r"(?i)\.(npz|jsonl|docx)$|(^|/)paper[^/]*\.md$|exp[0-9]+"
SCOPE_TEXT = r"transcripts?\b|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx]"


def scope_faults(files: DataFrame, path: str, text: str, bad_files: str = SCOPE_FILES, bad_text: str = SCOPE_TEXT) -> DataFrame:
    """(path, fault): files whose path or text a pattern finds; both faults are judged in one pass."""
    hit = lambda c, pattern, name: F.when(F.coalesce(F.col(c), F.lit("")).rlike(pattern), F.lit(name))
    faults = F.array_compact(F.array(hit(path, bad_files, "file"), hit(text, bad_text, "text")))
    return files.select(F.col(path).alias("path"), F.explode(faults).alias("fault"))


def missing_parts(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, fault): pages without a top heading, or with references to notes but no section of notes."""
    h = F.coalesce(F.col(html), F.lit(""))
    notes = h.contains('class="footnote-ref"') & ~h.rlike(r'<section[^>]*class="footnotes"')
    faults = F.array_compact(F.array(F.when(~h.rlike("(?i)<h1[ >]"), F.lit("no heading")), F.when(notes, F.lit("no notes"))))
    return pages.select(F.col(id_col).alias("id"), F.explode(faults).alias("fault"))
