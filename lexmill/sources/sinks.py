"""Sinks: index tables, feeds, sitemaps, checked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I


def write_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index tables of a collection, term tables in term order so that scans skip by term."""
    I.document_frequency(docs, id_col, text_col).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    I.postings(docs, id_col, text_col).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{folder}/postings")
    I.positions(docs, id_col, text_col).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc", "pos").write.mode("overwrite").parquet(f"{folder}/positions")
    I.line_passages(docs, id_col, text_col).write.mode("overwrite").parquet(f"{folder}/passages")
    I.lengths(docs, id_col, text_col).write.mode("overwrite").parquet(f"{folder}/lengths")
    I.quantised(I.vectors(docs, id_col, text_col)).write.mode("overwrite").parquet(f"{folder}/vectors")


def feed_items(posts: DataFrame, site: str) -> DataFrame:
    """posts(ord, slug, title, summary, date, series, kind) -> (ord, item): RSS 2.0 items."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    categories = F.concat_ws("", *[F.when(F.col(c).isNotNull() & (F.col(c) != ""), tag("category", T.escape_markup(F.col(c)))) for c in ("series", "kind")])
    link = F.concat(F.lit(site + "/"), F.col("slug"), F.lit("/"))
    item = F.concat(tag("title", T.escape_markup(F.col("title"))), tag("link", link), tag("guid", link), tag("description", T.escape_markup(F.coalesce("summary", F.lit("")))), tag("pubDate", T.rfc822(F.col("date").cast("date"))), categories)
    return posts.select("ord", tag("item", item).alias("item"))


def sitemap_urls(posts: DataFrame, site: str, fixed: tuple[str, ...] = ("", "about/", "timeline/")) -> DataFrame:
    """(loc, lastmod): fixed pages carry the last date, the home page none."""
    last = posts.agg(F.max(F.col("date").cast("date")).alias("lastmod"))
    pages = last.select(F.explode(F.array(*[F.struct(F.lit(f"{site}/{p}").alias("loc"), (F.col("lastmod") if p else F.lit(None).cast("date")).alias("lastmod")) for p in fixed])).alias("x")).select("x.*")
    return pages.unionByName(posts.select(F.concat(F.lit(site + "/"), F.col("slug"), F.lit("/")).alias("loc"), F.col("date").cast("date").alias("lastmod")))


def write_checked(df: DataFrame, failures: DataFrame, path: str, check_only: bool = False) -> None:
    """Write df as JSON lines once no gate has failed."""
    bad = failures.take(5)
    if bad:
        raise AssertionError(f"gates failed: {bad}")
    if not check_only:
        df.write.mode("overwrite").json(path)
